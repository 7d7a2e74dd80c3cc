"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only.

Each text keeps, of every ``SPAN - K + 1`` consecutive k-gram hashes, the
smallest. A shared run of ``SPAN`` words holds one such window of k-grams in
full, so both sides keep the same one: joining the kept fingerprints misses no
shared run. A text with a hit is then extended: its runs of ``SPAN`` words are compared with
the items' word by word. Items of fewer words than ``SPAN`` are one
window each; they meet documents by the hash of a whole n-gram of their length.

Edge cases: a null or empty text has no words; a document or item id may be
null or repeat (equal ids with equal texts are one text for the marking, and
every row is put out); an item with a null id can mark words, but has no name
to count; empty tables give no hits; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

SPAN = 10
K = 7
#: up to this many benchmark windows are broadcast; beyond, Spark joins by shuffle
MOST_BROADCAST = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, SEPARATORS), "")


def grams(hashes: Column, k: int) -> Column:
    """Hash of each run of ``k`` word hashes, by position."""
    count = F.greatest(F.size(hashes) - (k - 1), F.lit(0))
    return F.transform(F.slice(hashes, 1, count), lambda _, i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k))))


def winnowed(gram: Column, window: int) -> Column:
    """Per window of consecutive grams the smallest hash (of a tie any: they are equal)."""
    count = F.greatest(F.size(gram) - (window - 1), F.lit(0))
    return F.transform(F.slice(gram, 1, count), lambda _, i: F.least(*(F.get(gram, i + j) for j in range(window))))


def runs_of(w: Column, size: int) -> Column:
    """Each run of ``size`` words, joined by blanks, by position."""
    count = F.greatest(F.size(w) - (size - 1), F.lit(0))
    return F.transform(F.slice(w, 1, count), lambda _, i: F.array_join(F.slice(w, i + 1, size), " "))


def _broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _windows(items: DataFrame) -> DataFrame:
    """(size, win, item_id): the distinct windows of the items, as joined words."""
    n = F.size("w")
    size = F.least(n, F.lit(SPAN))
    starts = F.sequence(F.lit(1), n - size + 1)
    return (
        items.where(n > 0)
        .select("item_id", size.alias("size"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("win"))
        .distinct()
    )


def contamination(docs: DataFrame, items: DataFrame, with_hash: bool = False) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items (sorted ids), contaminated,
    and with ``with_hash`` th, the ``xxhash64`` of its text."""
    given = stored(items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("w")), "items")
    windows = stored(_windows(given), "windows")
    n_windows = windows.count()
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most SPAN numbers
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("w"))

    # fingerprints kept on both sides; th tells texts of a repeated id apart
    hashed = lambda df, *c: df.select(*c, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    gram = lambda df, *c: hashed(df, *c).select(*c, grams(F.col("h"), K).alias("g"))
    keep = lambda df, *c: df.select(*c, F.explode(F.array_distinct(winnowed(F.col("g"), SPAN - K + 1))).alias("f"))
    marks = keep(gram(given.where(F.size("w") >= SPAN), "item_id"), "item_id").select("f").distinct()
    near = keep(gram(texts, "doc_id", "th"), "doc_id", "th").join(_broadcast_if_small(marks, n_windows), "f", "left_semi")
    found = near.select("doc_id", "th").distinct()
    for size in sorted(s for s in sizes if s < SPAN):
        short = windows.where(F.col("size") == size).select(F.split("win", " ").alias("w")).transform(lambda d: hashed(d)).select(F.element_at(grams(F.col("h"), size), 1).alias("f")).distinct()
        have = hashed(texts, "doc_id", "th").select("doc_id", "th", F.explode(F.array_distinct(grams(F.col("h"), size))).alias("f"))
        found = found.union(have.join(_broadcast_if_small(short, n_windows), "f", "left_semi").select("doc_id", "th"))
    found = stored(found.distinct(), "suspects")

    # extension: only texts with a hit; runs whose words equal a window's
    suspects = texts.join(found.select(F.col("doc_id").alias("d"), F.col("th").alias("t")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_semi")
    suspects = stored(suspects.dropDuplicates(["doc_id", "th"]), "extended")
    runs = None
    for size in sorted(sizes):
        each = suspects.select("doc_id", "th", F.posexplode(runs_of(F.col("w"), size)).alias("at", "win"), F.lit(size).alias("size"))
        runs = each if runs is None else runs.union(each)
    if runs is None:
        runs = suspects.select("doc_id", "th", F.lit(0).alias("at"), F.lit("").alias("win"), F.lit(0).alias("size")).where("false")
    distinct = windows.select("size", "win").distinct()
    hits = stored(runs.join(_broadcast_if_small(distinct, n_windows), ["size", "win"], "left_semi"), "hits")
    covered = hits.select("doc_id", "th", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("p")).distinct().groupBy("doc_id", "th").agg(F.count("*").alias("n_hit"))
    named = hits.select("doc_id", "th", "size", "win").distinct().join(_broadcast_if_small(windows, n_windows), ["size", "win"])
    named = named.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    result = covered.join(named.withColumnsRenamed({"doc_id": "nd", "th": "nt"}), F.col("doc_id").eqNullSafe(F.col("nd")) & (F.col("th") == F.col("nt"))).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "n_hit", "items")
    counted = texts.select("doc_id", "th", F.size("w").cast("long").alias("n_words"))
    out = counted.join(result, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.col("items"), F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *(["th"] if with_hash else []),
    )


def digest(found: DataFrame) -> DataFrame:
    """The item lists as a count and a hash."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
