"""Translation by tables: glossary, cache, dictionary; and a pluggable translator.

Dictionaries are input tables (source, target, kind), never part of the code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import ship_package

#: a dictionary for sequential replacement is broadcast only up to this size
MOST_TERMS = 20_000


def resolved(segments: DataFrame, glossary: DataFrame, cache: DataFrame, original: str = "original") -> DataFrame:
    """Adds ``translation`` and ``translation_source``: glossary before cache
    before nothing. Two equi-joins on the folded text; Spark broadcasts a side
    only if its size allows."""
    key = lambda c: F.lower(text.fold_ascii_space(F.col(c)))
    g = glossary.select(key("source").alias("_k"), F.col("target").alias("_g")).groupBy("_k").agg(F.min("_g").alias("_g"))
    c = cache.select(key("source").alias("_k"), F.col("target").alias("_c")).where(F.trim("_c") != "").groupBy("_k").agg(F.min("_c").alias("_c"))
    out = segments.withColumn("_k", key(original)).join(g, "_k", "left").join(c, "_k", "left")
    source = F.when(F.col("_g").isNotNull(), "glossary").when(F.col("_c").isNotNull(), "cache").when(text.needs_translation(F.col(original)), "pending").otherwise("unchanged")
    return out.withColumn("translation", F.coalesce("_g", "_c", F.when(source == "unchanged", F.col(original)))).withColumn("translation_source", source).drop("_k", "_g", "_c")


def replace_terms(df: DataFrame, column: str, terms: Iterable[tuple[str, str]], to: str = "translated") -> DataFrame:
    """Sequential replacement, longest source first, case aside, where no
    letter or digit touches the term; later terms see earlier results."""
    ordered = sorted({s: t for s, t in terms if s}.items(), key=lambda x: (-len(x[0]), x[0]))
    if len(ordered) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms; join them by word instead")
    if not ordered:
        return df.withColumn(to, F.col(column))
    listed = F.array(*(F.struct(F.lit("(?i)(?<![A-Za-z0-9])\\Q" + s + "\\E(?![A-Za-z0-9])").alias("p"), F.lit(t.replace("\\", "\\\\").replace("$", "\\$")).alias("t")) for s, t in ordered))
    return df.withColumn(to, F.aggregate(listed, F.col(column), lambda acc, x: F.regexp_replace(acc, x["p"], x["t"])))


def protect(df: DataFrame, column: str, to: str = "protected") -> DataFrame:
    """Protected tokens to numbered marks, with the map to restore them."""
    tokens = F.array_sort(text.protected_tokens(F.col(column)), lambda a, b: F.length(b) - F.length(a))
    d = df.withColumn("_t", tokens)
    marks = F.transform("_t", lambda x, i: F.struct(F.format_string("TKN%04dX", i).alias("mark"), x.alias("token")))
    d = d.withColumn("_m", marks)
    return d.withColumn(to, F.aggregate("_m", F.col(column), lambda acc, m: F.replace(acc, m["token"], m["mark"]))).withColumn("marks", F.map_from_entries(F.transform("_m", lambda m: F.struct(m["mark"], m["token"])))).drop("_t", "_m")


def restore(df: DataFrame, column: str, marks: str = "marks", to: str = "restored") -> DataFrame:
    return df.withColumn(to, F.aggregate(F.map_entries(marks), F.col(column), lambda acc, e: F.replace(acc, e["key"], e["value"])))


def translated(texts: DataFrame, translator: Callable[[list[str]], list[str]], column: str = "text", most_items: int = 16, most_chars: int = 6000) -> DataFrame:
    """Runs an injected translator over distinct texts in batches of bounded
    size; a failing batch is split in two, and a single text that fails gets
    an error code instead of a translation."""
    ship_package(texts.sparkSession)

    def attempt(batch: list[str]) -> list[tuple[str, str | None, str | None]]:
        try:
            out = translator(batch)
            if len(out) != len(batch):
                raise ValueError("incomplete_response")
            return [(s, t, None) for s, t in zip(batch, out)]
        except Exception as e:
            if len(batch) == 1:
                return [(batch[0], None, type(e).__name__)]
            half = len(batch) // 2
            return attempt(batch[:half]) + attempt(batch[half:])

    def run(batches):
        schema = pa.schema([("source", pa.string()), ("target", pa.string()), ("error", pa.string())])
        for b in batches:
            held, size, rows = [], 0, []
            for s in b.column(0).to_pylist():
                if held and (len(held) >= most_items or size + len(s) > most_chars):
                    rows += attempt(held)
                    held, size = [], 0
                held.append(s)
                size += len(s)
            if held:
                rows += attempt(held)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=schema.names), schema=schema, preserve_index=False)

    todo = texts.select(F.col(column).alias("source")).where("trim(source) <> ''").distinct()
    return todo.mapInArrow(run, "source string, target string, error string")
