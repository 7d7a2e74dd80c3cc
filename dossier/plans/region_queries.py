"""Region queries: documents play pages, their words boxes in twelve columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regions
from ..runtime import table


def _words(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"[ \n]")).alias("k", "word")).where("word <> ''")
    x0 = (F.col("k") % 12 * 48 + F.col("k") % 5 * 2 + F.col("doc_id") % 7).cast("double")
    top = F.floor(F.col("k") / 12) * 14 + F.col("k") % 3 * 0.75
    return t.select("doc_id", "k", "word", x0.alias("x0"), top.cast("double").alias("top"), (x0 + F.length("word") * 5).alias("x1"), (top + 10).cast("double").alias("bottom"))


def _regions(spark, d):
    """Tables at places that hang on the document's length, of four sizes."""
    t = table(spark, d, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("region"))
    x0, top = (F.col("n_chars") * 37 + F.col("region") * 71) % 500, (F.col("n_chars") * 11 + F.col("region") * 29) % 700
    wide, high = F.pow(F.lit(4), F.col("region")) * 6 + F.col("doc_id") % 5 * 20, F.pow(F.lit(4), F.col("region")) * 3 + 12
    return t.select("doc_id", "region", x0.cast("double").alias("x0"), top.cast("double").alias("top"), (x0 + wide).cast("double").alias("x1"), (top + high).cast("double").alias("bottom"))


def page_regions(spark, d):
    """Text regions within the tables of each page."""
    held = regions.words_in_regions(_words(spark, d), _regions(spark, d), "doc_id")
    r = regions.text_regions(held, ["doc_id", "region"], "k", "word")
    return r.select("doc_id", "region", F.col("line").cast("long").alias("line"), F.col("chunk").cast("long").alias("chunk"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "x0", "top", "x1", "bottom")


def region_overlaps(spark, d):
    r = _regions(spark, d)
    return regions.overlaps(r, r.withColumnRenamed("region", "other"), "doc_id", "region", "other").where("region < other")


def boundary_violations(spark, d):
    """Words beyond an A4 page."""
    pages = table(spark, d, "documents").select("doc_id", *(F.lit(v).alias(c) for c, v in zip(regions.BOX, (0.0, 0.0, 595.0, 842.0))))
    return regions.boundary_violations(_words(spark, d), pages, "doc_id", "k", "word").select("doc_id", "n", F.array_join("sample", " ").alias("sample"))


QUERIES = {f.__name__: f for f in (page_regions, region_overlaps, boundary_violations)}

_WORDS = """w AS (SELECT doc_id, k, word, (k % 12 * 48 + k % 5 * 2 + doc_id % 7)::DOUBLE AS x0, k // 12 * 14 + k % 3 * 0.75::DOUBLE AS top FROM (SELECT doc_id, i - 1 AS k, s[i] AS word FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]') AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)) WHERE word <> ''),
    word AS (SELECT *, x0 + length(word) * 5 AS x1, top + 10 AS bottom FROM w)"""
_REGIONS = """r AS (SELECT doc_id, region::INT AS region, ((n_chars * 37 + region * 71) % 500)::DOUBLE AS x0, ((n_chars * 11 + region * 29) % 700)::DOUBLE AS top, pow(4, region) * 6 + doc_id % 5 * 20 AS wide, pow(4, region) * 3 + 12 AS high FROM documents, range(4) AS t(region)),
    reg AS (SELECT *, x0 + wide AS x1, top + high AS bottom FROM r)"""
ORACLE_SQL = {
    "page_regions": f"""
    WITH RECURSIVE {_WORDS}, {_REGIONS},
    held AS (SELECT word.*, region FROM word JOIN reg ON word.doc_id = reg.doc_id AND (word.x0 + word.x1) / 2 BETWEEN reg.x0 - 1 AND reg.x1 + 1 AND (word.top + word.bottom) / 2 BETWEEN reg.top - 1 AND reg.bottom + 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, region ORDER BY top, x0, k) AS n FROM held),
    ln AS (SELECT doc_id, region, n, top AS head, 1 AS line FROM o WHERE n = 1
      UNION ALL SELECT o.doc_id, o.region, o.n, CASE WHEN abs(o.top - head) > 2.2 THEN o.top ELSE head END, line + (abs(o.top - head) > 2.2)::INT FROM ln JOIN o ON o.doc_id = ln.doc_id AND o.region = ln.region AND o.n = ln.n + 1),
    c AS (SELECT o.*, line, coalesce((x0 - lag(x1) OVER (PARTITION BY doc_id, region, line ORDER BY x0, k) > 16)::INT, 1) AS cut FROM o JOIN ln USING (doc_id, region, n)),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, region, line ORDER BY x0, k) AS chunk FROM c),
    t AS (SELECT doc_id, region, line, chunk, string_agg(word, ' ' ORDER BY x0, k) AS txt, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM g GROUP BY ALL)
    SELECT doc_id, region, line::BIGINT AS line, chunk::BIGINT AS chunk, md5(trim(regexp_replace(txt, '\\s+', ' ', 'g'))) AS text_md5, x0, top, x1, bottom FROM t WHERE regexp_matches(txt, '[A-Za-z]')""",
    "region_overlaps": f"""
    WITH {_REGIONS} SELECT a.doc_id, a.region, b.region AS other, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.bottom, b.bottom) - greatest(a.top, b.top)) AS area
    FROM reg a JOIN reg b ON a.doc_id = b.doc_id AND a.region < b.region AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.bottom, b.bottom) > greatest(a.top, b.top)""",
    "boundary_violations": f"""
    WITH {_WORDS}, b AS (SELECT doc_id, k, word, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM word WHERE x1 > 595.5 OR bottom > 842.5)
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) FILTER (n <= 12) AS sample FROM b GROUP BY doc_id""",
}
