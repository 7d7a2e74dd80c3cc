"""Output names for documents as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export, naming
from ..runtime import table

_KINDS, _MARKS = (".doc", ".docx", ".DOC", ".xls", ".txt"), ("", " (2)", " (3)", " (5)")


def _nth(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _path(source, k):
    return F.concat(source, F.lit("/Doc_"), (k % 61).cast("string"), _nth(_KINDS, k))


def output_names(spark, d):
    """Files of documents, of which many share a stem, beside names that pages took and plans that labelled documents had."""
    docs = table(spark, d, "documents")
    sources = docs.select(_path(F.col("source"), F.col("doc_id")).alias("source"))
    occupied = table(spark, d, "pages").select(F.concat(F.lit("SRC"), (F.col("page_id") % 20).cast("string"), F.lit("/doc_"), (F.col("page_id") % 61).cast("string"), F.lit("-译"), _nth(_MARKS, F.col("page_id")), F.lit(".docx")).alias("path"))
    known = table(spark, d, "labels").where("quality = 1").join(docs.select("doc_id", "source"), "doc_id")
    previous = known.groupBy(_path(F.col("source"), F.col("doc_id")).alias("source")).agg(F.min(F.concat("source", F.lit("/Doc_"), (F.col("doc_id") % 61).cast("string"), F.lit("-译"), _nth(_MARKS, F.col("doc_id")), F.lit(".docx"))).alias("output"))
    return naming.plan(sources, occupied, previous)


def export_sources(spark, d):
    """Source rows of the review workbook: each reference with what supports it."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax", F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("tag"))
    refs = li.select("tag", F.lit("process_capacity").alias("field"), F.col("l_quantity").cast("long").cast("string").alias("value")).distinct()
    refs = refs.withColumn("confidence", F.lit(0.9)).withColumn("verified", F.lit(True)).withColumn("source_short", F.concat(F.lit("PO "), "tag"))
    supporting = li.select(
        "tag", F.lit("process_capacity").alias("field"), F.col("l_quantity").cast("long").cast("string").alias("value"), F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"), F.lit(".pdf")).alias("file_name"),
        F.struct((F.col("l_linenumber") + 1).cast("long").alias("page"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).alias("table_index"), F.lit("CAPACITY").alias("row_label"), F.when(F.col("l_linenumber") % 3 == 0, "RATED").alias("column_label"), F.concat(F.lit("B"), F.col("l_linenumber").cast("string")).alias("cell")).alias("location"),
        F.concat(F.lit("capacity\n"), F.repeat(F.concat("tag", F.lit(" ")), (F.col("l_linenumber") * 30).cast("int"))).alias("original"), F.lit(None).cast("string").alias("translated"), F.lit("table").alias("method"), F.when(F.col("l_tax") > 0.02, 1 - F.col("l_tax")).alias("confidence"), F.when(F.col("l_tax") > 0.01, F.col("l_tax") < 0.05).alias("verified"), F.col("l_orderkey").alias("k"),
    )
    rows = export.source_rows(refs, supporting, ["tag", "field", "value"])
    return rows.select("k", "tag", "field", "value", "source_short", "file_name", "page", "table_location", F.md5(F.col("original").cast("binary")).alias("original_md5"), "translated", "method", F.round("confidence", 4).alias("confidence"), "evidence_verified", "confirmed_source", "remark")


QUERIES = {f.__name__: f for f in (output_names, export_sources)}

_list = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"
_P = f"source || '/Doc_' || doc_id % 61 || {_list(_KINDS)}[doc_id % {len(_KINDS)} + 1]"
ORACLE_SQL = {
    "output_names": rf"""
    WITH RECURSIVE src AS (SELECT DISTINCT {_P} AS source FROM documents),
    s AS (SELECT source, lower(regexp_replace(source, '\.[^.]*$', '')) || '|' || CASE WHEN lower(source) LIKE '%.xls' THEN '.xlsx' ELSE '.docx' END AS g, regexp_replace(source, '\.[^.]*$', '') AS stem, CASE WHEN lower(source) LIKE '%.xls' THEN '.xlsx' ELSE '.docx' END AS ext FROM src WHERE NOT lower(source) LIKE '%.txt'),
    prior AS (SELECT {_P} AS source, min(source || '/Doc_' || doc_id % 61 || '-译' || {_list(_MARKS)}[doc_id % {len(_MARKS)} + 1] || '.docx') AS output FROM labels JOIN documents USING (doc_id) WHERE quality = 1 GROUP BY 1),
    kept AS (SELECT source, output FROM (SELECT s.source, output, row_number() OVER (PARTITION BY lower(output) ORDER BY lower(s.source), s.source) AS r FROM prior JOIN s USING (source)) WHERE r = 1),
    taken AS (SELECT 'src' || page_id % 20 || '/doc_' || page_id % 61 || '-译' || {_list(_MARKS)}[page_id % {len(_MARKS)} + 1] || '.docx' AS p FROM pages UNION SELECT lower(output) FROM kept),
    o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY lower(source), source) AS m FROM s WHERE source NOT IN (SELECT source FROM kept)),
    -- one source after the other: numbers are tried from the last one on
    try AS (SELECT g, m, source, stem, ext, 1::BIGINT AS k FROM o WHERE m = 1
      UNION ALL SELECT CASE WHEN t.p IS NOT NULL THEN try.g ELSE n.g END, CASE WHEN t.p IS NOT NULL THEN try.m ELSE n.m END, CASE WHEN t.p IS NOT NULL THEN try.source ELSE n.source END, CASE WHEN t.p IS NOT NULL THEN try.stem ELSE n.stem END, CASE WHEN t.p IS NOT NULL THEN try.ext ELSE n.ext END, k + 1
      FROM try LEFT JOIN taken t ON t.p = lower(stem || '-译' || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || ext) LEFT JOIN o n ON n.g = try.g AND n.m = try.m + 1 WHERE t.p IS NOT NULL OR n.g IS NOT NULL),
    won AS (SELECT source, stem, ext, max(k) AS k FROM try GROUP BY ALL)
    SELECT source, stem || '-译' || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || ext AS output, k AS number, false AS reused, k > 1 AS renamed FROM won
    UNION ALL SELECT source, output, coalesce(nullif(regexp_extract(output, '\((\d+)\)', 1), '')::BIGINT, 1), true, output <> stem || '-译' || ext FROM kept JOIN s USING (source)""",
    "export_sources": """
    SELECT l_orderkey AS k, 'P-' || l_partkey AS tag, 'process_capacity' AS field, l_quantity::BIGINT::VARCHAR AS value, 'PO P-' || l_partkey AS source_short, 'order_' || l_orderkey || '.pdf' AS file_name, (l_linenumber + 1)::VARCHAR AS page,
      CASE WHEN l_linenumber % 2 = 0 THEN 'table ' || l_linenumber || ' / ' ELSE '' END || 'CAPACITY / ' || CASE WHEN l_linenumber % 3 = 0 THEN 'RATED / ' ELSE '' END || 'B' || l_linenumber AS table_location,
      md5(CASE WHEN length(trim('capacity ' || repeat('P-' || l_partkey || ' ', l_linenumber * 30))) > 700 THEN ('capacity ' || repeat('P-' || l_partkey || ' ', l_linenumber * 30))[1:699] || '…' ELSE trim('capacity ' || repeat('P-' || l_partkey || ' ', l_linenumber * 30)) END) AS original_md5,
      '' AS translated, 'table' AS method, round(CASE WHEN l_tax > 0.02 THEN 1 - l_tax ELSE 0.9 END, 4) AS confidence, CASE WHEN l_tax > 0.01 AND l_tax >= 0.05 THEN 'no' ELSE 'yes' END AS evidence_verified, '' AS confirmed_source, '' AS remark FROM lineitem""",
}
