"""Texts to located blocks, document rows and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text


def blocks(docs: DataFrame, key: str = "document_id", body: str = "text") -> DataFrame:
    """One row per line with more than white space: line number from 1, order
    from 1 among the kept lines, block_id, folded text. No shuffle: the order
    is the position in the filtered array."""
    lines = F.transform(F.split(F.col(body), text.LINE_ENDS), lambda x, i: F.struct((i + 1).alias("line"), text.fold_ascii_space(x).alias("original_text")))
    kept = F.filter(lines, lambda x: x["original_text"] != "")
    rows = docs.select(key, F.posexplode(kept).alias("at", "b"))
    order = (F.col("at") + 1).alias("text_order")
    return rows.select(key, order, ids.block_id(F.col(key), F.col("at") + 1).alias("block_id"), F.lit("paragraph").alias("block_type"), F.col("b.line").alias("line"), F.col("b.original_text").alias("original_text"), F.lit(1.0).alias("confidence"))


def parse_status(n_blocks: Column, error: Column | None = None, supported: Column | None = None) -> Column:
    """failed > skipped > low_quality (nothing found) > success."""
    status = F.when(n_blocks == 0, "low_quality").otherwise("success")
    if supported is not None:
        status = F.when(~supported, "skipped").otherwise(status)
    return status if error is None else F.when(error.isNotNull(), "failed").otherwise(status)


def status_summary(documents: DataFrame, name: str = "file_name", most: int = 5) -> DataFrame:
    """Count and first names by status, bounded by keeping the ``most`` smallest."""
    from pyspark.sql import Window

    first = documents.groupBy("parse_status", name).agg(F.count("*").alias("n"))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("parse_status").orderBy(name))).where(F.col("k") <= most)
    names = ranked.groupBy("parse_status").agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("first_names"))
    return documents.groupBy("parse_status").agg(F.count("*").alias("n_documents")).join(names, "parse_status")


def language_of(latin: Column, cyrillic: Column) -> Column:
    """English or Russian by the script of the letters, mixed with letters of both; else unknown."""
    return F.when((latin > 0) & (cyrillic > 0), "mixed").when(cyrillic > 0, "ru").when(latin > 0, "en").otherwise("unknown")
