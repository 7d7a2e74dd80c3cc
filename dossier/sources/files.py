"""Folders of files as DataFrames.

Spark lists and reads the files (``binaryFile``, any file system); each is
parsed where it was read. A file that can't be parsed gives a row that says so.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..runtime import ship_package
from . import formats

DOCUMENT = f"document_id string, path string, file_name string, file_type string, length long, parse_status string, error string, blocks array<struct<{formats.BLOCK.replace(' ', ':', ).replace(',:', ',')}>>"


def listing(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, file_name, kb) without reading contents; lock files are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    named = f.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).where(~F.col("file_name").startswith("~$"))
    return named.select("path", "file_name", F.round(F.col("length") / 1024, 1).alias("kb"), "length", "modificationTime")


def documents(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """One row per file with its blocks."""
    ship_package(spark)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    root = folder.rstrip("/") + "/"
    relative = F.regexp_replace("path", "^.*?" + root.replace("file://", "").replace(".", r"\."), "")
    f = f.select(ids.document_id(relative).alias("document_id"), "path", name.alias("file_name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("file_type"), "length", "content").where(~F.col("file_name").startswith("~$"))

    def run(frames):
        for pdf in frames:
            out = [formats.parse(n, bytes(c)) for n, c in zip(pdf["file_name"], pdf["content"])]
            yield pdf.drop(columns="content").assign(parse_status=[o[0] for o in out], error=[o[1] for o in out], blocks=[o[2] for o in out])

    return f.mapInPandas(run, DOCUMENT)


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents in order, with ids."""
    rows = docs.select("document_id", "file_name", F.posexplode("blocks").alias("at", "b"))
    return rows.select("document_id", "file_name", (F.col("at") + 1).alias("text_order"), ids.block_id(F.col("document_id"), F.col("at") + 1).alias("block_id"), "b.*")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Translation segments from JSON lines under any of their field names."""
    raw = spark.read.json(path)
    first = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in raw.columns), F.lit(None).cast("string"))
    return raw.select(first("source_relative_path", "source_file", "file_name").alias("file"), first("page").cast("int").alias("page"), first("sheet").alias("sheet"), first("cell").alias("cell"), first("original", "text", "source").alias("original"), first("translation", "translated").alias("translation"))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, kind) of a CSV file with a header."""
    g = spark.read.option("header", "true").csv(path)
    kind = F.col("kind") if "kind" in g.columns else F.lit("term")
    return g.select(F.trim("source").alias("source"), F.trim("target").alias("target"), kind.alias("kind")).where("source <> '' and target <> ''")


def pandas_preview(df: DataFrame, rows: int = 80) -> pd.DataFrame:
    """The first rows for a view."""
    return df.limit(rows).toPandas()
