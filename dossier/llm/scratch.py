"""Intermediate tables and files in the folder that all executors share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..runtime import shared_path

_WRITTEN: dict[str, list[str]] = {}


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one run; with a scheme, so that tasks and driver agree."""
    path = shared_path(spark, label)
    return path if "://" in path else "file://" + path.removeprefix("file:")


#: Spark sends this much to a Python worker at once where the session says nothing smaller; rows of blobs are large
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
#: a row group is held whole by who writes it and by who reads it; its size is looked at from the fourth row on
#: (by default from the hundredth), since rows may be blobs of megabytes
ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "4"}


@contextmanager
def batches_of(spark: SparkSession, most: int):
    """Within it, Spark sends at most ``most`` bytes (or one row) to a Python worker at once."""
    given = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, most)
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if given is None else spark.conf.set(BATCH, given)


def stored(df: DataFrame, label: str, batch: int = BATCH_BYTES) -> DataFrame:
    """Writes ``df`` once and gives the written table: cuts the lineage, is
    computed once whoever reads it, and survives a lost executor. ``batch``
    bytes at most go to a Python worker at once."""
    spark = df.sparkSession
    path = new_path(spark, label)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    with batches_of(spark, batch):
        df.write.options(**ROW_GROUPS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The tables of this session that are still there, in order."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing will read again."""
    held = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        held.remove(path)
