"""Order over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written


def _dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """The table in Spark's own range partitions, whose numbers in ``_b`` rise
    with ``by``. Written, so that the numbers stay what they are; results that
    build on counts of the partitions are exact, wherever those begin."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *by).withColumn("_b", F.spark_partition_id()), "ordered")


def _with_earlier(d: DataFrame, total: Column) -> DataFrame:
    """Adds ``_before``: ``total`` over all partitions before the row's."""
    sums = d.groupBy("_b").agg(total.alias("_s"))
    earlier = F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    return d.join(sums.select("_b", F.coalesce(earlier, F.lit(0)).alias("_before")), "_b")


def rank_by_range(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Places 1..n in the order of ``by``, which should be unique."""
    here = F.row_number().over(Window.partitionBy("_b").orderBy(*by))
    d = _with_earlier(_dealt(df, by), F.count("*"))
    return d.withColumn(name, (here + F.col("_before")).cast("long")).drop("_b", "_before")


def running_total(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and with each row in the order of ``by``."""
    here = F.sum(value).over(Window.partitionBy("_b").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    d = _with_earlier(_dealt(df, by), F.sum(value))
    return d.withColumn(name, here + F.col("_before")).drop("_b", "_before")
