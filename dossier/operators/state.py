"""State and incremental operators over event logs: changes, stalls, roll-ups.

The batch forms here are the meaning; :mod:`dossier.streaming.progress` has the
same as streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import STATUS_ORDER


def changes(events: DataFrame, key: str, order: Sequence[str], fingerprint: Column) -> DataFrame:
    """Rows whose fingerprint differs from that of the row before of the same key."""
    w = Window.partitionBy(key).orderBy(*order)
    d = events.withColumn("_f", fingerprint).withColumn("_p", F.lag("_f").over(w)).withColumn("_k", F.row_number().over(w))
    return d.where((F.col("_k") == 1) | ~F.col("_f").eqNullSafe(F.col("_p"))).drop("_f", "_p", "_k")


def stalls(events: DataFrame, key: str, time: str, seconds: int, end: Column) -> DataFrame:
    """Gaps of more than ``seconds`` without an event of a key, the last one up to ``end``."""
    w = Window.partitionBy(key).orderBy(time)
    times = events.select(key, time).distinct()
    gap = times.withColumn("until", F.coalesce(F.lead(time).over(w), end))
    length = F.unix_seconds("until") - F.unix_seconds(time)
    return gap.select(key, F.col(time).alias("since"), "until", length.alias("seconds")).where(F.col("seconds") > seconds)


def status_rank(status: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), status), F.lit(0))


def roll_up(stages: DataFrame, by: Sequence[str], status: str) -> DataFrame:
    """The worst status of each key, and how many stages have it."""
    worst = stages.groupBy(*by, status).agg(F.count("*").alias("n")).groupBy(*by).agg(F.max(F.struct(status_rank(F.col(status)).alias("r"), F.col(status).alias("status"), "n")).alias("m"))
    return worst.select(*by, F.col("m.status").alias("status"), F.col("m.n").alias("n_stages"))


def latest(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last event of each key; a partial aggregation."""
    rest = [c for c in events.columns if c != key and c not in order]
    return events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("l")).select(key, *(F.col(f"l.{c}").alias(c) for c in (*order, *rest)))
