"""The state operators over events as Structured Streaming.

State is small: the last fingerprint and the last time of each key, in Spark's
state store; timers are event time under a watermark.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..runtime import shared_path, ship_package

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def changes(events: DataFrame, key: str = "user_id", fingerprint: str = "event_type") -> DataFrame:
    """Events whose fingerprint differs from the key's last one."""
    ship_package(events.sparkSession)

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        before = rows[fingerprint].shift(1)
        before.iloc[0] = last
        out = rows[rows[fingerprint] != before]
        state.update((rows[fingerprint].iloc[-1],))
        yield out[["event_id", key, fingerprint]]

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"event_id long, {key} {kind}, {fingerprint} string", "last string", "append", GroupStateTimeout.NoTimeout)


def stalls(events: DataFrame, key: str = "user_id", seconds: int = 1800, delay: str = "10 minutes") -> DataFrame:
    """A row once a key has had no event for ``seconds`` of event time."""
    ship_package(events.sparkSession)

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "since_ms": [last]})
            return
        newest = max(int(f["ts"].max().timestamp() * 1000) for f in frames)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last,))
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    kind = events.schema[key].dataType.simpleString()
    return events.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, since_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events by window and type; late ones are dropped after ``delay``."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n_events", "total")


def unique_snapshots(events: DataFrame, fingerprint: list[str], delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(fingerprint)


def in_batches(events: DataFrame, handle, checkpoint: str, most_rows: int = 1000, trigger: str = "1 second", aside: str | None = None):
    """Calls ``handle(rows, batch_id)`` for bounded micro-batches; a failing
    batch is split in two until single rows fail, which are put aside: written
    to the table ``aside`` (a new one in the shared folder if none is given)
    under failed_batch and failed_row, and listed as (batch id, error, table)."""
    failed: list = []
    aside = aside or shared_path(events.sparkSession, "failed")

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_number", F.monotonically_increasing_id()).persist()
        try:
            # numbers rise by one within a partition, whose number is in the high bits
            sizes = sorted(rows.groupBy(F.shiftright("_number", 33).alias("part")).count().collect())
            ends = list(accumulate(r[1] for r in sizes))

            def number(k: int) -> int:
                i = min(bisect_right(ends, k), len(ends) - 1)
                return (sizes[i][0] << 33) + k - ends[i] + sizes[i][1]

            def attempt(lo: int, hi: int) -> None:
                these = rows.where(F.col("_number").between(number(lo), number(hi - 1))).drop("_number")
                try:
                    handle(these, batch_id)
                except Exception as e:
                    if hi - lo > 1:
                        mid = (lo + hi) // 2
                        attempt(lo, mid)
                        attempt(mid, hi)
                        return
                    these.write.mode("overwrite").parquet(f"{aside}/failed_batch={batch_id}/failed_row={lo}")
                    failed.append((batch_id, str(e), aside))

            for lo in range(0, ends[-1] if ends else 0, most_rows):
                attempt(lo, min(lo + most_rows, ends[-1]))
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start(), failed
