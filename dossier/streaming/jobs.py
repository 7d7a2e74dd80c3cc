"""Job queue as a keyed stream: queued, claimed under a lease, expired, resumed.

Events of a job submit it, show a live worker (the first one claims it), or end
it. A claim holds for ``lease`` seconds after its last sign of life; then the
job goes back to the queue, to be resumed by the next claim. The state of a job
is three values in Spark's state store, the lease is an event-time timer, so a
restarted stream goes on where it was, jobs under a lease included.

Events of one job are taken in order of time within a batch; one that is older
than the job's last is taken at that time. An event that does not fit the state
(a sign of life of an unknown job, a second submission) changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..runtime import shared_path, ship_package

SUBMIT, ALIVE, DONE, FAIL = "submit", "alive", "done", "fail"
QUEUED, RUNNING, RESUMED, REQUEUED, SUCCEEDED, FAILED = "queued", "running", "resumed", "requeued", "succeeded", "failed"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def followed(state: str, kind: str) -> str | None:
    """The state after an event, or None where it does not fit."""
    if kind == SUBMIT:
        return QUEUED if state in ("", SUCCEEDED, FAILED) else None
    if kind == ALIVE:
        return {QUEUED: RUNNING, REQUEUED: RESUMED, RUNNING: RUNNING, RESUMED: RESUMED}.get(state)
    return (SUCCEEDED if kind == DONE else FAILED) if state in (RUNNING, RESUMED) else None


class Jobs(StatefulProcessor):
    """Emits (job, at_ms, state, attempt) at every change of state."""

    def __init__(self, job: str, lease_ms: int):
        self.job, self.lease_ms = job, lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("job", "state string, last long, attempt long")

    def _put(self, state: str, last: int, attempt: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.held.update((state, last, attempt))
        if state in (RUNNING, RESUMED):
            self.handle.registerTimer(last + self.lease_ms)

    def _out(self, key, rows: list[tuple[int, str, int]]) -> Iterator[pd.DataFrame]:
        if rows:
            at, state, attempt = zip(*rows)
            yield pd.DataFrame({self.job: [key[0]] * len(rows), "at_ms": at, "state": state, "attempt": attempt})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, last, attempt = self.held.get() if self.held.exists() else ("", 0, 0)
        out = []
        events = sorted((int(at), int(n), kind) for f in rows for at, n, kind in zip(f["at_ms"], f["n"], f["kind"]))
        for at, _, kind in events:
            at = max(at, last)
            if state in (RUNNING, RESUMED) and at > last + self.lease_ms:
                state, last = REQUEUED, last + self.lease_ms
                out.append((last, state, attempt))
            new = followed(state, kind)
            if new is None:
                continue
            if new != state:
                attempt += new in (RUNNING, RESUMED)
                out.append((at, new, attempt))
            state, last = new, at
        if state:
            self._put(state, last, attempt)
        yield from self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, last, attempt = self.held.get() if self.held.exists() else ("", 0, 0)
        if state in (RUNNING, RESUMED) and last + self.lease_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self._put(REQUEUED, last + self.lease_ms, attempt)
            yield from self._out(key, [(last + self.lease_ms, REQUEUED, attempt)])

    def close(self) -> None:
        pass


def transitions(events: DataFrame, job: str, lease: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """Changes of state from a stream of (job, ts, at_ms, n, kind); ``n`` orders events of one time."""
    ship_package(events.sparkSession)
    schema = T.StructType([T.StructField(job, events.schema[job].dataType), T.StructField("at_ms", T.LongType()), T.StructField("state", T.StringType()), T.StructField("attempt", T.LongType())])
    return events.withWatermark("ts", delay).groupBy(job).transformWithStateInPandas(Jobs(job, lease * 1000), schema, "append", "eventTime")


def run_available(events: DataFrame, job: str, lease: int, delay: str = "10 minutes", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Runs the stream over what there is and gives its changes of state as a
    table. Given the same folders again, it goes on where it stopped."""
    spark = events.sparkSession
    out, checkpoint = out or shared_path(spark, "jobs"), checkpoint or shared_path(spark, "jobs-checkpoint")
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)  # the state store that keeps timers
    try:
        stream = transitions(events, job, lease, delay)
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(out)
