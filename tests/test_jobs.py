"""The job stream: leases, recovery and a restart, against a plain machine."""

import random

import pandas as pd

from dossier.runtime import shared_path
from dossier.streaming import jobs

SCHEMA = "job string, ts timestamp, at_ms long, n long, kind string"


def plain(events, lease, watermark):
    out, held = [], {}
    for job, at, _, kind in sorted(events, key=lambda e: (e[1], e[2])):
        state, last, attempt = held.get(job, ("", 0, 0))
        if state in ("running", "resumed") and at > last + lease:
            state, last = "requeued", last + lease
            out.append((job, last, state, attempt))
        new = jobs.followed(state, kind)
        if new:
            if new != state:
                attempt += new in ("running", "resumed")
                out.append((job, at, new, attempt))
            state, last = new, at
        held[job] = state, last, attempt
    for job, (state, last, attempt) in held.items():
        if state in ("running", "resumed") and last + lease <= watermark:
            out.append((job, last + lease, "requeued", attempt))
    return sorted(out)


def write(spark, folder, events, k):
    rows = [(j, pd.Timestamp(at, unit="ms", tz="UTC").to_pydatetime(), at, n, kind) for j, at, n, kind in events]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{folder}/part={k}")


def test_leases_and_a_restart(spark):
    r = random.Random(7)
    base = 1_700_000_000_000
    make = lambda lo, hi, n0: [(f"j{r.randrange(6)}", base + r.randrange(lo, hi) * 1000, n0 + k, r.choice(["submit", "alive", "alive", "alive", "done", "fail"])) for k in range(150)]
    # the second part is later than the first, as after a restart
    first, second = make(0, 5000, 0), make(6000, 11000, 1000)
    folder, out, checkpoint = (shared_path(spark, x) for x in ("events", "jobs", "state"))
    write(spark, folder, first, 1)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(f"{folder}/part=*")
    rows = lambda df: sorted((x.job, x.at_ms, x.state, x.attempt) for x in df.collect())
    got = rows(jobs.run_available(stream(), "job", 300, "60 seconds", checkpoint, out))
    end = max(e[1] for e in first) - 60_000
    assert got == plain(first, 300_000, end)
    assert {"requeued", "resumed", "succeeded", "failed"} <= {x[2] for x in got}
    write(spark, folder, second, 2)
    got = rows(jobs.run_available(stream(), "job", 300, "60 seconds", checkpoint, out))
    assert got == plain(first + second, 300_000, max(e[1] for e in second) - 60_000)
    assert rows(jobs.run_available(stream(), "job", 300, "60 seconds", checkpoint, out)) == got
