"""Streamed queries: event files read as a stream, its results as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import table
from ..streaming import jobs

LEASE, DELAY = 12 * 3600, 600


def stream_jobs(spark, d):
    """Users play jobs, their events what happens to them: every change of state."""
    schema = table(spark, d, "events").schema
    # a pattern, since a stream takes a plain path for a folder
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    kind = F.when(F.col("event_type") == "signup", jobs.SUBMIT).when(F.col("event_type").isin("view", "click"), jobs.ALIVE).when(F.col("event_type") == "purchase", jobs.DONE).otherwise(jobs.FAIL)
    ts = F.col("ts").cast("timestamp")
    e = e.select("user_id", ts.alias("ts"), F.unix_millis(ts).alias("at_ms"), F.col("event_id").alias("n"), kind.alias("kind"))
    return jobs.run_available(e, "user_id", LEASE, f"{DELAY} seconds")


QUERIES = {f.__name__: f for f in (stream_jobs,)}

ORACLE_SQL = {
    "stream_jobs": f"""
    WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'alive' WHEN 'click' THEN 'alive' WHEN 'purchase' THEN 'done' ELSE 'fail' END AS kind,
        row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
    -- an event, and last of all the watermark at the end of the stream
    x AS (SELECT * FROM e UNION ALL SELECT user_id, (SELECT max(t) FROM e) - {DELAY} * 1000, 'end', max(k) + 1 FROM e GROUP BY user_id),
    s AS (SELECT user_id, 0::BIGINT AS k, '' AS state, 0::BIGINT AS last, 0::BIGINT AS attempt, []::STRUCT(ms BIGINT, state VARCHAR, attempt BIGINT)[] AS told FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT user_id, k, coalesce(new, mid), CASE WHEN new IS NOT NULL THEN t ELSE mlast END, attempt + coalesce((new IN ('running', 'resumed') AND new <> mid)::BIGINT, 0),
        list_concat(told, list_concat(CASE WHEN mid <> was THEN [{{'ms': mlast, 'state': mid, 'attempt': attempt}}] ELSE [] END, CASE WHEN new <> mid THEN [{{'ms': t, 'state': new, 'attempt': attempt + (new IN ('running', 'resumed'))::BIGINT}}] ELSE [] END))
      FROM (SELECT *, CASE kind WHEN 'submit' THEN CASE WHEN mid IN ('', 'succeeded', 'failed') THEN 'queued' END WHEN 'alive' THEN CASE mid WHEN 'queued' THEN 'running' WHEN 'requeued' THEN 'resumed' WHEN 'running' THEN 'running' WHEN 'resumed' THEN 'resumed' END
            WHEN 'done' THEN CASE WHEN mid IN ('running', 'resumed') THEN 'succeeded' END WHEN 'fail' THEN CASE WHEN mid IN ('running', 'resumed') THEN 'failed' END END AS new
        FROM (SELECT s.user_id, x.k, x.kind, greatest(x.t, last) AS t, state AS was, attempt, told, state IN ('running', 'resumed') AND (x.t > last + {LEASE} * 1000 OR x.kind = 'end' AND x.t >= last + {LEASE} * 1000) AS gone,
            CASE WHEN gone THEN 'requeued' ELSE state END AS mid, CASE WHEN gone THEN last + {LEASE} * 1000 ELSE last END AS mlast FROM s JOIN x ON x.user_id = s.user_id AND x.k = s.k + 1))),
    f AS (SELECT user_id, max_by(told, k) AS told FROM s GROUP BY user_id)
    SELECT user_id, r.ms AS at_ms, r.state AS state, r.attempt AS attempt FROM (SELECT user_id, unnest(told) AS r FROM f)"""
}
