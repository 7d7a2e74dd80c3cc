"""What of an earlier run may be kept: stages by their signatures and what they stand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written


def own_reason(signature: Column, before: Column, outputs_exist: Column, status: Column) -> Column:
    """Why a stage by itself must run again, or null."""
    return (
        F.when(before.isNull(), "never_ran")
        .when(~F.coalesce(signature == before, F.lit(False)), "signature_changed")
        .when(F.coalesce(status, F.lit("")) != "success", "not_successful")
        .when(~F.coalesce(outputs_exist, F.lit(False)), "outputs_missing")
    )


def stage_reuse(stages: DataFrame, edges: DataFrame, previous: DataFrame, key: str = "stage") -> DataFrame:
    """(key, reusable, reason, distance, root) for each of ``stages`` (key,
    signature), given what they read (``edges``: source, target) and the last
    run (``previous``: key, signature, outputs_exist, status).

    A stage is stale by itself or because something that it reads, at any
    distance, is. Staleness spreads along the edges a step a round, from what
    the last round reached alone, so a round reads the edges and no more; the
    rounds are as many as the longest way to a stale stage, loops included.
    ``distance`` and ``root`` name the nearest stage that began it, of several
    the least."""
    p = previous.groupBy(key).agg(*(F.min(c).alias(f"_{c}") for c in ("signature", "outputs_exist", "status")))
    own = stages.join(p, key, "left").select(key, own_reason(F.col("signature"), F.col("_signature"), F.col("_outputs_exist"), F.col("_status")).alias("own"))
    own = written(own.distinct(), "own")
    e = written(edges.where("source is not null and target is not null and source <> target").select("source", "target").distinct(), "edges")
    front = written(own.where("own is not null").select(F.col(key).alias("stage"), F.lit(0).alias("distance"), F.col(key).alias("root")), "stale")
    stale, rounds = front, [front]
    while not front.isEmpty():
        reached = front.join(e, F.col("stage") == F.col("source")).groupBy("target").agg(F.min("root").alias("root"))
        new = reached.join(stale.select(F.col("stage").alias("target")), "target", "left_anti")
        front = written(new.select(F.col("target").alias("stage"), F.lit(len(rounds)).alias("distance"), "root"), "stale")
        rounds.append(front)
        stale = stale.union(front)
        if len(rounds) % 16 == 0:  # one table again, so that plans stay short
            stale = written(stale, "stale")
    met = own.join(stale.withColumnRenamed("stage", key), key, "left")
    reason = F.coalesce("own", F.when(F.col("root").isNotNull(), "upstream_stale"), F.lit(""))
    return met.select(key, F.col("root").isNull().alias("reusable"), reason.alias("reason"), "distance", "root")
