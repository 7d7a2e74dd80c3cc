"""Deterministic range shards by an integer id."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: stands for a null id
FIRST = -(1 << 63)


def _lookup(ids: np.ndarray, ties: np.ndarray, key: Column, tie: Column) -> Column:
    """How many of the ordered cuts are at or before (key, tie): a binary search, for each row a step for each bit of their number."""
    n = len(ids)
    cut, other = F.lit(ids), F.lit(ties)
    steps = F.array(*(F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)))

    def step(at, more):
        to = at + more
        c, t = F.get(cut, to - 1), F.get(other, to - 1)
        return F.when((to <= n) & ((c < key) | ((c == key) & (t <= tie))), to).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


class Cuts(NamedTuple):
    shard: Column
    #: how many shards after it the rows equal to this one fill
    span: Column
    count: int
    #: whether any rows fill more than one shard
    wide: bool


def dealt(df: DataFrame, cuts: Cuts) -> DataFrame:
    """Adds ``shard`` and ``copy``, the row's place among the shards that its
    equal rows fill. Those are counted and made anew with their numbers, so that
    a shard gets as many whatever task they came from."""
    plain = df.withColumns({"shard": cuts.shard, "copy": F.lit(0)})
    if not cuts.wide:
        return plain
    plain = plain.withColumn("span", cuts.span)
    wide = plain.where("span > 0").groupBy(*df.columns, "shard", "span").agg(F.count("*").alias("rows"))
    each = wide.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("nth"))
    place = F.floor(F.col("nth") * (F.col("span") + 1) / F.col("rows")).cast("int")
    return plain.where("span = 0").drop("span").union(each.select(*df.columns, (F.col("shard") + place).alias("shard"), place.alias("copy")))


def shards(df: DataFrame, key: str, tie: str, size: Column, shard_bytes: int) -> Cuts:
    """Shards as expressions over ``key`` (a long, null before all) and ``tie``,
    rising with (key, tie). Each shard begins at a
    multiple of about ``shard_bytes`` of ``size`` in that order: the cuts come
    from exact running sums, so the same rows always get the same shards,
    however their ids lie. One cut for each shard comes to the driver."""
    k = F.coalesce(F.col(key), F.lit(FIRST).cast("long"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = df.groupBy(k.alias("k"), F.col(tie).alias("t")).agg(F.sum(size).cast("long").alias("bytes"))
    dealt = each.repartitionByRange(parts, "k", "t").sortWithinPartitions("k", "t").withColumn("part", F.spark_partition_id())

    def run(batches):
        upto = 0
        for b in batches:
            total = np.cumsum(b.column(2).to_numpy()) + upto
            upto = int(total[-1]) if len(total) else upto
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total)], names=["k", "t", "bytes", "part", "upto"])

    summed = stored(dealt.mapInArrow(run, "k long, t long, bytes long, part int, upto long"), "running")
    before, at = np.zeros(parts, np.int64), 0
    for part, total in sorted(tuple(r) for r in summed.groupBy("part").agg(F.max("upto")).collect()):  # a row per shuffle partition
        before[part], at = at, at + total
    end = F.get(F.lit(before), F.col("part")) + F.col("upto")
    first, last = (F.floor(x / F.lit(shard_bytes)).cast("int") for x in (end - F.col("bytes"), F.greatest(end - 1, end - F.col("bytes"))))
    place = F.struct("k", "t", (last - first).alias("span"))
    cuts = sorted(tuple(r) for r in summed.groupBy(first.alias("shard")).agg(F.min(place), F.max(place)).collect())
    if not cuts:
        return Cuts(F.lit(0), F.lit(0), 1, False)
    column = lambda f, kind=np.int64: np.array([f(c) for c in cuts], kind)
    pos = _lookup(column(lambda c: c[1].k), column(lambda c: c[1].t), k, F.col(tie)) - 1
    nth = lambda a: F.get(F.lit(a), pos)
    most = max(c[2].span for c in cuts)
    # only the last key of a shard can reach beyond it
    wide = (nth(column(lambda c: c[2].k)) == k) & (nth(column(lambda c: c[2].t)) == F.col(tie))
    span = F.when(wide, nth(column(lambda c: c[2].span, np.int32))).otherwise(F.lit(0))
    return Cuts(nth(column(lambda c: c[0], np.int32)), span, int(max(c[0] + c[2].span for c in cuts)) + 1, most > 0)
