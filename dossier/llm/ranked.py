"""Places within groups of any size, in the order of Spark's range partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import stored


def ranked(df: DataFrame, group: str, by: list[str], name: str = "at") -> DataFrame:
    """Adds ``name``, the row's place from 0 within its ``group`` (a string,
    never null) in the order of ``by``; rows equal in both are numbered in any
    order. A group may fill many range partitions: only the first group of a
    partition can have begun before it, so a row for each partition, summed on
    the driver, is all that the numbering within the partitions lacks."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [group, *by, "_tie"]  # rows that are equal otherwise may be dealt to several partitions
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie")
    marked = rows.withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*marked.schema.fields, T.StructField("_index", T.LongType()), T.StructField("_nth", T.LongType())])

    def number(batches):
        at, held, since = 0, None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g = b.column(b.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[0], new[1:] = g[0] != held, g[1:] != g[:-1]
            index = np.arange(at, at + n)
            began = np.maximum.accumulate(np.where(new, index, since))
            at, held, since = at + n, g[-1], int(began[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index), pa.array(index - began)], names=[*b.schema.names, "_index", "_nth"])

    t = stored(marked.mapInArrow(number, schema), "ranked")
    ends = t.groupBy("_part").agg(
        F.count("*"), F.min_by(group, "_index"), F.max_by(group, "_index"), F.max_by("_nth", "_index"), F.sum(F.when(F.col("_nth") == F.col("_index"), 1).otherwise(0))
    )
    before, held, upto = np.zeros(parts, np.int64), None, 0
    for part, n, first, last, nth, same in sorted(map(tuple, ends.collect())):  # a row for each shuffle partition
        before[part] = upto if first == held else 0
        upto = int(nth) + 1 + (int(before[part]) if same == n else 0)
        held = last
    place = F.col("_nth") + F.when(F.col("_nth") == F.col("_index"), F.get(F.lit(before), F.col("_part"))).otherwise(0)
    return t.withColumn(name, place.cast("long")).drop("_part", "_index", "_nth")
