"""Untyped JSON taken apart level by level."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written


def literal_pairs(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, path, name, value) of every member of an object, at any depth,
    whose value is a string. ``path`` leads to the object: names and places,
    each behind a slash. What is no JSON has none; a null has none.

    A round opens one level of everything that is still nested, as rows, so
    wide and deep values are dealt over tasks alike; there are as many rounds
    as levels."""
    spark = df.sparkSession
    level = df.select(*keys, F.lit("").alias("path"), F.col(column).alias("json")).where("json is not null")
    found = []
    while True:
        parsed = level.select(*keys, "path", F.try_parse_json("json").alias("v")).where("v is not null")
        members = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        kind = F.schema_of_variant(F.col("value"))
        rows = members.select(*keys, "path", "pos", "key", kind.alias("kind"), F.to_json("value").alias("json"), F.when(kind == "STRING", F.try_variant_get("value", "$", "string")).alias("value"))
        rows = written(rows.where("key is not null and kind = 'STRING' or kind like 'OBJECT%' or kind like 'ARRAY%'"), "members")
        found.append(rows.where("kind = 'STRING'").select(*keys, "path", F.col("key").alias("name"), "value"))
        step = F.coalesce("key", F.col("pos").cast("string"))
        level = rows.where("kind <> 'STRING'").select(*keys, F.concat("path", F.lit("/"), step).alias("path"), "json")
        if level.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)


def is_long_text(c: Column) -> Column:
    """A sentence rather than a name: 45 characters, or seven words of two letters."""
    return (F.length(F.trim(c)) >= 45) | (F.regexp_count(c, F.lit("[A-Za-z]{2,}")) >= 7)
