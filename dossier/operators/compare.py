"""Comparing and merging keyed tables: differences, upserts, caches, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def three_way(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """missing, extra, changed or same for each key; one full outer join."""
    e, a = expected.select(F.col(key), F.col(value).alias("_e"), F.lit(1).alias("_he")), actual.select(F.col(key), F.col(value).alias("_a"), F.lit(1).alias("_ha"))
    state = F.when(F.col("_ha").isNull(), "missing").when(F.col("_he").isNull(), "extra").when(F.col("_e").eqNullSafe(F.col("_a")), "same").otherwise("changed")
    return e.join(a, key, "full_outer").select(key, state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not replaced, and all new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``; a partial aggregation, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    f = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("f"))
    return f.select(*keys, *(F.col(f"f.{c}").alias(c) for c in (*order, *rest) if c not in keys))


def cache_misses(texts: DataFrame, cache: DataFrame, text: str = "text", translation: str = "translation") -> DataFrame:
    """Distinct texts without a usable cached translation."""
    good = cache.where(~needs_refresh(F.col(text), F.col(translation))).select(text)
    return texts.select(text).where(F.col(text).isNotNull() & (F.trim(text) != "")).distinct().join(good, text, "left_anti")


def needs_refresh(source: Column, translated: Column) -> Column:
    """Empty, unchanged, or with far more Latin than Chinese characters."""
    from ..functions.text import CJK, LATIN

    latin, cjk = F.regexp_count(translated, F.lit(LATIN)), F.regexp_count(translated, F.lit(CJK))
    return translated.isNull() | (F.trim(translated) == "") | (F.trim(translated) == F.trim(source)) | (latin > F.greatest(F.lit(24.0), cjk * 1.8))


def selection_issues(selected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Selected but absent, and present but not selected."""
    gone = selected.join(present, key, "left_anti").select(key, F.lit("selected_file_missing").alias("code"))
    more = present.join(selected, key, "left_anti").select(key, F.lit("file_not_selected").alias("code"))
    return gone.unionByName(more)


def numbered_names(df: DataFrame, stem: str, suffix: str, order: Sequence[str], name: str = "output_name") -> DataFrame:
    """Names without conflicts: the first keeps ``stem.suffix``, others get ``stem (n).suffix``; case does not tell names apart."""
    k = F.row_number().over(Window.partitionBy(F.lower(stem), F.lower(suffix)).orderBy(*order))
    return df.withColumn(name, F.concat(F.col(stem), F.when(k > 1, F.concat(F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(""), F.lit("."), F.col(suffix)))


def reusable(stages: DataFrame, previous: DataFrame, order: str, key: str = "stage", signature: str = "signature") -> DataFrame:
    """Stages that may be reused: all up to and with it have unchanged signatures and their outputs."""
    p = previous.select(F.col(key), F.col(signature).alias("_p"), F.col("outputs_exist").alias("_o"))
    ok = F.coalesce((F.col(signature) == F.col("_p")) & F.col("_o"), F.lit(False))
    joined = stages.join(p, key, "left").withColumn("_ok", ok)
    w = Window.partitionBy("run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("reusable", F.min("_ok").over(w)).drop("_p", "_o", "_ok")


def owned_only_here(previous: DataFrame, current: DataFrame, output: str, source: str) -> DataFrame:
    """Outputs of earlier runs that are superseded and had a single owner."""
    once = previous.groupBy(output).agg(F.countDistinct(source).alias("n"), F.min(source).alias(source)).where("n = 1").drop("n")
    return once.join(current.select(output), output, "left_anti")
