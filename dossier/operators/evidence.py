"""Joins of values with the passages that support them.

Containment is never a join condition by itself: rows meet by an equal key
(file and page, or a word of the value), and containment filters what met.
Translations by place and text are in ``located``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def verified(value: Column, original: Column, translated: Column, method: Column, block: Column, tag: Column) -> Column:
    """Whether a source supports a value: it is contained in the source's text,
    or, for a tag of five characters or more, but for all other characters; for
    a translation segment also in its translation, else also in the block."""
    compact = lambda c: F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9-]", "")
    by_tag = (F.length(compact(tag)) >= 5) & (compact(value) == compact(tag)) & compact(original).contains(compact(tag))
    segment = F.coalesce(method == "translation_segment", F.lit(False))
    direct = text.value_in_text(value, original) | by_tag | (segment & text.value_in_text(value, translated))
    return direct & (segment | block.isNull() | text.value_in_text(value, block) | by_tag)


def with_orphans(documents: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Documents, and for segments without a document one synthetic row per key."""
    orphans = segments.join(documents, key, "left_anti").groupBy(key).agg(F.count("*").alias("n_segments"))
    own = documents.join(segments.groupBy(key).agg(F.count("*").alias("n_segments")), key, "left")
    return own.select(key, F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.lit(False).alias("synthetic")).unionByName(orphans.select(key, "n_segments", F.lit(True).alias("synthetic")))


def keyed_or_next(rows: DataFrame, found: DataFrame, item: str, file: str, page: str, value: str) -> DataFrame:
    """The value of an equal item, else that of the next page of the same file."""
    by_item = found.groupBy(item).agg(F.min_by(value, page).alias("_by_item"))
    by_page = found.select(F.col(file), (F.col(page) - 1).alias(page), F.col(value).alias("_by_page"))
    return rows.join(by_item, item, "left").join(by_page, [file, page], "left").withColumn(value, F.coalesce("_by_item", "_by_page")).withColumn("matched_by", F.when(F.col("_by_item").isNotNull(), "item").when(F.col("_by_page").isNotNull(), "next_page").otherwise("none")).drop("_by_item", "_by_page")


def closest_before(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, keep: list[str]) -> DataFrame:
    """As-of join: for each left row the latest right row of its key at or
    before its time. Both sides are merged and the last seen value is carried
    on, so no pairs arise."""
    r = right.select(*on, F.col(right_time).alias("_t"), F.struct(F.col(right_time).alias("_rt"), *keep).alias("_v"), F.lit(0).alias("_side"))
    l = left.select(*on, F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(1).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select(*(F.col(f"_l.{c}").alias(c) for c in left.columns), *(F.col(f"_last.{c}").alias(c) for c in keep))
