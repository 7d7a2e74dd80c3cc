"""Order-dependent grouping: gaps, anchored lines, paragraphs, batches, page ranges.

Rules that look at the row before are windows with a running sum of break
flags. Rules that look at the head of the open group (anchored lines, bounded
batches) are folds over the sorted rows of one key, still in Catalyst.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_groups(df: DataFrame, by: Sequence[str], order: Sequence[str], begin: Column, end: Column, gap, name: str = "chunk") -> DataFrame:
    """A new group where ``begin`` lies more than ``gap`` after the ``end`` of the row before; from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    breaks = F.when(F.lag(end).over(w).isNull() | (begin - F.lag(end).over(w) > gap), 1).otherwise(0)
    d = df.withColumn("_break", breaks)
    return d.withColumn(name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def flagged_groups(df: DataFrame, by: Sequence[str], order: Sequence[str], breaks: Column, name: str) -> DataFrame:
    """A new group at each row with ``breaks``; rows before the first one are group 0."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w))


def anchored_groups(df: DataFrame, by: Sequence[str], items: Column, tolerance: float, name: str = "groups") -> DataFrame:
    """Groups of sorted positions: a position joins the open group unless it is
    more than ``tolerance`` beyond the group's first one. Gives an array of
    structs (head, n). ``items`` are the positions of one key, a bounded list
    such as the words of a page."""
    empty = F.array().cast("array<struct<head:double,n:int>>")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        starts = last.isNull() | (x - last["head"] > tolerance)
        return F.when(starts, F.concat(acc, F.array(F.struct(x.alias("head"), F.lit(1).alias("n"))))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["head"].alias("head"), (last["n"] + 1).alias("n")))))

    return df.groupBy(*by).agg(F.array_sort(F.collect_list(items.cast("double"))).alias("_x")).select(*by, F.aggregate("_x", empty, step).alias(name))


def bounded_batches(sizes: Column, most_items: int, most_size: int) -> Column:
    """Batch number, from 1, of each size in an array: a batch closes before an
    item that would exceed either bound; an oversized item is a batch alone."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(1).alias("k"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("s"))

    def step(a, x):
        x = x.cast("long")
        full = (a["n"] > 0) & ((a["n"] >= most_items) | (a["s"] + x > most_size))
        k = F.when(full, a["k"] + 1).otherwise(a["k"])
        return F.struct(F.concat(a["out"], F.array(k)).alias("out"), k.alias("k"), F.when(full, 1).otherwise(a["n"] + 1).alias("n"), F.when(full, x).otherwise(a["s"] + x).alias("s"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def page_ranges(df: DataFrame, by: Sequence[str], page: str, name: str = "pages") -> DataFrame:
    """``1-3,5`` of the distinct pages of a key: islands by page less rank."""
    pages = df.select(*by, page).distinct()
    w = Window.partitionBy(*by).orderBy(page)
    islands = pages.withColumn("_i", F.col(page) - F.row_number().over(w)).groupBy(*by, "_i").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return islands.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", shown.alias("s")))), lambda x: x["s"]), ",").alias(name))


def page_pairs(df: DataFrame, by: Sequence[str], order: Sequence[str], long: Column, name: str = "page") -> DataFrame:
    """Pages of cards in order: a long card takes one alone, short ones share
    one by two, and a long card closes an open page."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_long", F.when(long, 1).otherwise(0)).withColumn("_run", F.sum("_long").over(upto))
    in_run = Window.partitionBy(*by, "_run", "_long").orderBy(*order)
    d = d.withColumn("_new", F.when(F.col("_long") == 1, 1).otherwise(F.when(F.row_number().over(in_run) % 2 == 1, 1).otherwise(0)))
    return d.withColumn(name, F.sum("_new").over(upto)).drop("_long", "_run", "_new")


def bounding_box(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def alignment(x0: Column, x1: Column, width: Column) -> Column:
    """left, center or right by the margins of a line on its page."""
    left, right = x0, width - x1
    return F.when((F.abs(left - right) <= width * 0.08) & (left > width * 0.15), "center").when((right < width * 0.12) & (left > width * 0.45), "right").otherwise("left")


def route_of_page(chars: Column, quality: Column, images: Column, ink: Column) -> Column:
    """Class of a page by its text, image coverage and ink."""
    good = (chars >= 12) & (quality >= 0.55)
    return F.when(good & (images < 0.35), "text").when(good, "mixed").when((images >= 0.45) | (ink >= 0.002), "scan").otherwise("blank")
