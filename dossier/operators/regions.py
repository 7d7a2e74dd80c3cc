"""Rectangles on pages: words in regions, overlaps, page bounds, text regions.

Rectangle joins meet in grid cells. Every rectangle has a level, the power of
two that its longer side fits into, and covers at most four cells of its level,
whatever its size; the other side is looked up once for each level in use. A
point lies in one cell of a level, and a pair of rectangles counts in the cell
of its intersection's first corner, so nothing meets twice and no pairs are
formed beyond a cell. Words look through the regions of their page where these
are few, and take cells on other pages only: a row for each level is moved then.
Boxes are the columns x0, top, x1, bottom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import written

BOX = ("x0", "top", "x1", "bottom")
#: how far a word's centre may lie beside a region, and a box outside of a page or another
BESIDE, OUTSIDE, WITHIN = 1.0, 0.5, 1.5
#: the regions of a page that are held as one array
FEW = 64


def _level(margin: float) -> Column:
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")) + 2 * margin
    return F.greatest(F.ceil(F.log2(F.greatest(side, F.lit(1.0)))), F.lit(0)).cast("int")


def _cell(c: Column, level: Column) -> Column:
    return F.floor(c / F.pow(F.lit(2.0), level)).cast("long")


def _covered(df: DataFrame, level: Column, margin: float) -> DataFrame:
    """A row for each cell of ``level`` that the box covers."""
    at = df.withColumn("_level", level)
    x = F.sequence(_cell(F.col("x0") - margin, F.col("_level")), _cell(F.col("x1") + margin, F.col("_level")))
    y = F.sequence(_cell(F.col("top") - margin, F.col("_level")), _cell(F.col("bottom") + margin, F.col("_level")))
    return at.withColumn("_x", F.explode(x)).withColumn("_y", F.explode(y))


def words_in_regions(words: DataFrame, regions: DataFrame, page: str, margin: float = BESIDE) -> DataFrame:
    """Words (page, word columns, box) with the regions (page, region columns,
    box) that hold their centre. Column names other than page and box differ;
    boxes with a null or turned side hold nothing."""
    r = written(regions.where("x1 >= x0 and bottom >= top"), "regions")
    many = written(r.groupBy(page).agg(F.count("*").alias("n")).where(F.col("n") > FEW).select(page), "many")
    if many.isEmpty():
        return _looked_through(words, r, page, margin)
    near = _looked_through(words, r.join(many, page, "left_anti"), page, margin)
    return near.unionByName(_by_cells(words.join(many, page, "left_semi"), r.join(many, page, "left_semi"), page, margin))


def _looked_through(words: DataFrame, regions: DataFrame, page: str, margin: float) -> DataFrame:
    """Words with the regions of their page as an array: words are moved once, by page."""
    own = [c for c in regions.columns if c != page and c not in BOX]
    held = regions.groupBy(page).agg(F.collect_list(F.struct(*own, *BOX)).alias("_regions"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    inside = lambda g: cx.between(g["x0"] - margin, g["x1"] + margin) & cy.between(g["top"] - margin, g["bottom"] + margin)
    met = words.join(held, page).select(*words.columns, F.explode(F.filter("_regions", inside)).alias("_region"))
    return met.select(*words.columns, *(F.col(f"_region.{c}").alias(c) for c in own))


def _by_cells(words: DataFrame, regions: DataFrame, page: str, margin: float) -> DataFrame:
    """Words with the regions of pages that have any number of them."""
    r = written(_covered(regions, _level(margin), margin), "cells")
    levels = sorted(x[0] for x in r.select("_level").distinct().collect())  # powers of two
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    w = words.withColumns({"_cx": cx, "_cy": cy}).where("_cx is not null and _cy is not null").withColumn("_level", F.explode(F.lit(levels).cast("array<int>")))
    w = w.withColumns({"_x": _cell(F.col("_cx"), F.col("_level")), "_y": _cell(F.col("_cy"), F.col("_level"))})
    renamed = r.withColumnsRenamed({c: f"_r{c}" for c in BOX})
    met = w.join(renamed, [page, "_level", "_x", "_y"])
    inside = F.col("_cx").between(F.col("_rx0") - margin, F.col("_rx1") + margin) & F.col("_cy").between(F.col("_rtop") - margin, F.col("_rbottom") + margin)
    return met.where(inside).drop("_level", "_x", "_y", "_cx", "_cy", *(f"_r{c}" for c in BOX))


def overlaps(left: DataFrame, right: DataFrame, page: str, left_id: str, right_id: str) -> DataFrame:
    """(page, left_id, right_id, area) of boxes of both sides that share area."""
    sound = "x1 > x0 and bottom > top"
    l = left.where(sound).select(page, left_id, *BOX).withColumn("_own", _level(0))
    r = right.where(sound).select(page, right_id, *BOX).withColumn("_own", _level(0))
    levels = sorted({x[0] for side in (l, r) for x in side.select("_own").distinct().collect()})  # powers of two
    at = lambda d: _covered(d.withColumn("_at", F.explode(F.lit(levels).cast("array<int>"))).where("_at >= _own"), F.col("_at"), 0)
    a, b = at(l), at(r).withColumnsRenamed({**{c: f"_r{c}" for c in BOX}, "_own": "_rown"}).drop("_at")
    met = a.join(b, [page, "_level", "_x", "_y"]).where("_level = greatest(_own, _rown)")
    x0, top, x1, bottom = F.greatest("x0", "_rx0"), F.greatest("top", "_rtop"), F.least("x1", "_rx1"), F.least("bottom", "_rbottom")
    here = (_cell(x0, F.col("_level")) == F.col("_x")) & (_cell(top, F.col("_level")) == F.col("_y"))
    return met.where((x1 > x0) & (bottom > top) & here).select(page, left_id, right_id, ((x1 - x0) * (bottom - top)).alias("area"))


def within(inner: str, outer: str, margin: float = WITHIN) -> Column:
    """Whether a box column (a struct) lies in another."""
    i, o = (lambda c: F.col(f"{inner}.{c}")), (lambda c: F.col(f"{outer}.{c}"))
    return (i("x0") >= o("x0") - margin) & (i("x1") <= o("x1") + margin) & (i("top") >= o("top") - margin) & (i("bottom") <= o("bottom") + margin)


def boundary_violations(words: DataFrame, pages: DataFrame, page: str, order: str, word: str, samples: int = 12) -> DataFrame:
    """(page, n, sample) of pages with words beyond their bounds: how many, and the first of them."""
    bounds = pages.select(page, *(F.col(c).alias(f"_p{c}") for c in BOX))
    out = (F.col("x0") < F.col("_px0") - OUTSIDE) | (F.col("top") < F.col("_ptop") - OUTSIDE) | (F.col("x1") > F.col("_px1") + OUTSIDE) | (F.col("bottom") > F.col("_pbottom") + OUTSIDE)
    beyond = words.join(bounds, page).where(out).select(page, order, word)
    # the first of each task's rows, then of all: no page's words are held
    first = beyond.withColumn("_k", F.row_number().over(Window.partitionBy(page).orderBy(order))).where(F.col("_k") <= samples)
    counted = beyond.groupBy(page).agg(F.count("*").alias("n"))
    sample = first.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, word))), lambda x: x[word]).alias("sample"))
    return counted.join(sample, page)


def layout_strategy(tables: Column, cells: Column, table_area: Column, page_area: Column, vectors: Column, words: Column) -> Column:
    """``table`` where a page is mostly a form, else ``template``."""
    share = table_area / F.greatest(page_area, F.lit(1.0))
    form = ((cells >= 12) & (share >= 0.12)) | ((tables > 0) & (share >= 0.28)) | ((tables == 0) & (vectors >= 10) & (words >= 4))
    return F.when(form, "table").otherwise("template")


# fixed values: words that make a line a clause
CLAUSE = r"(?i)\b(?:shall|include|included|specified|provided|installed|recommended|submitted|required|quotation|approval)\b"


def stays_whole(line: Column, markers: list[str]) -> Column:
    """Whether a line of a table is one text: no form with two markers or more, but a bullet, small letters or a clause."""
    t = text.fold_space(line)
    n = sum((F.upper(t).rlike(rf"(?<![A-Z0-9])\Q{m}\E(?![A-Z0-9])").cast("int") for m in markers), F.lit(0))
    return (t == "") | ((n < 2) & (t.startswith("-") | t.rlike("[a-z]") | t.rlike(CLAUSE)))


def text_regions(held: DataFrame, by: list[str], order: str, word: str, tolerance: float = 2.2, gap: float = 16.0) -> DataFrame:
    """Text regions of the words of each region (``by``): lines of words whose
    tops lie within ``tolerance`` of the line's first, cut at gaps wider than
    ``gap``; with text and box, from left to right. Words without Latin letters
    alone make no region."""
    w = held.select(*by, F.struct("top", "x0", F.col(order).alias("o"), "x1", "bottom", F.col(word).alias("w")).alias("s"))
    sorted_ = w.groupBy(*by).agg(F.array_sort(F.collect_list("s")).alias("s"))
    start = F.struct(F.array().cast("array<int>").alias("line"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("head"))

    def step(a: Column, x: Column) -> Column:
        new = a["head"].isNull() | (F.abs(x["top"] - a["head"]) > tolerance)
        k = F.when(new, a["k"] + 1).otherwise(a["k"])
        return F.struct(F.concat(a["line"], F.array(k)).alias("line"), k.alias("k"), F.when(new, x["top"]).otherwise(a["head"]).cast("double").alias("head"))

    lines = sorted_.select(*by, F.explode(F.arrays_zip("s", F.aggregate("s", start, step)["line"].alias("line"))).alias("z")).select(*by, "z.line", "z.s.*")
    along = Window.partitionBy(*by, "line").orderBy("x0", "o")
    cut = F.when(F.lag("x1").over(along).isNull() | (F.col("x0") - F.lag("x1").over(along) > gap), 1).otherwise(0)
    chunk = F.sum("cut").over(along.rowsBetween(Window.unboundedPreceding, 0))
    parts = lines.withColumn("cut", cut).withColumn("chunk", chunk).groupBy(*by, "line", "chunk")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "o", "w"))), lambda x: x["w"]), " ")
    out = parts.agg(text.fold_space(told).alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    return out.where(F.col("text").rlike(text.LATIN) & ~text.has_cjk(F.col("text")))
