"""Rectangles against all pairs in plain loops."""

import random

from pyspark.sql import functions as F

from dossier.operators import regions

BOX = "x0 double, top double, x1 double, bottom double"


def boxes(r, n, sizes):
    out = []
    for k in range(n):
        x, y, s = r.uniform(-50, 600), r.uniform(-50, 900), r.choice(sizes)
        out.append((r.randrange(3), k, x, y, x + r.uniform(0, s), y + r.uniform(0, s)))
    return out


def test_words_in_regions(spark):
    r = random.Random(1)
    words = boxes(r, 300, [10, 40]) + [(0, 900, None, 0.0, 1.0, 1.0), (7, 901, 0.0, 0.0, 1.0, 1.0)]
    areas = boxes(r, 40, [1, 20, 300, 5000]) + [(0, 90, 9.0, 0.0, 1.0, 5.0), (1, 91, None, 0.0, 1.0, 1.0), (1, 92, -1e6, -1e6, 1e6, 1e6)]
    w, a = spark.createDataFrame(words, f"page int, word int, {BOX}"), spark.createDataFrame(areas, f"page int, region int, {BOX}")
    got = sorted((x.page, x.word, x.region) for x in regions.words_in_regions(w, a, "page").collect())
    want = []
    for p, k, x0, t, x1, b in words:
        for q, n, rx0, rt, rx1, rb in areas:
            if p == q and None not in (x0, rx0) and rx1 >= rx0 and rb >= rt and rx0 - 1 <= (x0 + x1) / 2 <= rx1 + 1 and rt - 1 <= (t + b) / 2 <= rb + 1:
                want.append((p, k, n))
    assert got == sorted(want) and len(got) > 50
    assert regions.words_in_regions(w, a.limit(0), "page").count() == 0


def test_overlaps(spark):
    r = random.Random(2)
    left, right = boxes(r, 120, [2, 60, 900]), boxes(r, 120, [2, 60, 900]) + [(0, 500, 5.0, 5.0, 5.0, 9.0)]
    got = regions.overlaps(spark.createDataFrame(left, f"page int, a int, {BOX}"), spark.createDataFrame(right, f"page int, b int, {BOX}"), "page", "a", "b").collect()
    want = {}
    for p, a, *u in left:
        for q, b, *v in right:
            w, h = min(u[2], v[2]) - max(u[0], v[0]), min(u[3], v[3]) - max(u[1], v[1])
            if p == q and w > 0 and h > 0:
                want[p, a, b] = w * h
    assert {(x.page, x.a, x.b): round(x.area, 6) for x in got} == {k: round(v, 6) for k, v in want.items()}
    assert len(got) == len(want) > 50


def test_page_bounds(spark):
    words = spark.createDataFrame([(1, k, f"w{k}", 0.0, 0.0, 100.4 + (k % 2), 5.0) for k in range(40)] + [(2, 0, "in", 0.0, 0.0, 1.0, 1.0), (3, 1, "out", -1.0, 0.0, 1.0, 1.0)], f"page int, k int, word string, {BOX}")
    pages = spark.createDataFrame([(p, 0.0, 0.0, 100.0, 50.0) for p in (1, 2, 3)], f"page int, {BOX}")
    got = {x.page: (x.n, x.sample) for x in regions.boundary_violations(words, pages, "page", "k", "word").collect()}
    assert got == {1: (20, [f"w{k}" for k in range(1, 25, 2)]), 3: (1, ["out"])}


def test_lines_of_a_region(spark):
    rows = [(1, 0, "Flow", 0, 10, 20, 18), (1, 1, "rate", 24, 11.5, 40, 19), (1, 2, "12", 90, 12, 100, 20), (1, 3, "m3/h", 104, 12.3, 120, 20), (1, 4, "Next", 0, 13, 20, 21), (2, 0, "12", 0, 0, 5, 5), (3, 0, "流", 0, 0, 5, 5), (3, 1, "a", 6, 0, 9, 5)]
    df = spark.createDataFrame([tuple(float(x) if k > 2 else x for k, x in enumerate(row)) for row in rows], f"region int, k int, word string, {BOX}")
    got = sorted((x.region, x.line, x.chunk, x.text, x.x0, x.top, x.x1, x.bottom) for x in regions.text_regions(df, ["region"], "k", "word").collect())
    assert got == [(1, 1, 1, "Flow rate", 0, 10, 40, 19), (1, 2, 1, "Next", 0, 13, 20, 21), (1, 2, 2, "m3/h", 104, 12.3, 120, 20)]


def test_rules_of_a_page(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    strategy = lambda *x: one(regions.layout_strategy(*map(F.lit, x)))
    assert [strategy(1, 12, 12.0, 100.0, 0, 0), strategy(1, 3, 28.0, 100.0, 0, 0), strategy(0, 0, 0.0, 100.0, 10, 4), strategy(1, 3, 12.0, 100.0, 50, 50), strategy(0, 0, 0.0, 0.0, 9, 9)] == ["table", "table", "table", "template", "template"]
    whole = lambda t: one(regions.stays_whole(F.lit(t), ["TAG NO", "FLOW", "A/B"]))
    assert [whole(t) for t in ("", "- X", "tag", "TAG NO 1 FLOW 2", "TAG NO 1", "AS SPECIFIED", "FLOWS A/B", "flow a/b")] == [True, True, True, False, False, True, False, False]
    inside = spark.createDataFrame([((1.0, 1.0, 5.0, 5.0), (2.0, 2.0, 4.0, 4.0)), ((0.0, 1.0, 5.0, 5.0), (2.0, 2.0, 4.0, 4.0))], f"a struct<{BOX.replace(' double', ': double')}>, b struct<{BOX.replace(' double', ': double')}>")
    assert [x[0] for x in inside.select(regions.within("a", "b")).collect()] == [True, False]


def test_few_regions_need_no_cells(spark, monkeypatch):
    """Words are moved once where a page has few regions, not once for each size of region."""
    r = random.Random(4)
    w = spark.createDataFrame(boxes(r, 200, [10, 40]), f"page int, word int, {BOX}")
    a = spark.createDataFrame([b for b in boxes(r, 60, [1, 20, 300, 5000]) if b[0] or b[1] < 15], f"page int, region int, {BOX}")
    used = []
    covered = regions._covered
    monkeypatch.setattr(regions, "_covered", lambda *x: used.append(1) or covered(*x))
    got = []
    for few, cells in ((64, False), (10, True), (0, True)):
        monkeypatch.setattr(regions, "FEW", few, raising=False)
        used.clear()
        got.append(sorted(tuple(x) for x in regions.words_in_regions(w, a, "page").select("page", "word", "region", "x0").collect()))
        assert bool(used) == cells
    assert got[0] == got[1] == got[2] and len(got[0]) > 50
