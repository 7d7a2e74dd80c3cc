"""Stage reuse and nested JSON against plain walks."""

import json
import random

from pyspark.sql import functions as F

from dossier.operators import reuse, trees


def test_staleness_spreads(spark):
    r = random.Random(6)
    n = 160
    edges = [(r.randrange(110), r.randrange(110)) for _ in range(100)] + [(3, 3), (None, 4), (4, None), (1, 2), (2, 1)] + [(k, k + 1) for k in range(120, 159)]
    stages = [(k, f"s{k}") for k in range(n)] + [(5, "s5")]
    previous = [(k, "old" if k in (17, 120) else f"s{k}", k != 33, "failed" if k == 40 else None if k == 41 else "success") for k in range(n) if k != 60]
    got = reuse.stage_reuse(
        spark.createDataFrame(stages, "stage int, signature string"), spark.createDataFrame(edges, "source int, target int"), spark.createDataFrame(previous, "stage int, signature string, outputs_exist boolean, status string")
    ).collect()
    own = {17: "signature_changed", 120: "signature_changed", 33: "outputs_missing", 40: "not_successful", 41: "not_successful", 60: "never_ran"}
    near = {k: (0, k) for k in own}
    front = dict(near)
    while front:
        new = {}
        for a, b in edges:
            if a in front and b is not None and b not in near:
                new[b] = min(new.get(b, (9999, 9999)), (front[a][0] + 1, front[a][1]))
        near |= new
        front = new
    want = {k: (k not in near, own.get(k, "upstream_stale" if k in near else ""), *near.get(k, (None, None))) for k in range(n)}
    assert len(got) == n and {x.stage: (x.reusable, x.reason, x.distance, x.root) for x in got} == want
    assert max(d for d, _ in near.values()) > 16


def pairs(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            if isinstance(v, str):
                yield path, k, v
            yield from pairs(v, f"{path}/{k}")
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from pairs(v, f"{path}/{k}")


def test_literal_pairs(spark):
    r = random.Random(9)

    def some(depth):
        kind = r.randrange(7 if depth else 4)
        if kind < 4:
            return r.choice(["x", "", "é\n", None, True, 3, 2.5, "long " * 20])
        return [some(depth - 1) for _ in range(r.randrange(4))] if kind == 4 else {r.choice(["a", "b c", "d.e", "f", "k" * 50, ""]): some(depth - 1) for _ in range(r.randrange(5))}

    rows = [(k, json.dumps(some(5), ensure_ascii=False)) for k in range(150)] + [(900, None), (901, "{no json"), (902, '"x"'), (903, "[]"), (904, "{}"), (905, json.dumps({"a": [[[[[[{"b": "deep"}]]]]]]}))]
    got = sorted(map(tuple, trees.literal_pairs(spark.createDataFrame([(*x, "c") for x in rows], "id int, doc string, path_ string"), ["id"], "doc").collect()))
    want = sorted((k, *p) for k, t in rows if t and t != "{no json" for p in pairs(json.loads(t)))
    assert got == want and len(got) > 50
    one = lambda t: spark.range(1).select(trees.is_long_text(F.lit(t))).first()[0]
    assert [one("a" * 45), one("a " * 9), one("ab cd ef gh ij kl mn"), one("  " + "a" * 44 + " ")] == [True, False, True, False]
