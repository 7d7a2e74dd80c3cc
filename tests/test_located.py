"""Translations for values: every value with every segment, in plain loops, against the joins."""

import random
import re

from dossier.functions import dims
from dossier.operators import located

LEVELS = located.LEVELS
VALUES = "value_id long, source_ord int, field string, other_name string, original_value string, value_cn string, files array<string>, page string, sheet string, cell string, paragraph string"
SEGMENTS = "seg_ord long, files array<string>, page string, sheet string, cell string, paragraph string, original string, translation string"


def name(path):
    return (path or "").strip().replace("\\", "/").lower().rstrip("/").rsplit("/", 1)[-1]


def coordinate(v, level):
    t = (v or "").strip().lower()
    if level == "cell":
        t = t.replace("$", "")
    number = re.search("[0-9]+", t) if level == "page" else None
    return number[0] if number else t


def evidence(t):
    return re.sub(r"[ \t\r\n\f]+", " ", t or "").strip().lower()


def shown(field, original, translation):
    t = (translation or "").strip()
    if not re.search("[一-鿿]", t):
        return ""
    for label in dims.TRANSLATED_LABELS.get(field, ()):
        m = re.search(rf"(?i)(?:^|[|；;\n])\s*{label}\s*[:：=]\s*([^|；;\n]+)", t)
        if m:
            return m[1].strip()
    if len(t) > 160 or t.count("|") > 1 or re.search(r"(?i)\b(?:TAG\s*(?:NO)?|MODEL|STANDARD)\b", t) or ("型号" in t and "model" not in original.lower()):
        return ""
    return re.sub(r"\s+", " ", t)


def plain(values, segments):
    out = {}
    for v in sorted(values, key=lambda v: (v[0], v[1])):
        ident, source, field, other, original, cn, files, *place = v
        out.setdefault(ident, (cn, None, None))
        key = other if field == "others" else field
        if out[ident][2] is not None or (key not in dims.TRANSLATABLE_OTHERS if field == "others" else field not in ("pump_type", "fluid_name", "wetted_parts_material")):
            continue
        if ident in done(out):
            continue
        for s in sorted(segments):
            at, sfiles, *splace, text, translation = s
            if not {name(f) for f in files} & {name(f) for f in sfiles} - {""}:
                continue
            pairs = [(coordinate(a, x), coordinate(b, x)) for a, b, x in zip(place, splace, LEVELS)]
            if any(a and b and a != b for a, b in pairs):
                continue
            a, b = evidence(original), evidence(text)
            if not a or not b or (a not in b and b not in a):
                continue
            new = shown(key, original, translation)
            if not new:
                continue
            old = (cn or "").strip()
            body = old.split("：", 1)[1].strip() if field == "others" and "：" in old else old
            tight = lambda t: re.sub(r"\s+", "", t)
            kept = bool(re.search("[一-鿿]", body)) and tight(body) in tight(new)
            rests = not kept or tight(body) == tight(new)
            value = cn if kept else f"{dims.TRANSLATABLE_OTHERS[other]}：{new}" if field == "others" else new
            out[ident] = (value, source if rests else None, at if rests else None)
            seen.add(ident)
            break
    return out


seen: set = set()


def done(_):
    return seen


def rows(seed, n, m):
    r = random.Random(seed)
    words = ["steel", "model", "water", "ss", "a", "316", "pump", "水泵"]
    some = lambda k: " ".join(r.choice(words) for _ in range(k))
    place = lambda: (r.choice([None, "", "1", "p. 2", "Page 1"]), r.choice([None, "S", "s "]), r.choice([None, "$A$1", "a1", "B2"]), r.choice([None, None, "3"]))
    files = lambda: r.sample(["x/F.xlsx", "f.XLSX", "G\\f.xlsx/", "g.pdf", None, ""], r.randint(0, 2))
    field = lambda: r.choice(["pump_type", "fluid_name", "wetted_parts_material", "others", "density"])
    values = []
    for k in range(n):
        one = (field(), r.choice(["driver", "service_name", "quantity", None]), some(r.randint(0, 3)).upper(), r.choice([None, "", "钢", "驱动方式：水", "水"]))
        values += [(k, s, *one, files(), *place()) for s in range(r.randint(1, 3))]
    told = lambda: r.choice(["", "no", "介质：水 ", "备注;材质= 钢|x", "驱动 MODEL", "型号 水", "水", "  钢\n 铁", "用途：；x", "泵" * 161, "a|b|水"])
    segments = [(k, files(), *place(), some(r.randint(0, 4)), told()) for k in range(m)]
    return values, segments


def test_every_value_with_every_segment(spark):
    for seed, n, m in ((1, 120, 60), (2, 40, 200), (3, 30, 0), (4, 0, 30)):
        values, segments = rows(seed, n, m)
        seen.clear()
        got = located.apply_translations(spark.createDataFrame(values, VALUES), spark.createDataFrame(segments, SEGMENTS)).collect()
        assert {r.value_id: (r.value_cn, r.source_ord, r.seg_ord) for r in got} == plain(values, segments), seed


def test_no_nested_loops(spark):
    values, segments = rows(5, 20, 20)
    plan = located.first_translations(spark.createDataFrame(values, VALUES), spark.createDataFrame(segments, SEGMENTS))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contained_texts(spark):
    r = random.Random(8)
    text = lambda: "".join(r.choice("abc é") for _ in range(r.randint(0, 7)))
    small, large = [(r.choice("xy"), text()) for _ in range(80)], [(r.choice("xy"), text() + text()) for _ in range(80)]
    got = located.containing(spark.createDataFrame(small, "k string, t string"), spark.createDataFrame(large, "k string, t string"), ["k"]).collect()
    assert sorted(map(tuple, got)) == sorted({(k, s, t) for k, s in small for g, t in large if k == g and s and t and s in t})


def best(values, segments):
    out = {}
    for ident, source, _, _, original, _, files, *place, aliases in values:
        if source:
            continue
        for at, sfiles, *splace, text, translation in sorted(segments):
            pairs = [(coordinate(a, x), coordinate(b, x)) for a, b, x in zip(place, splace, LEVELS)]
            if not {name(f) for f in files} & {name(f) for f in sfiles} - {""} or any(a and b and a != b for a, b in pairs) or not (translation or "").strip():
                continue
            t, v = evidence(text), evidence(original)
            score = 2 + 6 * bool(t and v and v in t) + 4 * any(a and evidence(a) and evidence(a) in t for a in aliases or [])
            if score >= 6 and score > out.get(ident, (0,))[0]:
                out[ident] = (score, at, translation.strip())
    return out


def test_best_translations(spark):
    r = random.Random(12)
    for seed, n, m in ((6, 120, 80), (7, 30, 0)):
        values, segments = rows(seed, n, m)
        values = [(*v, r.choice([None, [], ["Pump", "ss"], ["water", ""], ["model  316"]])) for v in values]
        df = spark.createDataFrame(values, f"{VALUES}, aliases array<string>").where("source_ord = 0")
        got = located.best_translations(df, spark.createDataFrame(segments, SEGMENTS)).collect()
        want = best(values, segments)
        assert {x.value_id: (x.score, x.seg_ord, x.translation) for x in got} == want
    assert {s for s, *_ in best(*[[(*v, ["Pump"]) for v in rows(6, 120, 80)[0]], rows(6, 120, 80)[1]]).values()} == {6, 8, 12}


def test_few_segments_need_no_grams(spark, monkeypatch):
    """The segments of a file are looked through where they are few; grams, a
    hundred rows a text and place, are left for files with more than ``MOST``."""
    values, segments = rows(9, 60, 60)
    named = [(*v, ["Pump", "ss"]) for v in values]
    df, told = spark.createDataFrame(named, f"{VALUES}, aliases array<string>"), spark.createDataFrame(segments, SEGMENTS)
    used = []
    containing = located.containing
    monkeypatch.setattr(located, "containing", lambda *a: used.append(1) or containing(*a))
    want = plain(values, segments) if not seen.clear() else None
    for most, grams in ((1024, False), (20, True), (0, True)):
        monkeypatch.setattr(located, "MOST", most, raising=False)
        used.clear()
        got = located.apply_translations(df, told).collect()
        assert {r.value_id: (r.value_cn, r.source_ord, r.seg_ord) for r in got} == want
        found = located.best_translations(df.where("source_ord = 0"), told).collect()
        assert {x.value_id: (x.score, x.seg_ord, x.translation) for x in found} == best(named, segments)
        assert bool(used) == grams
