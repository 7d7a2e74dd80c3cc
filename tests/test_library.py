"""The library on small made-up rows: units, text, cards, layout, files, streams."""

import io
import zipfile
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dossier.functions import dims, ids, text, units
from dossier.operators import blocks as B
from dossier.operators import cards, compare, evidence, export, extract, layout, order, rules, state, translate
from dossier.sources import files, formats, sinks
from dossier.streaming import progress


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "value,unit,want",
    [
        ("1.82", "m3/h", ("1820", "L/h", "")),
        ("1.5-2.0", "m³/h", ("1500-2000", "L/h", "")),
        ("3 to 4", "L/min", ("180-240", "L/h", "")),
        ("7", "gpm", ("7", "gpm", units.REVIEW[1])),
        ("n/a", "L/h", ("n/a", "L/h", units.REVIEW[1])),
        ("1,200.50", "LPH", ("1200.5", "L/h", "")),
    ],
)
def test_flow(spark, value, unit, want):
    r = one(spark, units.normalize_flow(F.col("v"), F.col("u")), v=value, u=unit)
    assert (r.value, r.unit, r.note_en) == want


@pytest.mark.parametrize(
    "value,unit,want",
    [
        ("34.00", "bar abs", ("3.4", "MPa", units.ABSOLUTE[1])),
        ("48.6", "bar g", ("48.6", "bar.g", "")),
        ("500", "kPa", ("0.5", "MPa", units.NO_BASIS[1])),
        ("2", "kg/cm2 g", ("1.96", "bar.g", "")),
        ("-2", "kg/cm2a", ("-0.19", "MPa", units.ABSOLUTE[1])),
        ("5", "psi", ("5", "psi", units.REVIEW[1])),
    ],
)
def test_pressure(spark, value, unit, want):
    r = one(spark, units.normalize_pressure(F.col("v"), F.col("u")), v=value, u=unit)
    assert (r.value, r.unit, r.note_en) == want


def test_text_functions(spark):
    v = lambda e, s: one(spark, e(F.col("s")), s=s)
    assert v(text.fold_space, " a \t b ") == "a b"
    assert v(text.join_cjk, "泵 体 ab 泵") == "泵体 ab 泵"
    assert v(text.display_width, "ab泵") == 4
    assert [v(text.is_placeholder, x) for x in ("11-P-XXXX-01", "TBD", "", "P-?", "P-101")] == [True, True, True, True, False]
    assert v(text.tags, "pump P-101 and 12-P-7/A, V-3; P-101 p-xx-1") == ["P-101", "12-P-7/A"]
    assert v(lambda c: text.page_list(c, F.lit(9)), "1-3,7,9-,2,-2,x") == [1, 2, 3, 7, 9]
    assert v(text.column_number, "$AA$7") == 27 and one(spark, text.column_letters(F.col("n")), n=703) == "AAA"
    assert v(lambda c: text.truncated(c, 4), "abcdef") == "abc…"
    assert one(spark, text.value_in_text(F.col("a"), F.col("b")), a="b; c", b="A  c b") is True
    assert abs(v(text.entropy, "aabb") - 1.0) < 1e-12
    rows = spark.createDataFrame([("P-10",), ("P-2",), ("无位号泵-1",)], "tag string").withColumn("card", F.lower("tag"))
    assert [r.tag for r in cards.in_natural_order(rows).orderBy("place").collect()] == ["P-2", "P-10", "无位号泵-1"]


CAND = "tag string, name string, value string, unit string, ord long, source_row string, ref string, verified boolean, confidence double"


def test_cards(spark):
    rows = [
        ("P-1", "density", "980", "kg/m3", 1, "a", "r1", True, 0.9),
        ("p-1", "density", "1000", "kg/m3", 2, "b", "r2", True, 0.8),
        ("P-1", "density", "980 ", "KG/M3", 3, "b", "r3", True, 0.7),
        ("P-1", "fluid_name", "water", "", 4, "a", None, False, 0.4),
        ("P-1", "quantity", "2", "", 5, "a", "r5", True, 0.9),
        ("P-1", "spare", "1", "", 6, "a", "r6", True, 0.9),
        (None, "density", "1", "", 7, "c", "r7", True, 0.9),
        (None, "density", "1", "", 8, "d", "r8", True, 0.9),
    ]
    normal = cards.normalised(cards.card_key(spark.createDataFrame(rows, CAND)))
    v = cards.values(normal)
    f = cards.fields(v)
    got = {(r.card, r.field): r for r in f.collect()}
    assert len(got) == 3 * len(dims.CARD_FIELDS)
    assert got["p-1", "density"].status == dims.CONFLICT and got["p-1", "density"].display == "980 kg/m3；1000 kg/m3"
    assert got["p-1", "fluid_name"].status == dims.LOW_CONFIDENCE and got["p-1", "others"].status == dims.EXTRACTED
    assert got["p-1", "others"].display == "quantity: 2；spare: 1" and got["p-1", "viscosity"].status == dims.MISSING
    assert got["p-1", "tag_no"].display == "P-1" and got["无位号泵-c", "tag_no"].status == dims.MISSING
    i = cards.issues(f, normal)
    codes = {(r.card, r.code) for r in i.collect()}
    assert ("p-1", "field_value_conflict") in codes and ("p-1", "duplicate_tag_merged") in codes
    s = cards.statistics(f, i).first()
    assert (s.n_cards, s.n_untagged, s.n_conflicts, s.n_merged) == (3, 2, 1, 1)


def test_blocks(spark):
    d = spark.createDataFrame([("d", "one\r\n\n two  2  last"), ("e", ""), ("f", None)], "document_id string, text string")
    assert [tuple(r) for r in B.blocks(d).select("block_id", "line", "original_text").orderBy("block_id").collect()] == [("d_b00001", 1, "one"), ("d_b00002", 3, "two 2"), ("d_b00003", 4, "last")]
    assert one(spark, ids.document_id(F.col("s")), s="A\\b.TXT") == one(spark, ids.document_id(F.col("s")), s="a/B.txt")


def test_extraction(spark):
    b = spark.createDataFrame(
        [
            ("d1", 1, "d1_b1", "Metering pump P-3 / P-4 density: 998 kg/m3 suction pressure 2 bar abs", 0.9),
            ("d1", 2, "d1_b2", "Rated capacity = 1.5 - 2.0 m3/h Fluid: sour water Material: SS 316L", 0.9),
            ("d2", 1, "d2_b1", "Discharge pressure: 500 kPa", 0.9),
            ("d3", 1, "d3_b1", "nothing at all", 0.9),
            ("d4", 1, "d4_b1", "P-9 suction pressure 2 kg/cm2", 0.9),
        ],
        "document_id string, text_order int, block_id string, original_text string, confidence double",
    )
    c, issues = extract.candidates(b)
    got = {(r.document_id, r.tag, r.name): (r.value, r.unit) for r in c.collect()}
    assert got["d1", "P-3", "density"] == ("998", "kg/m3") and got["d1", "P-4", "suction_pressure"] == ("2", "bar abs")
    assert got["d1", "P-4", "rated_capacity"] == ("1.5 - 2.0", "m3/h") and got["d1", "P-3", "fluid_name"] == ("sour water", "")
    assert got["d1", "P-3", "material"] == ("SS 316L", "") and got["d2", None, "discharge_pressure"] == ("500", "kPa")
    assert not any(k[0] in ("d3", "d4") and k[2] == "suction_pressure" for k in got)
    assert {(r.document_id, r.code) for r in issues.collect()} == {("d1", "shared_multi_tag_parameters_require_confirmation"), ("d2", "untagged_pump_requires_confirmation")}
    assert one(spark, extract.group_tag(F.col("s")), s="0-P-000ABC") == "0-P-000A/B/C"
    assert [one(spark, extract.pair_tag(F.col("s")), s=x) for x in ("P-1001 A/B", "p1001A, B", "P-1001A & P-1001B", "P-1001")] == ["P-1001A/B"] * 3 + [None]
    m = one(spark, extract.materials(F.col("s")), s="Casing: A216 | Plunger: ceramic\nValve seat: 316")
    assert m == {"casing": "A216", "plunger": "ceramic", "valve seat": "316"}


def test_summary_table(spark):
    grid = {1: {1: "Tag", 2: "Pump", 3: "Capacity", 4: "Discharge", 5: "Material", 6: "Qty"}, 2: {2: "Type", 3: "m3/h", 4: "Pressure"}, 3: {1: "XX", 2: "plunger", 3: "3", 4: "5", 5: "SS", 6: "2"}, 4: {2: "gear", 3: "4", 4: "6", 5: "CS"}, 5: {1: "note"}}
    cells = spark.createDataFrame([("t", r, c, v) for r, row in grid.items() for c, v in row.items()], "table string, row int, col int, text string")
    lay = extract.summary_layout(cells, ["table"])
    assert {r["class"]: (r["depth"], r["col"]) for r in lay.collect()} == {"tag": (2, 1), "type": (2, 2), "capacity": (2, 3), "pressure": (2, 4), "material": (2, 5), "quantity": (2, 6)}
    got = extract.summary_rows(cells, lay, ["table"])
    assert {(r["row"], r["class"], r["text"]) for r in got.collect()} >= {(3, "capacity", "3"), (4, "type", "gear")} and got.where("row = 5").count() == 0


def test_layout(spark):
    w = spark.createDataFrame([(1, float(t)) for t in (0, 2, 4, 5, 9)], "k int, top double")
    assert [(x.head, x.n) for x in layout.anchored_groups(w, ["k"], F.col("top"), 3.0).first().groups] == [(0.0, 2), (4.0, 2), (9.0, 1)]
    assert one(spark, layout.bounded_batches(F.col("a"), 2, 10), a=[6, 5, 4, 1, 20, 1]) == [1, 2, 2, 3, 4, 5]
    c = spark.createDataFrame([(i, x) for i, x in enumerate([False, False, False, True, False])], "i int, long boolean").withColumn("g", F.lit(1))
    assert [r.page for r in layout.page_pairs(c, ["g"], ["i"], F.col("long")).orderBy("i").collect()] == [1, 1, 2, 3, 4]
    p = spark.createDataFrame([(1, x) for x in (3, 1, 2, 5, 5)], "k int, p int")
    assert layout.page_ranges(p, ["k"], "p").first().pages == "1-3,5"
    t = spark.range(500).withColumn("v", F.col("id") % 7)
    assert [r.place for r in order.rank_by_range(t, ["v", "id"], "place").orderBy("v", "id").collect()] == list(range(1, 501))
    assert order.running_total(t, ["id"], "v", "s").where("id = 499").first().s == sum(i % 7 for i in range(500))


def test_comparison_and_state(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert {r.k: r.state for r in compare.three_way(a, b, "k", "v").collect()} == {1: "missing", 2: "changed", 3: "same", 4: "extra"}
    assert sorted(map(tuple, compare.upsert(a, b, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, None), (4, "w")]
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, None), (1, 5, None), (2, 1, None)], "k int, o int, f string")
    assert sorted((r.k, r.o) for r in state.changes(e, "k", ["o"], F.col("f")).collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]
    s = spark.createDataFrame([(1, "success"), (1, "blocked"), (1, "blocked"), (2, "success")], "r int, status string")
    assert {r.r: (r.status, r.n_stages) for r in state.roll_up(s, ["r"], "status").collect()} == {1: ("blocked", 2), 2: ("success", 1)}
    left = spark.createDataFrame([(1, 5, "L"), (1, 1, "M"), (2, 9, "N")], "k int, t int, n string")
    right = spark.createDataFrame([(1, 2, "r2"), (1, 5, "r5"), (3, 1, "q")], "k int, u int, m string")
    assert {r.n: r.m for r in evidence.closest_before(left, right, ["k"], "t", "u", ["m"]).collect()} == {"L": "r5", "M": None, "N": None}


def test_rules(spark):
    d = spark.createDataFrame([(1, "x\nmail a.b@example.com\napi_key = ABCDEFGH12\n10.0.0.1 a.b@example.com")], "k int, t string")
    got = {r.rule: (r.n, r.first_line) for r in rules.scan(d, "k", "t").collect()}
    assert got == {"email": (2, 2), "secret_field": (1, 3), "ipv4": (1, 4)}


def test_translation(spark):
    d = spark.createDataFrame([("The pump and pump casing of P-101-A at 5 bar",)], "t string")
    out = translate.replace_terms(d, "t", [("pump", "泵"), ("pump casing", "泵体"), ("A", "x")]).first().translated
    assert out == "The 泵 and 泵体 of P-101-x at 5 bar"
    p = translate.protect(d, "t")
    assert translate.restore(p, "protected").first().restored == d.first().t and "P-101-A" not in p.first().protected
    texts = spark.createDataFrame([(x,) for x in ("a", "b", "bad", "", "a")], "text string")

    def shout(batch):
        if "bad" in batch:
            raise RuntimeError("no")
        return [x.upper() for x in batch]

    got = {r.source: (r.target, r.error) for r in translate.translated(texts, shout).collect()}
    assert got == {"a": ("A", None), "b": ("B", None), "bad": (None, "RuntimeError")}
    g = spark.createDataFrame([("Pump", "泵", "term")], "source string, target string, kind string")
    c = spark.createDataFrame([("valve seat", "阀座")], "source string, target string")
    s = spark.createDataFrame([("pump",), ("Valve  seat",), ("new words here",), ("12",)], "original string")
    assert {r.original: r.translation_source for r in translate.resolved(s, g, c).collect()} == {"pump": "glossary", "Valve  seat": "cache", "new words here": "pending", "12": "unchanged"}


def docx(paragraphs, rows):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    t = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p}<w:tbl>{t}</w:tbl></w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    book = sinks.workbook({"Cards & more": spark.createDataFrame([("P-1", 5, None), ("P-2", None, [1, 2])], "tag string, n int, l array<int>")})
    (tmp_path / "a.txt").write_bytes("泵\n\nP-101".encode("gb18030"))
    (tmp_path / "b.xlsx").write_bytes(book)
    (tmp_path / "c.docx").write_bytes(docx(["one", " "], [["x", "y"], ["", "z"]]))
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4\nstream\n" + zlib.compress(b"BT (Tag \\(P-7\\)) Tj [(Fl) 3 (ow)] TJ ET") + b"\nendstream")
    (tmp_path / "e.pdf").write_bytes(b"not a pdf")
    (tmp_path / "f.bin").write_bytes(b"?")
    (tmp_path / "~$b.xlsx").write_bytes(b"lock")
    (tmp_path / "g.txt").write_bytes(b"\n \n")
    docs = files.documents(spark, str(tmp_path)).cache()
    status = {r.file_name: r.parse_status for r in docs.collect()}
    assert status == {"a.txt": "success", "b.xlsx": "success", "c.docx": "success", "d.pdf": "success", "e.pdf": "failed", "f.bin": "skipped", "g.txt": "low_quality"}
    got = {}
    for r in files.blocks(docs).orderBy("document_id", "text_order").collect():
        got.setdefault(r.file_name, []).append((r.type, r.text))
    assert got["a.txt"] == [("paragraph", "泵"), ("paragraph", "P-101")]
    assert got["d.pdf"] == [("page_text", "Tag (P-7) Flow")]
    assert ("table_row", "x | y") in got["c.docx"] and ("table_row", "z") in got["c.docx"]
    assert [x for x in got["b.xlsx"] if x[0] == "table_row"] == [("table_row", "tag | n | l"), ("table_row", "P-1 | 5"), ("table_row", "P-2 | [1,2]")]
    assert files.listing(spark, str(tmp_path)).count() == 7
    with pytest.raises(ValueError):
        sinks.workbook({"t": spark.range(5)}, most_rows=4)


def test_export(spark):
    d = spark.createDataFrame([(1, "b", 2, "x"), (1, "a", 1, "y"), (1, "b", 1, "z")], "k int, s string, o int, t string")
    assert export.grouped_report(d, "k", "s", ["o"], F.col("t")).first().report == "[a] y\n[b] z | x"


def test_streams(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), i % 2, "ab"[i // 3 % 2], 1.0, "{}") for i in range(12)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, progress.EVENT).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(progress.EVENT).parquet(src)
    q = progress.changes(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    batch = state.changes(spark.createDataFrame(rows, progress.EVENT), "user_id", ["ts", "event_id"], F.col("event_type"))
    assert sorted(r.event_id for r in spark.table("changes").collect()) == sorted(r.event_id for r in batch.collect())
    seen = []
    q, failed = progress.in_batches(stream, lambda df, n: seen.extend(r.event_id for r in df.collect()), str(tmp_path / "c2"), most_rows=5)
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == list(range(12)) and not failed


def test_failing_rows_are_put_aside_alone(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(i, at, 1, "a", 1.0, "{}") for i in range(200)] + [(-1, at, 1, "a", 1.0, "{}")] * 2
    src, aside = str(tmp_path / "in"), str(tmp_path / "aside")
    spark.createDataFrame(rows, progress.EVENT).repartition(3).write.parquet(src)
    seen = []

    def handle(df, _):
        got = [r.event_id for r in df.collect()]
        if -1 in got:
            raise ValueError("bad row")
        seen.extend(got)

    q, failed = progress.in_batches(spark.readStream.schema(progress.EVENT).parquet(src), handle, str(tmp_path / "c"), most_rows=150, aside=aside)
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == list(range(200)) and [(f[1], f[2]) for f in failed] == [("bad row", aside)] * 2
    assert [r.event_id for r in spark.read.parquet(aside).collect()] == [-1, -1]


def test_stalls_stream(spark, tmp_path):
    src = tmp_path / "in"
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    src.mkdir()
    stream = spark.readStream.schema(progress.EVENT).parquet(str(src))
    q = progress.stalls(stream, seconds=600, delay="1 minute").writeStream.format("memory").queryName("stalls").option("checkpointLocation", str(tmp_path / "c")).start()
    for rows in ([(1, at(0), 1, "a", 1.0, ""), (2, at(1), 2, "a", 1.0, "")], [(3, at(30), 2, "a", 1.0, "")], [(4, at(31), 2, "a", 1.0, "")]):
        spark.createDataFrame(rows, progress.EVENT).coalesce(1).write.mode("append").parquet(str(src))
        q.processAllAvailable()
    q.stop()
    assert 1 in {r.user_id for r in spark.table("stalls").collect()}


def test_queries_have_sql():
    from dossier.plans import catalogue

    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 60


def test_package(spark):
    from dossier.operators import package

    a = spark.createDataFrame([("x", b"1"), ("y", b"2"), ("z", b"3")], "path string, content binary")
    b = spark.createDataFrame([("y", b"2"), ("z", b"4"), ("w", b"5")], "path string, content binary")
    assert {r.path: r.state for r in package.integrity(package.inventory(a), package.inventory(b)).collect()} == {"x": "missing", "y": "ok", "z": "content_changed", "w": "new"}
    s = package.files_signature(package.inventory(a).withColumn("g", F.lit(1)), ["g"]).first().signature
    assert s == package.files_signature(package.inventory(a.orderBy(F.desc("path"))).withColumn("g", F.lit(1)), ["g"]).first().signature
    names = spark.createDataFrame([(1, "A?.txt"), (2, "a_.TXT"), (3, "...")], "i int, n string")
    assert [r.artifact for r in package.artifact_names(names, "n", ["i"]).orderBy("i").collect()] == ["A_.txt", "a_-2.TXT", "file"]
    assert [one(spark, package.safe_path(F.col("p")), p=x) for x in ("a/b.txt", "../a", "C:/x", "a/NUL.txt", "/a", "")] == [True, False, False, False, False, False]
    box = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 20.0, 5.0))], "a struct<x0:double,top:double,x1:double,bottom:double>, b struct<x0:double,top:double,x1:double,bottom:double>")
    assert box.select(package.overlap_share(F.col("a"), F.col("b")).alias("x")).first().x == 0.25


def test_archives(spark, tmp_path):
    from dossier.sources import archives

    def packed(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, d in files.items():
                z.writestr(n, d)
        return out.getvalue()

    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"Author\0me") + chunk(b"zTXt", b"Note\0\0" + zlib.compress(b"deep"))
    deep = packed({"d.zip": packed({"e.zip": packed({"f.txt": "too deep"})})})
    (tmp_path / "a.zip").write_bytes(packed({"b.txt": "bee", "c.zip": deep, "p.png": png}))
    (tmp_path / "bad.zip").write_bytes(b"??")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.note) for r in archives.texts(spark, str(tmp_path)).collect()}
    assert got["a.zip!b.txt"] == ("bee", "") and got["a.zip!p.png"] == ("Author: me\nNote: deep", "")
    assert got["bad.zip"] == ("", "not_an_archive") and got["a.zip!c.zip!d.zip!e.zip"] == ("", "archive_too_deep")


def test_parameter_rows_and_their_issues(spark):
    fields = spark.createDataFrame([("c", "C", "tag_no", "extracted"), ("c", "C", "density", "extracted"), ("c", "C", "viscosity", "missing")], "card string, tag string, field string, status string")
    values = spark.createDataFrame([("c", "density", "1", "kg/m3", 2, True, True, 0.9), ("c", "density", "2", None, 1, False, False, None)], "card string, field string, value string, unit string, n_sources long, has_ref boolean, verified boolean, confidence double")
    rows = export.parameters(fields, values)
    got = {(r.field, r.value): (r.unit, r.n_sources, r.evidence_verified, r.issue) for r in rows.collect()}
    assert got == {
        ("tag_no", "C"): ("", 0, "", None),
        ("density", "1"): ("kg/m3", 2, "yes", None),
        ("density", "2"): ("", 1, "no", "f_parameter_without_source"),
        ("viscosity", ""): ("", 0, "", "f_field_without_values"),
    }
    found = spark.createDataFrame([("c", "density", "field_value_conflict", "high_risk", "i1")], "card string, field_name string, code string, severity string, issue_id string")
    issues = export.issue_rows(found, rows).collect()
    assert sorted((r.field_name, r.code, r.review_action) for r in issues) == [("density", "f_parameter_without_source", "confirm"), ("density", "field_value_conflict", "confirm"), ("viscosity", "f_field_without_values", "confirm")]
    assert export.parameters(fields.limit(0), values).count() == 0


def test_repeated_candidates_give_the_same_cards(spark):
    """Equal candidates counted first, values carried by fields: the same rows as one by one, and nothing is joined or dealt but by candidates, card and numbers."""
    rows = [(t, n, v, u, k, f"s{k % 2}" if t != "q-9" else "s", "r" if k % 3 else None, k % 4 > 0, k / 100) for k, (t, n, v, u) in enumerate([("Q-1", "suction_pressure", "3", "psi"), ("q-1", "suction_pressure", "3", "psi"), ("Q-1", "suction_pressure", "3", "PSI"), ("Q-1", "density", "9", "kg/m3"), ("Q-1", "density", "9", "kg/m3"), ("q-9", "spare", "1", None), ("q-9", "quantity", "1", "")] * 3)]
    c = cards.card_key(spark.createDataFrame(rows, CAND))
    plain = cards.values(cards.normalised(c))
    counted = cards.values(cards.normalised(cards.repeated(c), numbers_of=c))
    assert sorted(map(str, counted.collect())) == sorted(map(str, plain.collect()))
    f = cards.fields(counted, keep=True)
    params = lambda df: sorted(map(str, df.collect()))
    assert params(export.parameters(f)) == params(export.parameters(f, plain))
    got = {(r.card, r.code) for r in cards.issues(f, c).collect()}
    assert ("q-1", "pressure_value_or_unit_unrecognized") in got and ("q-1", "duplicate_tag_merged") in got and ("q-9", "duplicate_tag_merged") not in got
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 2
