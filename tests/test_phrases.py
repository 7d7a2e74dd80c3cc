"""Dictionaries against plain versions: collapsed words, terms, lines by rule, masked tokens."""

import random
import re

from pyspark.sql import functions as F

from dossier.operators import phrases

WORDS = "VENDOR FURNISHED FURNISH BACK PRESSURE VALVE POSITIVE DISPLACEMENT PUMPS PUMP CONTROLLED CONTROL VOLUME WITH TO OR ED EN DO VEND SEAL".split()


def segmented(token, words):
    if token in words or len(token) < 8:
        return None
    best = [None] * len(token) + [(0, [])]
    for start in range(len(token) - 1, -1, -1):
        for end in range(start + 2, len(token) + 1):
            if token[start:end] in words and best[end] is not None:
                score = (end - start) ** 2 + best[end][0]
                if best[start] is None or score > best[start][0]:
                    best[start] = (score, [token[start:end], *best[end][1]])
    return best[0][1] if best[0] and len(best[0][1]) > 1 else None


def test_compounds(spark):
    r = random.Random(3)
    tokens = {"".join(r.choice(WORDS) for _ in range(r.randint(1, 6))) + r.choice(["", "", "X"]) for _ in range(300)} | {"PUMP", "", "A", "VALVE" * 400, "ENENENENEN"}
    words = spark.createDataFrame([(w,) for w in WORDS] + [(None,), ("A",)], "word string")
    got = phrases.compounds(spark.createDataFrame([(t,) for t in tokens] + [(None,), ("VALVE" * 400,)], "token string"), words)
    assert {x.token: x.parts for x in got.collect()} == {t: p for t in tokens if (p := segmented(t, set(WORDS)))}
    assert phrases.compounds(spark.createDataFrame([("VALVEPUMP",)], "token string"), words.limit(0)).count() == 0


def test_spaced(spark):
    rows = [(1, "VENDORFURNISHEDBACK-PRESSUREVALVE"), (2, "API675POSITIVEDISPLACEMENTPUMPS-CONTROLLEDVOLUME"), (3, " p-101A \n x"), (4, None), (5, "WITHE-SEALVALVE"), (6, "VALVEPUMP VALVEPUMPS QVALVEPUMP")]
    got = phrases.spaced(spark.createDataFrame(rows, "k int, t string"), "k", "t", spark.createDataFrame([(w,) for w in WORDS], "word string"))
    assert {x.k: x.spaced for x in got.collect()} == {
        1: "VENDOR FURNISHED BACK-PRESSURE VALVE", 2: "API 675 POSITIVE DISPLACEMENT PUMPS-CONTROLLED VOLUME", 3: "p-101A x", 4: "", 5: "WITH E-SEAL VALVE" if segmented("SEALVALVE", set(WORDS)) else "", 6: "VALVE PUMP VALVE PUMPS QVALVEPUMP",
    }


def replaced(text, terms):
    """Longest first, one after the other; targets have no letters, so none is replaced again."""
    t = " ".join((text or "").split())
    for source, target in sorted(terms.items(), key=lambda x: (-len(x[0]), x[0].upper())):
        t = re.sub(rf"(?<![A-Za-z0-9]){re.escape(source)}(?![A-Za-z0-9])", target.replace("\\", "\\\\"), t, flags=re.I)
    return re.sub(r"(?<=[一-鿿]) (?=[一-鿿])", "", t)


TERMS = {"pump": "泵", "pump type": "泵类型", "type of": "型的", "seal": "密封", "a/b pump": "甲乙泵", "m": "米", "valve body": "阀体", "body": "体", "no.": "号", "flow rate": "流量$1\\", "x y z": "三"}


def test_terms_replaced(spark):
    r = random.Random(4)
    parts = ["pump", "PUMP", "type", "of", "seal", "a/b", "m", "m3", "valve", "body", "no.", "no", "flow", "rate", "x", "y", "z", "pumps", "-", "é", "(pump)"]
    rows = [(k, r.choice([" ", " ", "  ", "\n"]).join(r.choice(parts) for _ in range(r.randint(0, 14)))) for k in range(300)] + [(900, None), (901, ""), (902, "pump " * 300)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "k int, t string, tokens string").repartition(3)
    terms = spark.createDataFrame([*TERMS.items(), ("PUMP", "泵鿿"), (None, "x"), ("", "y"), ("rate", None)], "source string, target string")
    got = {x.k: x.replaced for x in phrases.replaced(df, "k", "t", terms).collect()}
    assert got == {k: replaced(t, TERMS) for k, t in rows}
    assert phrases.replaced(df.limit(3), "k", "t", terms.limit(0)).count() == 3


EXACT = {"NOTES": "备注", "SEAL PLAN": "密封方案", "YES": "是"}
LABELS = {"SERVICE": "用途", "PUMP TYPE": "泵型"}


def by_rule(text):
    t = " ".join((text or "").split())
    if not t:
        return ""
    value = lambda v: EXACT.get(v.upper()) or replaced(v, TERMS) if v else ""
    if t.upper() in EXACT:
        return EXACT[t.upper()]
    for pattern, shape in ((r"-\s*(.+)", "- {}"), (r"(\d+)\s+(.+)", "{} {}")):
        m = re.fullmatch(pattern, t)
        if m and m.groups()[-1].upper() in EXACT:
            return shape.format(*m.groups()[:-1], EXACT[m.groups()[-1].upper()])
    m = re.fullmatch(r"(.+?):\s*(.*)", t)
    if m and m[1].strip().upper() in LABELS:
        return f"{LABELS[m[1].strip().upper()]}：{value(m[2].strip())}"
    for pattern, shape in ((r"page\s+(\d+)\s+of\s+(\d+)", "第 {} 页，共 {} 页"), (r"contract\s+no\.?:?\s*(.*)", "合同号：{}"), (r"doc\.\s*no\.?:?\s*(.*)", "文件号：{}"), (r"rev\.?:?\s*(.*)", "版本：{}"), (r"class:?\s*(.*)", "等级：{}")):
        m = re.fullmatch(pattern, t, flags=re.I)
        if m:
            return shape.format(*(g.strip() for g in m.groups())).rstrip("：")
    for head, target in phrases.HEADS:
        if t.upper().startswith(head + " "):
            tail = t[len(head) :].strip(" :")
            return f"{target}：{value(tail)}" if tail else target
    if re.match(phrases.CODE, t):
        return t
    if ":" in t:
        left, right = t.split(":", 1)
        return f"{by_rule(left)}：{value(right.strip())}".strip()
    return value(t)


def test_lines_by_rule(spark):
    lines = ["notes", "- Seal  plan", "-yes", "3 NOTES", "3 pump", "Service: seal plan", "service :", "Service:", "PUMP TYPE: type of pump", "page 2 of 10", "Page 2 of 10 pumps", "Contract No. 12", "contract no", "Doc. No: ", "rev. B", "review", "class: 1", "Class 150 pump",
             "Document Type: pump", "site seal", "Site:", "P-101/A", "12 A", "pump: seal: body", "notes: yes", "rev: x", "- yes: pump", "seal pump", "", None, "  ", "pump", ": x", "a/b pump type of", "unknown words"]
    dictionary = lambda d: spark.createDataFrame([*d.items()], "source string, target string")
    df = spark.createDataFrame(list(enumerate(lines)), "k int, t string").repartition(3)
    got = {x.k: x.translated for x in phrases.translate_lines(df, "k", "t", dictionary(EXACT), dictionary(LABELS), dictionary(TERMS)).collect()}
    assert got == {k: by_rule(t) for k, t in enumerate(lines)}


def test_masks_and_small_rules(spark):
    rows = [("pump P-101A/B to API 682 at 50 Hz and 12.5 bar, é5V",), ("",), ("API-610, API-610",), ("TKN",)]
    df = spark.createDataFrame(rows, "t string").select("t", phrases.masked(F.col("t")).alias("m")).select("*", "m.*", phrases.unmasked(F.lower("m.masked"), F.col("m.tokens")).alias("back"))
    got = df.collect()
    assert [x.tokens for x in got] == [["P-101A/B", "API 682", "50 Hz", "12.5 bar"], [], ["API-610", "API-610"], []]
    assert got[0].masked == "pump TKN0000X to TKN0001X at TKN0002X and TKN0003X, é5V" and got[2].masked == "TKN0000X, TKN0001X"
    assert got[0].back == "pump P-101A/B to API 682 at 50 Hz and 12.5 bar, é5v"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(phrases.latin_words(F.lit("use it's API 610 at P-1/A"))) == ["use", "it's", "at"]
    assert [one(phrases.is_short_code(F.lit(t))) for t in ("NPSH", "A.B. C", "AB CD EF", "AB CD EF GH", "a", "D.O.Name", "A.B.")] == [True, False, True, False, False, True, True]
    assert one(phrases.corrected(F.lit("Train doc. no"), F.lit("列车 博士编号"))) == "线文件号" and one(phrases.corrected(F.lit("x"), F.lit("列车"))) == "列车"


def test_marks_by_plain_loops(spark):
    r = random.Random(8)
    kept = "|".join(phrases.KEPT)
    parts = ["pump", "P-1/A", "A-TKN0001X", "TKN0001X", "tkn0000x", "TKN00000X", "Tkn0000x", "API 682", "12.5 bar", "%", "é5", "V", "\x01", " ", " ", "-", "mm", "m³/h", "7", "10-B"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(400)] + ["A-TKN0001X at 50 Hz", "5V " * 10_050, "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("*", phrases.masked(F.col("t")).alias("m")).select("*", phrases.unmasked(F.col("m.masked"), F.col("m.tokens")).alias("back"))
    for x in df.collect():
        if x.t is None:
            assert x.m.masked is None and x.back is None
            continue
        tokens = [m[0] for m in re.finditer(kept, x.t)]
        number = iter(range(len(tokens)))
        assert x.m.tokens == tokens and x.m.masked == re.sub(kept, lambda m: f"TKN{next(number):04d}X", x.t), x.t
        put = lambda m: tokens[int(m[0][3:-1])] if int(m[0][3:-1]) < len(tokens) else m[0]
        assert x.back == re.sub(r"TKN(\d{4}|[1-9]\d{4,8})X|tkn(\d{4}|[1-9]\d{4,8})x", put, x.m.masked), x.t


def test_term_protect_searches_once(spark, tmp_path):
    from dossier.plans import phrase_queries as Q

    spark.createDataFrame([(1, "A-TKN0001X at 50 Hz"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 2, 3, 4, 5.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = Q.term_protect(spark, str(tmp_path))
    assert {x.id: (x.tokens, x.n_tokens, x.whole) for x in got.collect()} == {"d1": ("A-TKN0001X\n50 Hz", 2, True), "d2": ("", 0, True), "l-1-2-3-4": ("P-3/4\nAPI 4\n50 Hz", 3, True)}
    # in each of two tables one search, and the way of texts with an edge
    assert got._jdf.queryExecution().optimizedPlan().toString().count("NACE") <= 6
