"""The pipeline, stage by stage and whole, against plain versions on a small corpus."""

import random
import re

import pytest
from test_brute_force import brute_fingerprint, brute_removed, components, crc, encode_all, lower, raw

import corpus_pipeline

WORDS = {"en": ["the", "thing", "with", "other", "between", "should"], "de": ["und", "nicht", "schön", "über", "straße", "werden"]}


def corpus():
    r = random.Random(11)
    say = lambda lang, n: " ".join(r.choice(WORDS[lang]) + str(r.randint(0, 400)) for _ in range(n))
    item = say("en", 14)
    passage = say("en", 40)
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        text = say(lang, r.randint(20, 90))
        if i % 7 == 0:
            text = say(lang, 5) + " " + passage + " " + text
        if i in (10, 20):
            text += " " + item
        rows.append((i, text, lang, f"s{i % 2}", len(text)))
    rows += [(60, rows[4][1], "en", "s0", 0), (61, rows[5][1] + " ", "en", "s0", 0), (62, "1234 ... 99", None, "s1", 0), (63, None, "en", None, 0), (64, say("en", 3000), "en", "s0", 0)]
    return rows, [(0, item), (1, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def expected():
    rows, items = corpus()
    texts = {i: t for i, t, *_ in rows if re.search(r"[^\W\d_]", t or "")}
    yield dict(texts)
    groups = components({i: brute_fingerprint(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    yield dict(texts)
    gone = brute_removed({i: raw(t) for i, t in texts.items()}, 100)
    texts = {i: bytes(b for b, g in zip(raw(t), gone[i]) if not g).decode("utf-8", "ignore") for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if t}
    yield dict(texts)
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(raw(t)))
    grams = {tuple(w[k : k + 10]) for _, t in items for w in [words(t)] for k in range(len(w) - 9)}
    texts = {i: t for i, t in texts.items() if not any(tuple(w[k : k + 10]) in grams for w in [words(t)] for k in range(len(w) - 9))}
    yield dict(texts)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected()):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        got = {r.doc_id: r.text for r in docs.collect()}
        assert got == want, name


def test_run(spark, folder):
    *_, texts = expected()
    ids = encode_all("word_bpe_49k.json", texts.items(), 1)
    got = corpus_pipeline.run(spark, folder).collect()
    want = {(i, k, crc(x[s : s + 4096])) for i, x in ids.items() for k, s in enumerate(range(0, len(x), 4096))}
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in got} == want
    assert len({r.sequence_id for r in got}) == -(-sum(map(len, ids.values())) // 4096)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language id", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]


def test_repeated_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 6")
    kept = corpus_pipeline.near_dedup(spark, docs.union(docs), folder)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(6))


def test_null_and_repeated_ids(spark, folder):
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(WORDS["en"]) + str(r.randint(0, 400)) for _ in range(n))
    a, b, c, d, e = (say(60) for _ in range(5))
    rows = [(None, a), (None, b), (7, c), (7, d), (8, e), (None, e), (None, a), (9, c), (3, d + " "), (3, d)]
    # c stays under 7; of d's copies the smallest id is 3, with two texts: one stays
    want = {(None, a), (None, b), (7, c), (8, e)}
    seen = set()
    for given in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        kept = [(x.doc_id, x.text) for x in corpus_pipeline.near_dedup(spark, docs, folder).collect()]
        assert len(kept) == len(set(kept)) == 5 and want < set(kept) and {(i, t.strip()) for i, t in set(kept) - want} == {(3, d)}
        seen.add(frozenset(kept))
    assert len(seen) == 1

    (_, item), _ = corpus()[1]
    rows = [(None, a), (None, b + " " + item), (7, c), (7, item + " " + d), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(x.doc_id, x.text) for x in corpus_pipeline.decontaminate(spark, docs, folder).collect()}
    assert kept == {(None, a), (7, c), (None, None)}


CLASHES = ["d", "h", "score", "chunk", "n_bytes", "data", "sizes", "lang_pred", "languages", "other_share", "row_hash", "rest", "fp", "first", "at", "got", "a.b", "tick`s"]


def test_every_stage_on_awkward_tables(spark, folder):
    """Null and repeated ids, equal rows, null and blank texts, clashing columns; then no rows at all."""
    from pyspark.sql import functions as F

    r = random.Random(6)
    say = lambda n: " ".join(r.choice(WORDS["en"]) + str(r.randint(0, 400)) for _ in range(n))
    a, b, c, d = (say(70) for _ in range(4))
    rows = [(None, a), (None, b), (5, c), (5, d), (5, d), (6, None), (7, ""), (8, " 12 \n")]
    docs = spark.createDataFrame([(i, t, None, "s", 0, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, void string").repartition(3)
    docs = docs.withColumn("map", F.create_map(F.lit("k"), F.col("source")))
    for k, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.coalesce("doc_id", F.lit(0)).cast("string")) if k % 2 else F.lit(k))
    words = {(None, a), (None, b), (5, c), (5, d)}
    trained = docs.union(spark.createDataFrame([(i, say(70), "en", "s", 0, None, {"k": "s"}, *docs.select(*(F.col("`" + n.replace("`", "``") + "`") for n in CLASHES)).first()) for i in range(100, 110)], docs.schema))
    # as the label is no input of a prediction, rows without one are judged like the others
    got = corpus_pipeline.language_id(spark, trained, folder).where("doc_id is null or doc_id < 100")
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted([*words, (5, d)], key=str)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["simhash near-dedup"](spark, docs, folder).collect()
    assert sorted(((x.doc_id, x.text) for x in kept), key=str) == sorted([*words, (6, None), (8, " 12 \n")], key=str)
    kept = stages["suffix-array dedup"](spark, docs, folder)
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted([*words, (8, " 12 \n")], key=str)
    assert all(x.n_chars == len(x.text) and x["a.b"] == docs.first()["a.b"] for x in kept.collect())
    kept = stages["benchmark decontamination"](spark, docs, folder).collect()
    assert len(kept) == len(rows)
    pieces = stages["best-fit packing"](spark, docs, folder).collect()
    assert len(pieces) == len(rows) and all(crc(x.ids) == x.ids_crc32 and len(x.ids) == x.length for x in pieces)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0, name
        assert name == "best-fit packing" or (out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()), name


def test_no_labelled_row(spark, folder):
    """Nothing to learn a language from is no reason to drop everything."""
    docs = spark.createDataFrame([(1, "the thing", None), (2, "12 34", None), (3, None, None), (4, "über", None)], "doc_id long, text string, lang string")
    assert sorted(x.doc_id for x in corpus_pipeline.language_id(spark, docs, folder).collect()) == [1, 4]


def test_only_the_result_stays(spark, folder):
    from dossier.llm import scratch

    before = scratch.written(spark)
    corpus_pipeline.run(spark, folder)
    assert len(scratch.written(spark)) == len(before) + len(corpus_pipeline.STAGES)
