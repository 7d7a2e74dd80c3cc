"""Text queries over small tables that hold what the driver tables lack."""

import random

from dossier.plans import package_queries as P
from dossier.plans import text_queries as Q


def folder(spark, base, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{base}/{name}.parquet")
    return str(base)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_doc_language_sees_the_whole_text(spark, tmp_path):
    texts = {1: "a" * 5000 + "я" * 5000, 2: "a" * 4000 + "я" * 40_000, 3: "a" * 9000, 4: "1", 5: "я 1", 6: "a" * 50_000 + "я"}
    d = folder(spark, tmp_path, documents=([(i, t, None, "s", len(t)) for i, t in texts.items()], DOCS))
    assert {r.doc_id: r.language for r in Q.doc_language(spark, d).collect()} == {1: "mixed", 2: "mixed", 3: "en", 4: "unknown", 5: "ru", 6: "mixed"}


def test_best_translation_takes_all_turns(spark, tmp_path):
    r = random.Random(4)
    items = [(i, None if i == 9 else "x" * r.randint(0, 40)) for i in range(60)]
    turns = [(i, t, None if (i, t) == (5, 2) else "y" * r.randint(0, 40)) for i in range(70) for t in range(5) if i % 20 != 13]
    d = folder(spark, tmp_path, benchmark=(items, "item_id long, text string"), conversations=(turns, "conv_id long, turn long, text string"))
    want = set()
    for i, a in items:
        met = [(2 + 6 * (len(b) % 7 == len(a) % 7) + 4 * (len(b) > len(a)), -c, -t) for c, t, b in turns if a is not None and b is not None and c % 20 == i % 20]
        if met and max(met)[0] >= 6:
            s, c, t = max(met)
            want.add((i, s, -c, -t))
    assert any(t > 1 for *_, t in want)
    assert sorted(map(tuple, Q.best_translation(spark, d).collect())) == sorted(want)


def test_first_match_makes_no_pairs(spark, tmp_path, capsys):
    docs = [(i, None, None, None if i % 10 == 0 else f"s{i % 3}", 40 * (i % 2) + i % 4) for i in range(60)] + [(99, None, None, "alone", 1)]
    d = folder(spark, tmp_path, documents=(docs, DOCS), labels=([(i, 1 - (i % 5 == 4)) for i, *_ in docs], "doc_id long, toxic int"))
    want = {i: min((o for o, _, _, t, m in docs if t == s and m % 40 == n % 40 and o != i), default=None) if s else None for i, _, _, s, n in docs if i % 5 != 4}
    found = Q.first_match(spark, d)
    assert {r.doc_id: r.other_id for r in found.collect()} == want
    found.explain("extended")
    plan = capsys.readouterr().out.split("== Physical Plan ==")[0]
    # what meets the labelled documents is one row per source and class
    assert "other_id" in plan and "NOT (other_id" not in plan


def test_denylist_holds_every_run(spark, tmp_path):
    item = "one two three four five six seven"
    docs = {1: "x one two three four five y", 2: "say Two three, four five six!", 3: "three four five six seven", 4: "one two three four six seven", 5: item}
    d = folder(spark, tmp_path, benchmark=([(1, item), (2, "one two"), (3, None)], "item_id long, text string"), documents=([(i, t, None, "s", len(t)) for i, t in docs.items()], DOCS))
    assert {r.doc_id: r.n_denied for r in Q.denylist_scan(spark, d).collect()} == {1: 1, 2: 1, 3: 1, 5: 3}


def test_no_row_is_left_out(spark, tmp_path):
    d = folder(spark, tmp_path, lineitem=([(1, n, n + 10, n + 20) for n in range(1, 8)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"), orders=([(i,) for i in range(1, 16)], "o_orderkey long"))
    assert {r.l_linenumber: r.tags for r in Q.tag_tokens(spark, d).collect()} == {n: f"P-{n + 10},A/P-{n + 20}" for n in range(1, 8)}
    assert {r.o_orderkey: r.message for r in P.failure_lines(spark, d).collect()} == {i: f"ValueError: order {i} in <path> is bad" for i in range(1, 16)}


def test_column_letters_beyond_three(spark):
    from pyspark.sql import functions as F

    from dossier.functions import text

    def letters(n):
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(65 + k) + out
        return out

    at = [1, 26, 27, 52, 53, 702, 703, 18278, 18279, 30000, 475254, 475255, 1_200_000]
    df = spark.createDataFrame([(n,) for n in at], "n long").select("n", text.column_letters(F.col("n")).alias("l")).select("*", text.column_number(F.concat(F.lit("$"), "l", F.lit("$7"))).alias("back"))
    assert {r.n: (r.l, r.back) for r in df.collect()} == {n: (letters(n), n) for n in at}


def test_tags_by_their_parts(spark):
    from pyspark.sql import functions as F

    from dossier.functions import text

    r = random.Random(5)
    parts = ["P", "P", "XX", "X", "XXX", "N", "A", "12", "TBD", "p", "PX", "XXA", "ABCDEF", "ABCDEFG", "123456789", "-", "-", "-", "/", "/", " ", ",", "\n", "é", "ß", "?", "*"]
    words = ["P-1", "a/p-2/B", "XX-P", "P-XX-1", "n/a", "v-12", "P/P", "12-P", "P-P-P-P-P-P", "ABCDEFG-P", "P-123456789"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 16))) for _ in range(2000)] + ["".join(r.choice(words) + r.choice([" ", ", ", "-", "é"]) for _ in range(8)) for _ in range(500)] + ["P-1\n", "XX-P-1", "a/p-1, P-1/a, P-XX-1 N/A P-", "", None]
    plain = r"(?:^|[^A-Z0-9])([A-Z0-9]{1,6}(?:[-/][A-Z0-9]{1,8}){1,4})(?=$|[^A-Z0-9/-])"
    want = F.array_distinct(F.filter(F.regexp_extract_all(F.upper("t"), F.lit(plain), 1), text.is_pump_tag))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.tags(F.col("t")).alias("tags"), want.alias("want"))
    rows = got.collect()
    assert [x for x in rows if x.tags != x.want] == [] and sum(len(x.tags or ()) > 1 for x in rows) > 20
    # a text is split by no pattern, which every row would compile again
    assert "split(" not in got.select("tags")._jdf.queryExecution().optimizedPlan().toString()


def test_denied_digests_what_is_marked(spark, tmp_path):
    from hashlib import sha256

    from pyspark.sql import functions as F

    from dossier.operators import rules

    r = random.Random(6)
    texts = [r.choice(["", " ", "é"]).join(r.choice(["a ", "b, ", "C-", "d\n", "é", "1 "]) for _ in range(r.randint(0, 30))) for _ in range(300)] + ["", None, "a", "a b"]
    runs = lambda t, n: [" ".join(w[i : i + n]) for w in ["".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()] for i in range(len(w) - n + 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    bad = spark.createDataFrame([("a b c d a",), ("1 1 b",), ("x",), (None,)], "t string").select(rules.words(F.col("t")).alias("w"))
    marked = rules.word_runs(bad, "w", 2).union(rules.word_runs(bad, "w", 3)).distinct()
    listed = {(n, sha256(x.encode()).hexdigest()) for n in (2, 3) for t in ("a b c d a", "1 1 b") for x in runs(t, n)}
    assert {(x.size, x.digest) for x in marked.collect()} == listed
    want = {k: c for k, t in enumerate(texts) if (c := sum((n, sha256(x.encode()).hexdigest()) in listed for n in (2, 3) for x in runs(t, n)))}
    found = lambda d: {x.k: x.n_denied for x in rules.denied(docs, "k", "t", d, [2, 3]).collect()}
    assert found(marked) == found(marked.drop("mark")) == want and len(want) > 50
    # a run that only shares a mark with the list is not on it
    assert found(marked.withColumn("digest", F.sha2("digest", 256))) == {}
    d = folder(spark, tmp_path, benchmark=([(1, "one two three four five")], "item_id long, text string"), documents=([(1, "one two three four five", None, "s", 9)], DOCS))
    plan = Q.denylist_scan(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    # words are made once, and no digest is asked for below the join of marks
    assert "isnotnull(sha2" not in plan and "size(filter" not in plan and plan.count("Join LeftSemi") == 2
