"""Each operator against a plain version on small tables with awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import types as T

from dossier.llm import decontam, langid, lm, packing, quality, simhash, suffix, tokenfile, urlfilter, warc
from dossier.llm.queries import vocabulary

WORDS = [b"alpha", b"beta", b"gamma", b"delta", b"eps", b"zeta", b"eta", b"theta", "naïve".encode(), "straße".encode(), b"A.B", b"x-y", b"Don't"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("shard", T.StringType())])


def corpus(seed=1, n=70):
    r = random.Random(seed)
    make = lambda k: " ".join(r.choice(WORDS).decode() for _ in range(k))
    common = make(60)
    texts = [None, "", " \n\t ", "x", "ab" * 400, "a" * 1000, "é" * 120, make(5000), "tab\tand nbsp  end \n", "<|endoftext|> # #", "!!! ???", "nul\0byte " * 40]
    for _ in range(n):
        t = make(r.randint(1, 120))
        if r.random() < 0.4:
            t = make(r.randint(0, 9)) + " " + common + "\n" + t
        texts.append(t)
    texts += [texts[20], texts[20] + " tail", texts[30].replace("alpha", "ALPHA")]
    rows = [(i * 3 % 101 + 200 * (i // 101), t, None if i % 9 == 0 else ("en", "de")[i % 2], None if i % 7 == 0 else "s", "clash", "clash") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def raw(t):
    return (t or "").encode()


def lower(b):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in b)


def test_quality(docs, empty):
    got = rows_of(quality.judge(docs))
    assert len(got) == len(corpus())
    for i, t, *_ in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = Counter(win)
        rep = len({k + j for k, x in enumerate(win) if c[x] > 1 for j in range(3)})
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, t and t[:50])
        assert r.base_failed == (want[0] < 50 or 100 * rep > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality.judge(empty).count() == 0


def test_quality_fences_reject_outliers(spark):
    plain = "The quick brown fox number {0} jumps over the lazy dog while {0} other animals watch from hill {0} "
    filler = " ".join(f"word{i}" for i in range(60))
    rows = [(i, plain.format(i) + filler, "en", "s") for i in range(200)] + [(999, "### ".join(f"w{i}" for i in range(80)), "en", "s")]
    got = rows_of(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert not got[999].kept and all(got[i].kept for i in range(200))


def test_language_mixtures(spark, empty):
    r = random.Random(3)
    en, de = ["the", "and", "thing", "with", "that", "other"], ["und", "nicht", "ein", "schön", "über", "straße"]
    say = lambda v, n: " ".join(r.choice(v) for _ in range(n))
    rows = [(i, say(en if i % 2 else de, 60), "en" if i % 2 else "de", "s") for i in range(200)]
    rows += [(500, say(en, 80) + " " + say(de, 40), None, None), (501, None, "en", None), (502, "123 ... !!", "en", None), (503, "xqzvkw jjqx zzkq wqxv " * 20, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = rows_of(langid.identify(df))
    assert len(got) == len(rows)
    held = [x for x in got.values() if x.held_out and x.doc_id < 200]
    assert held and all(x.lang_pred == ("en" if x.doc_id % 2 else "de") for x in held)
    for i, x in got.items():
        assert x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x.score <= 1
    mixed = {s.lang: s.share for s in got[500].languages}
    assert set(mixed) == {"en", "de"} and abs(mixed["en"] - 2 / 3) < 0.1 and got[500].lang_pred == "en"
    assert got[501].lang_pred == got[502].lang_pred == "und" and got[503].other_share > 0.5
    assert langid.identify(empty).count() == 0


def test_language_shares_do_not_see_labels(spark):
    df = spark.createDataFrame([(1, "hello there", None, "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"und"}


def plain_automaton(texts, k):
    """States are histories as tuples; arcs and failure arcs in dictionaries."""
    import math

    counts = Counter()
    for w in texts:
        line = ["<s>", *w]
        for size in (1, 2, 3):
            counts.update(tuple(line[i : i + size]) for i in range(len(line) - size + 1))
    total, known = sum(map(len, texts)), {x for w in texts for x in w}
    p1 = lambda x: ((counts[x,] if x in known else 0) + 1) / (total + len(known) + 1)
    p2 = lambda h, x: (counts[h, x] + k[0] * p1(x)) / (counts[h,] + k[0])
    p3 = lambda g, h, x: (counts[g, h, x] + k[1] * p2(h, x)) / (counts[g, h] + k[1])

    def walk(w):
        state, score = ("<s>",), 0.0
        for x in w:
            while state and not counts[*state, x]:
                score += math.log10(k[len(state) - 1] / (counts[state] + k[len(state) - 1]))
                state = state[1:]
            score += math.log10((p1, p2, p3)[len(state)](*state, x))
            state = (*state, x)[-2:] if state else ((x,) if x in known else ())
        return score

    return walk, total, known, p1


def check_lm(got, toks):
    import math

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    walk, n, known, p1 = plain_automaton([w for i, w in toks.items() if not held[i]], lm.K)
    for i, w in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(x in known for x in w), n)
        assert abs(r.base_score - sum(math.log10(p1(x)) for x in w)) < 1e-5
        assert abs(r.score - walk(w)) < 1e-5, i


def test_lm(docs, empty):
    check_lm(rows_of(lm.score(docs)), {i: lower(raw(t)).split() + [None] for i, t, *_ in corpus()})
    assert lm.score(empty).count() == 0


def test_lm_in_rounds(spark, monkeypatch):
    """A fan of 3 makes bundles of bundles of bundles."""
    monkeypatch.setattr(lm.chunks, "FAN", 3)
    rows = [(i, t) for i, t, *_ in corpus(8, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    assert lm.chunks.pack(df).count > 27
    check_lm(rows_of(lm.score(df)), {i: lower(raw(t)).split() + [None] for i, t in rows})


@pytest.mark.parametrize("stretch", [1, 5, 1000])
def test_lm_stretches(stretch, monkeypatch):
    import numpy as np

    monkeypatch.setattr(lm, "STRETCH", stretch)
    r = random.Random(2)
    texts = [[r.choice("abcde") for _ in range(r.randint(0, 40))] + [None] for _ in range(30)]
    data = [" ".join(w[:-1]).encode() for w in texts]
    tok, doc = lm.tokens(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    train = doc % 3 > 0  # the others bring words and pairs that training lacks
    pair, triple, later, starts = lm.ngrams(tok, doc)
    counts = [lm._distinct(k, n)[1] for k, n in ((tok, train), (pair, train), (triple, train[later]))]
    walk, total, known, _ = plain_automaton([w for i, w in enumerate(texts) if i % 3], lm.K)
    model = lm.Automaton(tok, doc, counts, len(known), total, lm.K)
    weight = model.walk(starts, np.append(starts[1:], len(tok)))
    for i, w in enumerate(texts):
        assert abs(weight[doc == i].sum() - walk(w)) < 1e-9


def brute_fingerprint(t):
    w = lower(raw(t)).split()
    if not w:
        return 0
    sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """fps: {id: fingerprint}."""
    least = {i: i for i in fps}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = list(fps)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return {i: find(i) for i in ids}


def test_simhash(docs, empty):
    got = rows_of(simhash.near_duplicates(docs))
    fps = {i: brute_fingerprint(t) for i, t, *_ in corpus()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == components(fps)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("dense", [2, 64])
def test_simhash_links(spark, dense):
    """Chains and crowds of fingerprints by either way give the components of all pairs."""
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(r.randint(0, 25)):
            x ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                x ^= 1 << r.randrange(64)
            fps.add(x)
            if r.random() < 0.2:
                x = b
    fps = sorted(fps)
    from dossier.llm.components import connected_components

    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    comp = {r.node: r.component for r in connected_components(simhash.links(df, dense=dense)).collect()}
    mine = {}
    for i, f in enumerate(fps):
        mine.setdefault(comp.get(simhash._signed(f), ("own", f)), set()).add(i)
    want = {}
    for i, c in components(dict(enumerate(fps))).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_decontamination(spark, docs, empty):
    rows = corpus()
    text = {i: t for i, t, *_ in rows}
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(raw(t)))
    long = [t for t in text.values() if t and len(words(t)) > 30]
    items = [(1, " ".join(long[0].split()[3:25])), (2, " ".join(long[1].split()[:10])), (10, "unheard of " * 9), (3, None), (4, ""), (5, "ZETA! eta"), (6, "nothing here"), (None, " ".join(long[2].split()[:12])), (1, " ".join(long[3].split()[:11]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontam.digest(decontam.contamination(docs, bench)))
    for i, t in text.items():
        w = words(t)
        hit, found = set(), set()
        for item, it in items:
            iw = words(it)
            n = min(10, len(iw))
            for k in range(len(iw) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[k : k + n]:
                        hit.update(range(p, p + n))
                        found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit)), i
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def brute_removed(texts, length):
    seen, out = set(), {}
    for i in sorted(texts):
        b = texts[i]
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        out[i] = bytes(gone)
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix(docs, empty, hot):
    texts = {i: raw(t) for i, t, *_ in corpus()}
    want = brute_removed(texts, 100)
    got = rows_of(suffix.dedup(docs, hot=hot))
    assert len(got) == len(texts)
    for i, b in texts.items():
        g, r = want[i], got[i]
        left = bytes(x for x, m in zip(b, g) if not m)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), sum(g), len(re.findall(b"\1+", g))), (i, b[:40])
        assert r.kept_sha256 == hashlib.sha256(left).hexdigest()
    assert suffix.dedup(empty).count() == 0


def test_suffix_in_rounds(spark, monkeypatch):
    """A fan of 3 makes bundles of bundles; many texts share passages, some stand whole in others."""
    monkeypatch.setattr(suffix.chunks, "FAN", 3)
    r = random.Random(9)
    make = lambda k: "".join(r.choice("abcdefghijklmnop ") for _ in range(k))
    shared = [make(r.randint(80, 400)) for _ in range(6)]
    texts = [make(r.randint(0, 200)) + r.choice(shared) + make(r.randint(0, 90)) + (r.choice(shared) if r.random() < 0.5 else "") for _ in range(60)] + shared * 2
    want = brute_removed({i: raw(t) for i, t in enumerate(texts)}, 100)
    for hot in (20_000, 2):
        got = rows_of(suffix.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(30), hot=hot))
        assert {i: x.n_removed for i, x in got.items()} == {i: sum(g) for i, g in want.items()}


@pytest.mark.parametrize("lone", ["hello " * 60, "-" * 200, "a" * 100_000, "rule\n" + "=-" * 90, "x" * 99 + "y" + "x" * 99, "é" * 80])
@pytest.mark.parametrize("others", [0, 20])
def test_suffix_one_span_is_left(spark, lone, others):
    """What is open after the filter may be a single span: it is merged with an empty shard."""
    r = random.Random(11)
    texts = dict(enumerate(["".join(r.choice("abcdefghijklmnop ") for _ in range(300)) for _ in range(others)] + [lone]))
    want = brute_removed({i: raw(t) for i, t in texts.items()}, 100)
    got = rows_of(suffix.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)))
    assert {i: (g.n_bytes, g.n_removed, g.n_spans) for i, g in got.items()} == {i: (len(raw(t)), sum(want[i]), len(re.findall(b"\1+", want[i]))) for i, t in texts.items()}


def test_suffix_anchor_stands_twice(spark):
    r = random.Random(5)
    make = lambda k: "".join(r.choice("abcdefghijklmnop") for _ in range(k))
    texts = []
    for k in range(40):
        p, line, q = make(70), make(36 + k % 30), make(100)
        pair = [p + line + line, p + line + q]
        texts += pair if k % 2 else pair[::-1]
    want = brute_removed({i: raw(t) for i, t in enumerate(texts)}, 100)
    got = rows_of(suffix.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    assert any(map(sum, want.values())) and {i: r.n_removed for i, r in got.items()} == {i: sum(g) for i, g in want.items()}


def test_merge_of_shard_transforms():
    import numpy as np

    r = random.Random(2)
    spans = [bytes(r.choice(b"ab") for _ in range(r.randint(8, 40))) for _ in range(30)]
    order = np.cumsum([0] + [len(s) + 50 for s in spans[:-1]])
    got = {(i, a + k) for i, a, n in suffix.repeated_windows(spans, order, 8) for k in range(n)}
    seen, want = set(), set()
    for i, s in enumerate(spans):
        for a in range(len(s) - 7):
            if s[a : a + 8] in seen:
                want.add((i, a))
            seen.add(s[a : a + 8])
    assert got == want


def encode_all(name, rows, end):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary(name))
    tk.encode_special_tokens = True
    return {i: [*tk.encode(t or "", add_special_tokens=False).ids, end] for i, t, *_ in rows}


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, empty):
    ids = encode_all("word_bpe_49k.json", corpus(), 1)
    got = packing.pack(docs, vocabulary("word_bpe_49k.json"), 1, with_ids=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert crc(r.ids) == r.ids_crc32
    assert {i: [x for r in sorted(p, key=lambda r: r.piece) for x in r.ids] for i, p in by.items()} == ids
    for i, p in by.items():
        assert [(r.piece, r.start, r.length) for r in sorted(p, key=lambda r: r.piece)] == [(k, k * 4096, min(4096, len(ids[i]) - k * 4096)) for k in range(-(-len(ids[i]) // 4096))]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) == -(-sum(map(len, ids.values())) // 4096)
    assert packing.pack(empty, vocabulary("word_bpe_49k.json"), 1).count() == 0


def test_packing_plan():
    r = random.Random(4)
    for _ in range(20):
        counts = Counter(r.choice([r.randint(1, 60), r.randint(1, 5)]) for _ in range(r.randint(0, 300)))
        bins, used = Counter(), Counter()
        for length, first, n, times, start, offset in packing.plan(dict(counts), 60):
            assert first == used[length]
            used[length] += n * times
            for t in range(times):
                assert bins[start + t] == offset
                bins[start + t] += n * length
        assert used == counts and all(v <= 60 for v in bins.values())
        assert packing.fullest({7: 2, 5: 1, 30: 4}, 19) == {7: 2, 5: 1}


def test_token_file(docs, empty, spark):
    ids = encode_all("byte_bpe_50k.json", corpus(), 2)
    base, manifest = tokenfile.write(docs, vocabulary("byte_bpe_50k.json"), 2, shard_bytes=4000, sequence=64)
    got = rows_of(tokenfile.read(spark, base))
    at = 0
    for i in sorted(ids):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids[i]), crc(ids[i])), i
        at += len(ids[i])
    assert manifest.count() > 3
    first = manifest.orderBy("shard").first()
    f = tokenfile.TokenFile(base, first.file)
    stream = [x for i in sorted(ids) for x in ids[i]]
    row, mask = f.row(1)
    assert row.tolist() == stream[64:128] and mask.all()
    base, _ = tokenfile.write(empty, vocabulary("byte_bpe_50k.json"), 2)
    assert tokenfile.read(spark, base).count() == 0


def test_encoder_cuts_as_the_tokenizer():
    import numpy as np

    from dossier.llm import encode

    r = random.Random(8)
    alphabet = ["a", "B", "é", "ß", " ", " ", "\n", ".", "'", "'s", "'re", "1", "«", "”", " ", "\t", "<|endoftext|>", "̸", "漢", "🙂", "_", "Σ"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(600)]
    for name, drop in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        e = encode.Encoder(vocabulary(name), drop)
        for _ in range(2):
            parts = [t.encode() for t in texts]
            offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids, at = e.encode(np.frombuffer(b"".join(parts), np.uint8), offs)
            for k, t in enumerate(texts):
                assert ids[at[k] : at[k + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


PAGES = [(1, "http://a/\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "u", ""), (5, "http://c", "x" * 70000), (6, "http://c", "x" * 70000), (7, "d", "solo"), (None, "e", "solo"), (None, "f", "own"), (9, "g", "q"), (9, "g", "q"), (9, "g", "x" * 70000), (0, "zero", "only zero"), (12, "z", "only zero")]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", __import__("pyspark").sql.functions.lit("clash"))
    base, manifest = warc.write(pages, shard_bytes=1000, roll_bytes=300)
    got = sorted(warc.read(spark, base).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.payload_bytes))
    assert len(got) == len(PAGES) and manifest.count() > 3
    owner = {}
    for i, _, h in PAGES:
        if i is not None:
            owner[h or ""] = min(i, owner.get(h or "", i))
    for r, (i, _, h) in zip(got, sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0, len(p[2] or "")))):
        h = h or ""
        data = h.encode()
        assert (r.page_id, r.payload_bytes, r.payload_digest) == (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        first = owner.get(h)
        assert (r.record_type, r.refers_to) == (("response", None) if first is None or first == i else ("revisit", first))
        if r.record_type == "response":
            assert bytes(r.payload) == data
    again, m2 = warc.write(pages.repartition(5), shard_bytes=1000, roll_bytes=300)
    assert sorted(map(tuple, m2.collect())) == sorted(map(tuple, manifest.collect()))
    assert warc.read(spark, warc.write(pages.limit(0))[0]).count() == 0


def test_urls(spark):
    rows = [
        (1, "http://x.example.com/en/1", None),
        (2, "https://EXAMPLE.com/en/7a?q#f", ""),
        (3, "http://other.io/a", "<link rel='canonical' href='http://x.example.com/en/1'>"),
        (4, "http://other.io/b#frag", '<meta http-equiv="refresh" content="0; url=http://other.io/a">'),
        (5, "http://mixed.io/", '<link href="http://example.com/en/7" rel=canonical>'),
        (6, "http://mixed.io/c", '<link rel="canonical" href="http://mixed.io/">'),
        (7, None, None),
        (8, "no scheme", "x"),
        (9, "http://a.com?x/en/", None),
        (10, "http://example.net/de/8", None),
        (11, "http://example.net/de/9", None),
        (12, "http://xcom/en/", None),
        (3, "http://other.io/a", "<link rel='canonical' href='http://x.example.com/en/1'>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://mixed.io/c", "http://x.org/es/1"), ("http://only.io/", "http://only.io/z"), (None, "x")], "src string, dst string")
    got = {}
    for r in urlfilter.judge(df, redirects=redirects).collect():
        got[r.page_id] = r
    assert [got[i].verdict for i in range(1, 13)] == ["block", "allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "block", "block", "allow"]
    assert (got[2].host, got[2].path, got[2].rule) == ("example.com", "/en/7a", "example.com/en/7")
    assert (got[9].host, got[9].path, got[7].host, got[8].path) == ("a.com", "", "", "")
    assert got[10].rule == "example.net/de/8" and got[11].rule == "net/de/" and got[3].by_alias and not got[1].by_alias
    many = [*urlfilter.RULES, *(("block", f"h{i}.zz", "/") for i in range(300))]
    same = {(r.page_id, r.rule, r.verdict) for r in urlfilter.judge(df, many, redirects).collect()}
    assert same == {(r.page_id, r.rule, r.verdict) for r in got.values()}
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_relative_links(spark):
    from urllib.parse import urljoin

    src = "https://Host.io:80/a/b/page?q=1#f"
    links = ["/en/7", "//other.io/x?y", "c", "c/d?e=http://z/", "./c", "../c", "../../../c", "..", ".", "?r", "?r/../s", "#g", "http://x.com/../k", "../c/./d/", "mailto:a@b"]
    df = spark.createDataFrame([(s, d) for s in (src, "http://bare.io", "http://bare.io?k") for d in links], "src string, dst string")
    for r in df.withColumn("got", urlfilter.resolved(df.src, df.dst)).collect():
        want = r.dst if ":" in r.dst.split("/")[0].split("?")[0] else urljoin(r.src, r.dst)
        # an empty path stands for "/"
        assert r.got.replace(".io?", ".io/?") == want.replace(".io?", ".io/?"), (r.src, r.dst)
    pages = [
        (1, "http://example.com/q/1", "<link rel=canonical href='/en/7'>"),
        (2, "http://m.io/a", '<meta http-equiv="refresh" content="0;url=//blocked.org/es/1">'),
        (3, "http://shop.org/x/y", "<link rel=canonical href='../es/2'>"),
        (4, "http://m.io/z", "<link rel=canonical href='a'>"),
        (5, "no scheme", "<link rel=canonical href='/a'>"),
    ]
    got = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.verdict, r.by_alias) for r in got} == {1: ("allow", True), 2: ("block", True), 3: ("block", True), 4: ("block", True), 5: ("allow", False)}


def test_links_of_a_page(spark):
    html = """<LINK REL="alternate canonical" hreflang=x href="http://a.io/1?x=1&amp;y=2">
      <link href='/2' data-rel=canonical rel="stylesheet"><link title="a > b" rel=canonical href=/3><link rel='canonicals' href=/no>
      <meta content="5; URL='http://a.io/&#52;&#x2F;&#X5a;'" http-equiv="Refresh"><meta http-equiv=refresh content="7"><link rel=canonical href="/5&#300;&eacute;&#9">"""
    got = {r.dst for r in urlfilter.canonical_edges(spark.createDataFrame([("http://a.io/p", html), ("http://b.io/", None)], "url string, html string")).collect()}
    assert got == {"http://a.io/1?x=1&y=2", "/3", "http://a.io/4/Z", "/5&#300;&eacute;&#9"}


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "alpha beta gamma delta", None, None), (None, "alpha beta gamma delta", None, None), (4, None, None, None)], "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    voc = vocabulary("byte_bpe_50k.json")
    for out in (quality.judge(df), langid.identify(df), lm.score(df), simhash.near_duplicates(df), decontam.contamination(df, bench), suffix.dedup(df), packing.pack(df, vocabulary("word_bpe_49k.json"), 1), tokenfile.read(spark, tokenfile.write(df, voc, 2)[0])):
        assert out.count() == 3


def test_url_rules_of_the_contract(spark):
    assert set(urlfilter.RULES) == {("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")}
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://b.net/de/1", "http://example.net/de/9", "http://example.net/de/8", "http://c.org/es/", "http://c.org/en/"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert got == {0: ("com/en/", "block"), 1: ("example.com/en/7", "allow"), 2: ("net/de/", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: ("org/es/", "block"), 6: (None, "allow")}
