"""Personal data: base spans against the plain patterns, and disguised data that the trees have to find."""

import hashlib
import random
import re
import time

from dossier.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, uid string, counts string, base string"


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def plain(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(kind, m[0])]


def made(kind, r):
    if kind == pii.EMAIL:
        return f"{r.choice(('anna.k', 'j.smith', 'bo'))}{r.randrange(100)}@{r.choice(('mail', 'post'))}{r.randrange(9)}.example.{r.choice(('com', 'org'))}"
    if kind == pii.IP:
        return ".".join(str(r.randrange(1, 255)) for _ in range(4))
    if kind == pii.PHONE:
        return f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(10000):04d}"
    while True:
        s = "4" + "".join(str(r.randrange(10)) for _ in range(15))
        if pii.luhn(s):
            return s


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(r.randint(1, 8))) for _ in range(n))


def test_base_spans_of_awkward_strings():
    r = random.Random(5)
    signs = "0123456789" * 3 + "..--  @@++()ab%_,\n/é[]255"
    for _ in range(8000):
        text = "".join(r.choice(signs) for _ in range(r.randrange(60)))
        assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(text)] == plain(text), text


def test_time_is_linear():
    for unit in ("1", "a.", "a@", "+1 ", "1.1.", "1 at b.c ", "a", "at ", "+1(", "1  ", "(at)", "a at a dot "):
        text = unit * ((1 << 20) // len(unit))
        begun = time.perf_counter()
        pii.base_spans(text), pii.proposals(text)
        assert time.perf_counter() - begun < 10, unit


def test_spans_of_documents(spark):
    r = random.Random(2)
    rows, hidden, faulty = [(None, None), (None, ""), (6, " "), (7, "x@y.z"), (7, "x@y.z"), (8, "é" * (5 << 20) + " mail a.b@c.de")], {}, {}
    for k in range(700):
        kind = k % 4
        rows.append((1000 + k, f"{prose(r, 30)} {made(kind, r)} {prose(r, 20)}"))
    for k in range(40):
        kind, head = k % 4, prose(r, 30) + " "
        of, s = (hidden, pii.disguised(kind, made(kind, r), r)) if k % 8 < 4 else (faulty, pii.broken(kind, made(kind, r), r))
        rows.append((5000 + k, f"{head}{s} {prose(r, 20)}"))
        of[5000 + k] = f"{pii.KINDS[kind]}:{len(head)}:{len(head) + len(s)}"
    df = spark.createDataFrame([(*x, "clash", "clash", "clash") for x in rows], SCHEMA).repartition(3)
    got = pii.digest(df).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), *(sum(s.startswith(k) for s in plain(t)) for k in pii.KINDS), hashlib.sha256(",".join(plain(t)).encode()).hexdigest()) for d, t in rows)
    assert sorted((str(x.doc_id), x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in got) == want
    spans = {x.doc_id: x.spans.split(",") for x in got}
    assert sum(s in spans[d] for d, s in hidden.items()) >= 15  # of 20
    assert sum(s in spans[d] for d, s in faulty.items()) == 0
    texts = dict(rows)
    assert all(spans[d] == (plain(texts[d]) or [""]) for d in spans if d is not None and d < 5000)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(empty).collect() == []
    few = spark.createDataFrame([(1, "call +1 (652) 555-5229"), (2, None)], "doc_id long, text string")
    assert sorted((x.doc_id, x.spans) for x in pii.digest(few).collect()) == [(1, "phone:5:22"), (2, "")]
