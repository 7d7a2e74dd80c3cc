"""Personal data: patterns that always count, and boosted trees over a wider net.

The base rules (email, ip, card, phone) are plain patterns with a check; their
spans always stay. Generators of high recall propose more spans, which may
overlap: disguised addresses, numbers without their usual signs or with others.
Gradient-boosted trees score a proposal by its form and its surroundings; an
isotonic curve over held-out examples turns scores into probabilities, and
proposals of at least ``SURE`` are redacted, the likeliest first where they overlap.

Nothing is labelled by hand. Examples are made of what the base rules find: in
its own surroundings each finding also appears disguised (to be found) and
broken (not to be found); what the generators propose elsewhere counts as not
to be found, too. Some of that is personal data after all, so what looks as
much like the disguised findings to a first model as nine in ten of these do
teaches the second one nothing. Training takes at most ``MOST_EXAMPLES`` of them, those with the
smallest hashes; everything else covers all texts. Patterns take time linear in
a text: no run is scanned again from its middle.

Edge cases: a null text is an empty one; rows are known by a number of their
own, so null and repeated ids keep their own spans; with no finding, or none in
the held-out part, the base spans are all there is; only doc_id and text are
read, so no other column's name can clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .textbytes import release

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: examples that training takes at most; one in ``HELD`` of the documents calibrates
MOST_EXAMPLES, HELD = 20_000, 4
#: calibrated probability from which a proposal is redacted
SURE = 0.9
#: share of the disguised examples that may score below what the second model leaves out
DOUBT = 0.1
#: characters of surroundings that count
AROUND = 32

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: where numbers can be: every pattern below stays within one stretch
_STRETCH = re.compile(r"[0-9+][0-9+().\x20\[\]/_‐-–-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end), by kind and start; leftmost, without overlap within a kind."""
    out = []
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            pos = found.end()
            out.append((EMAIL, start, pos))
        at = text.find("@", at + 1)
    stretches = [m.span() for m in _STRETCH.finditer(text) if m.end() - m.start() > 6]
    for a, b in stretches:
        out += [(IP, *m.span()) for m in _IP.finditer(text, a, b) if octets(m[0].split("."))]
        out += [(CARD, *m.span()) for m in _CARD.finditer(text, a, b) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        out += [(PHONE, *m.span()) for m in _PHONE.finditer(text, a, b) if 8 <= len(digits(m[0])) <= 15]
    return sorted(out)


_AT = re.compile(r"@|[(\[{]\x20?(?:at|AT|@)\x20?[)\]}]|\x20(?:at|AT)\x20")
_DOT = r"(?:\.|\x20?[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}]\x20?|\x20(?:dot|DOT)\x20)"
_HOST = re.compile(rf"\x20?[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,5}}")
_WIDE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\x20?[(\[]?\.[)\]]?\x20?[0-9]{1,3}){3}(?![0-9])")
_SEP = r"[\x20./_‐-–-]"
_WIDE_CARD = re.compile(rf"(?<![0-9])[0-9](?:{_SEP}{{0,2}}[0-9]){{11,18}}(?![0-9])")
_WIDE_PHONE = re.compile(r"(?:\+|00)?\(?(?<![0-9])[0-9](?:[\x20./()\[\]_‐-–-]{0,3}[0-9]){6,14}(?![0-9])")


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data; they may overlap."""
    out = set()
    if "@" in text or "at" in text or "AT" in text:
        for m in _AT.finditer(text):
            start = a = m.start() - (text[m.start() - 1 : m.start()] == " ")
            while start > max(0, a - 64) and text[start - 1] in LOCAL:
                start -= 1
            host = _HOST.match(text, m.end())
            if host and start < a:
                out.add((EMAIL, start, host.end()))
    for m in _STRETCH.finditer(text):
        a, b = m.span()
        if b - a > 6:
            for kind, pattern in ((IP, _WIDE_IP), (CARD, _WIDE_CARD), (PHONE, _WIDE_PHONE)):
                out.update((kind, *x.span()) for x in pattern.finditer(text, a, b))
    return sorted(out)


# words beside personal data of a kind, and beside other numbers
NEAR = (
    ("mail", "contact", "write", "courriel", "correo", "schreib"),
    ("ip", "host", "server", "address", "serveur", "adresse"),
    ("card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta"),
    ("tel", "phone", "call", "fax", "mobile", "cell", "anruf", "llam"),
    ("token", "key", "password", "secret", "hash", "version", "isbn", "page", "order", "invoice", "ref", "id", "no."),
)


def _class(c: str) -> float:
    return 0.0 if c == "" else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0 if c in "=\"'" else 5.0


def features(text: str, span: Span) -> list[float]:
    """Form and surroundings of a proposal."""
    kind, a, b = span
    s = text[a:b]
    before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
    d, groups = digits(s), [len(g) for g in re.findall("[0-9]+", s)] or [0]
    seps = [c for c in s if not c.isalnum()]
    near = before.lower()
    own = re.split(r"[^0-9]+", s)
    return [
        *(float(kind == k) for k in range(4)), float(len(s)), float(len(d)), float(sum(c.isalpha() for c in s)), float(len(seps)), float(len(set(seps))), float(len(groups)), float(max(groups)), float(min(groups)),
        float(len(d) > 11 and luhn(d)), float(octets([x for x in own if x])), float("@" in s), float(s[:1] == "+"), float(s[:2] == "00"), float(s.count("(") == s.count(")")), float(len(re.split(_DOT, s)[-1])),
        _class(before[-1:]), _class(after[:1]), float(sum(c.isdigit() for c in before[-12:])), float(sum(c.isdigit() for c in after[:12])), *(float(any(w in near for w in words)) for words in NEAR),
    ]


def disguised(kind: int, s: str, r: random.Random) -> str:
    """The same data in another dress."""
    if kind == EMAIL:
        host = s.split("@")[1].replace(".", r.choice((".", ".", " dot ", "[dot]", " (dot) ")))
        return s.split("@")[0] + r.choice((" at ", " (at) ", "[at]", "(at)", "@" if "." not in host else " AT ")) + host
    if kind == IP:
        return s.replace(".", r.choice(("[.]", "(.)", " . ", ". ")))
    if kind == CARD:
        sep = r.choice((".", "/", "  ", "_", "–"))
        return sep.join(re.findall(".{1,4}", digits(s)))
    plain = re.sub(r"[()]", "", s[1:])
    return r.choice(("", "00", "+")) + re.sub(r"[\x20.-]+", r.choice((" ", ".", "/", "-")), plain)


def broken(kind: int, s: str, r: random.Random) -> str:
    """Much the same, but no such data."""
    if kind == EMAIL:
        return s.replace(".", " ") if r.random() < 0.5 else s.split("@")[0] + " at " + s.split("@")[1].split(".")[0]
    if kind == IP:
        parts = s.split(".")
        parts[r.randrange(4)] = str(r.randrange(256, 1000))
        return ".".join(parts)
    d = digits(s)
    if kind == CARD:
        return d[:-1] + str((int(d[-1]) + r.randrange(1, 10)) % 10)
    return r.choice(("", "+")) + (d[:5] if r.random() < 0.5 else " ".join((d, d)))


def examples(text: str, found: list[Span], proposed: list[Span], r: random.Random) -> Iterator[tuple[list[float], bool, bool]]:
    """(features, label, made by hand)"""
    for span in proposed:
        if not any(a < span[2] and span[1] < b for _, a, b in found):
            yield features(text, span), False, False
    for kind, a, b in found:
        before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
        for s, good in ((text[a:b], True), (disguised(kind, text[a:b], r), True), (broken(kind, text[a:b], r), False)):
            near = before + s + after
            want = (kind, len(before), len(before) + len(s))
            for span in proposals(near):
                if span[1] < want[2] and want[1] < span[2]:
                    yield features(near, span), good and span == want, True


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("features", pa.list_(pa.float32()))])
_EXAMPLE = pa.struct([("features", pa.list_(pa.float32())), ("label", pa.bool_()), ("made", pa.bool_()), ("held", pa.bool_()), ("hash", pa.int64())])
_COLUMNS = {"base": pa.string(), "counts": pa.list_(pa.int64()), "proposed": pa.list_(_SPAN), "examples": pa.list_(_EXAMPLE)}
_DDL = "base string, counts array<long>, proposed array<struct<kind int, start long, stop long, features array<float>>>, examples array<struct<features array<float>, label boolean, made boolean, held boolean, hash long>>"


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: its base spans, what else is proposed, and the examples it gives."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            for i in range(0, b.num_rows, 256):
                out: dict = {c: [] for c in _COLUMNS}
                part = texts[i : i + 256]
                for text in part:
                    text = text.as_py()
                    found, proposed = base_spans(text), proposals(text)
                    seed = zlib.crc32(text.encode())
                    cases = [{"features": f, "label": y, "made": m, "held": seed % HELD == 0, "hash": int.from_bytes(hashlib.blake2b(b"%d:%d" % (seed, k), digest_size=8).digest(), "big", signed=True)} for k, (f, y, m) in enumerate(examples(text, found, proposed, random.Random(seed)))]
                    others = [s for s in proposed if not any(x < s[2] and s[1] < y for _, x, y in found)] if proposed else []
                    out["base"].append(told(found))
                    out["counts"].append([sum(s[0] == k for s in found) for k in range(4)])
                    out["proposed"].append([{"kind": k, "start": x, "stop": y, "features": features(text, (k, x, y))} for k, x, y in others])
                    out["examples"].append(cases)
                keys = b.slice(i, len(part))
                yield pa.RecordBatch.from_arrays([keys.column(0), keys.column(1), *(pa.array(out[c], t) for c, t in _COLUMNS.items())], names=["uid", "doc_id", *_COLUMNS])
            release()

    return rows.mapInArrow(run, f"uid long, doc_id {kind}, {_DDL}")


def _vectors(df: DataFrame, *more: str) -> DataFrame:
    return df.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), *more)


def trained(cases: DataFrame):
    """The trees and the curve, or None where there is nothing to learn from."""
    taken = cases.orderBy("hash", F.col("features").cast("string")).limit(MOST_EXAMPLES)
    taken = stored(_vectors(taken, F.col("label").cast("double").alias("label"), "made", "held", "hash").coalesce(1).sortWithinPartitions("hash"), "examples")
    seen = {tuple(r) for r in taken.where("made").select("held", "label").distinct().collect()}  # four rows at most
    if len(seen) < 4:
        return None
    boosted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=16, maxDepth=4, stepSize=0.3, seed=7, cacheNodeIds=False)

    def scored(trees):
        return trees.transform(taken).select("features", "label", "made", "held", vector_to_array("probability")[1].alias("score"))

    first = stored(scored(boosted.fit(taken.where("not held"))), "scored")
    like = first.where("made and held and label = 1").agg(F.percentile("score", F.lit(DOUBT))).first()[0]
    taken = stored(first.where(F.col("made") | (F.col("score") < like)).drop("score"), "clear")
    trees = boosted.fit(taken.where("not held"))
    return trees, IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="sure").fit(scored(trees).where("held"))


def _resolved(batches):
    """Base spans and the likeliest of the chosen ones that are free of each other."""
    for b in batches:
        out = []
        for base, chosen in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("base", "chosen"))):
            kept: list[Span] = []
            for c in sorted(chosen or (), key=lambda c: (-c["sure"], -c["score"], c["start"] - c["stop"], c["start"], c["kind"])):
                if all(c["stop"] <= x or y <= c["start"] for _, x, y in kept):
                    kept.append((c["kind"], c["start"], c["stop"]))
            if kept:
                mine = [x.split(":") for x in base.split(",") if x]
                base = told(kept + [(KINDS.index(k), int(x), int(y)) for k, x, y in mine])
            out.append(base)
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("doc_id", "counts", "base")] + [pa.array(out, pa.string())], names=["doc_id", "counts", "base", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, counts by kind, base, spans): every document's personal data as ``kind:start:end``, end exclusive, in code points."""
    found = stored(scan(docs), "found")
    kind = dict(found.dtypes)["doc_id"]
    model = trained(found.select(F.explode("examples").alias("x")).select("x.*"))
    rows = found.select("uid", "doc_id", "counts", "base")
    if model is None:
        return rows.select("doc_id", "counts", "base", F.col("base").alias("spans"))
    trees, curve = model
    each = _vectors(found.select("uid", F.explode("proposed").alias("p")).select("uid", "p.*"), "uid", "kind", "start", "stop")
    scored = trees.transform(each).select("uid", "kind", "start", "stop", vector_to_array("probability")[1].alias("score"))
    sure = curve.transform(scored).where(F.col("sure") >= SURE)
    chosen = sure.groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "stop", "score", "sure")).alias("chosen"))
    return rows.join(chosen, "uid", "left").mapInArrow(_resolved, f"doc_id {kind}, counts array<long>, base string, spans string")


def digest(docs: DataFrame) -> DataFrame:
    n = (F.col("counts")[k].alias(f"n_{kind}") for k, kind in enumerate(KINDS))
    return find(docs).select("doc_id", *n, F.sha2("base", 256).alias("base_sha256"), "spans")
