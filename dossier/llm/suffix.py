"""Removal of byte strings that stand earlier in the corpus, by merging shard
Burrows-Wheeler transforms.

1. Anchors: every window of ``LENGTH`` bytes takes its smallest hash of
   ``GRAM`` bytes. Equal windows have equal anchors, so windows whose anchor is
   unique in the corpus are settled. Consecutive windows with one anchor form a
   span; a span whose bytes stand earlier as a whole is settled as well. Chunks
   ask slots of anchors for this (:mod:`.chunks`).
2. What is left are anchors with several different spans. Each bucket of
   anchors puts its spans into two shards, builds the BWT of each, and merges
   them by iterative interleave refinement: two text columns a round, the
   interleave is stably re-dealt by the preceding characters; a boundary opens
   where prefixes begin to differ. After ``LENGTH`` columns the intervals
   without a boundary are the repeated strings with that common prefix; their
   earliest window stays and the others are marked.
   Anchors with over ``HOT`` spans take a plain way: their windows are grouped
   by hash with partial sums, so no bucket grows with one passage.
3. Marked windows are united to byte runs, which are cut out of each text.

Strings are judged on the input and never cross documents. Equality of windows
in step 1 and on the plain way is that of 64-bit hashes.

Edge cases: a null text is empty; a null doc_id stands before all others; rows
with equal doc_ids come in the order in which they were packed, one after the
other, each with its own result; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from . import textbytes as tb
from .scratch import stored
from .skew import join_counted

LENGTH = 100
GRAM = 32
HOT = 20_000
#: slots at most: a chunk asks for little, and each of its rows has ten arrays
SLOTS = 512
#: contested spans in a bucket
BUCKET_SPANS = 3000
FIRST_ID = -(1 << 63)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, r = h, 1
    while r * 2 <= width:
        m = np.minimum(m[:-r], m[r:])
        r *= 2
    if r < width:
        m = np.minimum(m[: len(m) - (width - r)], m[width - r :])
    return m


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Spans of windows with one anchor: first window, number of windows, anchor
    hash, span hash, and whether the anchor stands twice within the span."""
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(tb.U), none.astype(tb.U), none.astype(bool)
    hasher = tb.Hasher(data)
    g = tb.mix((hasher.pre[gram:] - hasher.pre[:-gram]) * hasher.inv[: len(data) + 1 - gram])
    m = _sliding_min(g, width)
    ends = np.repeat(offs[1:], np.diff(offs))[: len(m)]
    valid = np.arange(len(m)) + length <= ends
    new = np.ones(len(m), bool)
    new[1:] = m[1:] != m[:-1]
    new[1:] |= ~valid[:-1]
    starts = offs[:-1][offs[:-1] < len(m)]
    new[starts] = True
    a = np.flatnonzero(new & valid)
    upto = np.append(np.flatnonzero(new | ~valid), len(m))
    count = upto[np.searchsorted(upto, a, "right")] - a
    v = m[a]
    span = hasher(a, a + count + length - 1)
    twice = count > width
    for at in range(0, len(a), 1 << 14):
        s = slice(at, at + (1 << 14))
        head = g[a[s, None] + np.arange(width)] == v[s, None]
        tail = g[(a[s] + count[s] - 1)[:, None] + np.arange(width)] == v[s, None]
        one = (head.sum(1) == 1) & (tail.sum(1) == 1) & (head.argmax(1) == tail.argmax(1) + count[s] - 1)
        twice[s] |= ~one
    return a, count, tb.mix(v), span, twice  # minima crowd at the low end; mixed, they spread over the shards


def _ordered(data, sizes, ids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A packed chunk with its documents in order of id: bytes, offsets, ids, and where each was."""
    raw, offs = chunks.texts(data, sizes)
    key = np.array([FIRST_ID if i is None else i for i in ids], np.int64)
    order = np.argsort(key, kind="stable")
    if (np.diff(order) < 0).any():
        raw = np.concatenate([raw[offs[i] : offs[i + 1]] for i in order.tolist()])
        offs = np.concatenate([[0], np.cumsum(np.diff(offs)[order])])
    return raw, offs, key[order], order


#: of a span or pointer: nothing to do; stands earlier as a whole; to compare
#: window by window; the same, but its anchor has very many spans; a pointer to
#: an anchor of which all open spans are such
DONE, SURE, OPEN, MANY, FLAG = range(5)


class Spans:
    """Requests are spans and pointers to anchors, sorted by key, and runs that
    the chunk has settled itself; answers a code for each span or pointer."""

    def __init__(self, hot: int):
        self.hot = hot

    @staticmethod
    def _joined(bodies):
        asked = [chunks.decode(x) for x in bodies]
        v, s, ids, chunk, at, n, t, w = (np.concatenate([a[k] for a in asked]) for k in range(8))
        ids, chunk, at, n, w = (x.astype(np.int64) for x in (ids, chunk, at, n, w))
        order = np.lexsort((at, chunk, ids, s, v))
        new_v = np.ones(len(v), bool)
        new_v[1:] = v[order][1:] != v[order][:-1]
        new_s = new_v.copy()
        new_s[1:] |= s[order][1:] != s[order][:-1]
        return asked, [x[order] for x in (v, s, ids, chunk, at, n, t.astype(bool), w)], order, new_v, new_s

    @staticmethod
    def _told(asked, code):
        out, begin = [], 0
        for a in asked:
            c = code[begin : begin + len(a[0])]
            begin += len(c)
            some = c > 0
            out.append((chunks.encode(c, *(a[k][some].astype(np.int64) for k in (4, 5)), *a[8:]), int(((c == OPEN) | (c == MANY)).sum()), int((c == FLAG).sum())))
        return out

    def settle(self, bodies):
        asked, (v, _, _, _, _, _, t, w), order, new_v, new_s = self._joined(bodies)
        pointer = w > 1
        first = np.flatnonzero(new_v)
        group = np.cumsum(new_v) - 1
        several = np.add.reduceat(np.where(pointer, w, new_s), first) if len(v) else np.zeros(0, np.int64)
        inner = np.maximum.reduceat(t | (w == 0), first) if len(v) else np.zeros(0, bool)
        hot = (several > self.hot)[group]
        contested = ((several > 1) | inner)[group]
        code = np.empty(len(v), np.int8)
        code[order] = np.where(pointer, np.where(hot, FLAG, DONE), np.where(~new_s, SURE, np.where(hot, MANY, np.where(contested, OPEN, DONE))))
        return self._told(asked, code)

    def merge(self, bodies, at):
        _, x, _, _, new_s = self._joined(bodies)
        first = np.flatnonzero(new_s)
        if len(first):  # the earliest span of each kind; pointers add up
            t, w = np.maximum.reduceat(x[6], first), np.where(x[7][first] > 1, np.add.reduceat(x[7], first), x[7][first])
            x = [*(c[first] for c in x[:6]), t, w]
        cuts = chunks.split(x[0], at)
        none = np.zeros(0, np.int64)
        return [chunks.encode(*(c[i:j] for c in x), none, none) for i, j in zip(cuts, cuts[1:])]

    def spread(self, bodies, answers):
        asked, (*_, w), order, _, new_s = self._joined(bodies)
        got = np.concatenate([chunks.decode(x)[0] for x, _, _ in answers])[np.cumsum(new_s) - 1]
        code = np.empty(len(w), np.int8)
        code[order] = np.where(new_s | (w > 1), got, SURE)
        return self._told(asked, code)


def _runs(answers: list[bytes], *codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows with one of the codes; settled ones with those that the chunk settled itself."""
    at, n = [], []
    for blob in answers:
        code, a, k, own_at, own_n = chunks.decode(blob)
        pick = np.isin(code[code > 0], codes)
        at += [a[pick], own_at] if SURE in codes else [a[pick]]
        n += [k[pick], own_n] if SURE in codes else [k[pick]]
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (at, n))


def _slots(packed: chunks.Packed) -> int:
    return min(packed.slots, SLOTS)


def _requests(packed: chunks.Packed, length: int, gram: int) -> DataFrame:
    """An anchor with one span in a chunk goes to the anchor's slot with its
    span. One with several sends a pointer there, with their number (weight
    over 1), and the spans to slots of their own hashes (weight 0): a passage
    with ever new surroundings is one entry per chunk at its anchor."""
    slots = _slots(packed)

    def run(batches):
        for b in batches:
            for chunk, data, sizes, ids in zip(*(b.column(b.schema.get_field_index(c)) for c in ("chunk", "data", "sizes", "doc_id"))):
                raw, offs, key, _ = _ordered(data.as_py(), sizes.as_py(), ids.as_py())
                parts = [(offs[d] + a, n, v, s, t) for d, part, o in chunks.slices(raw, offs) for a, n, v, s, t in [anchors(part, o, length, gram)]]
                a, n, v, s, t = (np.concatenate(x) for x in zip(*parts)) if parts else anchors(raw, offs)
                order = np.lexsort((a, s, v))
                a, n, v, s, t = (x[order] for x in (a, n, v, s, t))
                again = np.zeros(len(a), bool)
                again[1:] = (v[1:] == v[:-1]) & (s[1:] == s[:-1])
                mine = int(chunk.as_py())
                sure = a[again].astype(np.int64), n[again].astype(np.int64)
                a, n, v, s, t = (x[~again] for x in (a, n, v, s, t))
                first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
                several = np.diff(np.append(first, len(v)))
                own = np.repeat(several > 1, several)
                v = np.concatenate([np.where(own, tb.mix(v ^ tb.mix(s)), v), v[first[several > 1]]])
                point = first[several > 1]
                s = np.concatenate([s, np.zeros(len(point), tb.U)])
                w = np.concatenate([np.where(own, 0, 1), several[several > 1]])
                a, n, t = (np.concatenate([x, x[point]]) for x in (a, n, t))
                order = np.argsort(v, kind="stable")
                a, n, v, s, t, w = (x[order] for x in (a, n, v, s, t, w))
                doc = key[np.searchsorted(offs, a, "right") - 1]
                cuts = chunks.split(v, chunks.edges(0, 1, slots))
                ones = [i for i in range(slots) if cuts[i] < cuts[i + 1] or i == mine % slots]
                none = np.zeros(0, np.int64), np.zeros(0, np.int64)
                columns = v, s, doc, np.full(len(v), mine), a.astype(np.int64), n.astype(np.int64), t, w.astype(np.int64)
                bodies = [chunks.encode(*(c[cuts[i] : cuts[i + 1]] for c in columns), *(sure if i == mine % slots else none)) for i in ones]
                yield pa.RecordBatch.from_arrays([pa.array(ones, pa.int64()), pa.array([mine] * len(ones), pa.int64()), pa.array(bodies, pa.binary())], names=["slot", "unit", "body"])
                del parts, bodies, columns, raw, a, n, v, s, t, w
                tb.release()

    return packed.chunks.select("chunk", "data", "sizes", "doc_id").mapInArrow(run, "slot long, unit long, body binary")


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of the rotations of ``text``, by prefix doubling from 8 bytes."""
    n = len(text)
    twice = np.concatenate([text, text[:8]])
    while len(twice) < n + 8:
        twice = np.concatenate([twice, text])[: n + 8]
    key = np.zeros(n, tb.U)
    for k in range(8):
        key = key << tb.U(8) | twice[k : k + n].astype(tb.U)
    step = 8
    while True:
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = k[1:] != k[:-1]
        ranks = np.cumsum(new)
        if ranks[-1] == n - 1 or step > 2 * n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        key = (rank << 32 | np.roll(rank, -step % n)).astype(tb.U)
        step *= 2


def merge_shards(shards: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges the BWTs of two shard texts (0 ends each string): positions in the
    joined text in the order of their first ``length`` bytes, and where an
    interval of equal ones begins. Only the shards' own suffix orders are
    sorted; the interleave is refined from their transforms."""
    orders = [suffix_order(t) for t in shards]
    # the two characters before each suffix: a step of two columns
    # (a shard of one byte comes round to itself)
    byte = lambda t, o: np.take(t, o, mode="wrap").astype(np.uint16)
    before = [byte(t, o - 1) | byte(t, o - 2) << np.uint16(8) for t, o in zip(shards, orders)]
    side = np.repeat(np.array([False, True]), [len(t) for t in shards])
    ids = np.zeros(len(side), np.int64)
    for _ in range(length // 2):
        c = np.empty(len(side), np.uint16)
        c[~side], c[side] = before
        deal = np.argsort(c, kind="stable")
        c, ids, side = c[deal], ids[deal], side[deal]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (ids[1:] != ids[:-1])
        new |= (c < 256) | (c & 255 == 0)  # a prefix over the end of a string equals no other
        ids = np.cumsum(new)
    at = np.empty(len(side), np.int64)
    at[~side] = orders[0]
    at[side] = orders[1] + len(shards[0])
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    return at, new


def repeated_windows(spans: list[bytes], order: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(span, first window, number) of the windows that stand earlier by
    ``order``, the rank of each span's first byte (consecutive within a text)."""
    if length % 2:
        raise ValueError("the merge takes two columns a round")
    half = max(1, len(spans) // 2)
    # 255 stands for a zero byte: UTF-8 has neither 254 nor 255
    joined = [np.frombuffer(b"\0".join(x.replace(b"\0", b"\xff") for x in p) + b"\0", np.uint8) for p in (spans[:half], spans[half:])]
    at, new = merge_shards(joined, length)
    sizes = np.array([len(x) + 1 for x in spans])
    begin = np.cumsum(sizes) - sizes
    if half == len(spans):
        begin, sizes = np.append(begin, begin[-1] + sizes[-1]), np.append(sizes, 1)
        order = np.append(order, 0)
    owner = np.searchsorted(begin, at, "right") - 1
    key = order[owner] + at - begin[owner]
    least = np.minimum.reduceat(key, np.flatnonzero(new))[np.cumsum(new) - 1]
    late = key > least
    marked = np.sort(at[late])
    if not len(marked):
        return []
    cut = np.flatnonzero(np.concatenate([[True], np.diff(marked) > 1]))
    first, n = marked[cut], np.diff(np.append(cut, len(marked)))
    who = np.searchsorted(begin, first, "right") - 1
    return list(zip(who.tolist(), (first - begin[who]).tolist(), n.tolist()))


def _ranks(doc: np.ndarray, chunk: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for (doc_id, chunk, place), so that order is a comparison."""
    pair = np.lexsort((chunk, doc))
    new = np.zeros(len(doc), np.int64)
    new[1:] = (np.diff(doc[pair]) != 0) | (np.diff(chunk[pair]) != 0)
    rank = np.empty(len(doc), np.int64)
    rank[pair] = np.cumsum(new)
    return rank << 32 | at


def _spans(packed: chunks.Packed, answers: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    mine = answers.where("a + b > 0").groupBy(F.col("unit").alias("chunk")).agg(F.collect_list("got").alias("got"))

    def run(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            for i in range(b.num_rows):
                raw, offs, key, _ = _ordered(col("data")[i].as_py(), col("sizes")[i].as_py(), col("doc_id")[i].as_py())
                text = raw.tobytes()
                got = col("got")[i].as_py()
                flagged = np.unique(_anchor_of(raw, *_runs(got, FLAG), length, gram)[0])
                for code in (OPEN, MANY):
                    a, n = _runs(got, code)
                    if not len(a):
                        continue
                    v, place = _anchor_of(raw, a, n, length, gram)
                    hot = np.isin(v, flagged) | (code == MANY)
                    doc = key[np.searchsorted(offs, a, "right") - 1]
                    for s in range(0, len(a), 20_000):
                        c = slice(s, s + 20_000)
                        span = [text[x : x + y + length - 1] for x, y in zip(a[c].tolist(), n[c].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array((v[c] % tb.U(buckets)).astype(np.int64)), pa.array(hot[c]), pa.array(doc[c]), pa.array([col("chunk")[i].as_py()] * len(span), pa.int64()), pa.array(a[c]), pa.array(place[c]), pa.array(span, pa.binary())],
                            names=["bucket", "hot", "doc", "chunk", "at", "place", "span"],
                        )
                        del span
                del raw, text, got
                tb.release()

    texts = packed.chunks.select("chunk", "data", "sizes", "doc_id")
    return stored(texts.join(mine, "chunk").mapInArrow(run, "bucket long, hot boolean, doc long, chunk long, at long, place long, span binary"), "spans")


def _anchor_of(raw: np.ndarray, a: np.ndarray, n: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of spans: the anchor's hash, and its place in the span, or -1 if it stands there more than once."""
    v, place = np.empty(len(a), tb.U), np.empty(len(a), np.int64)
    width = 2 * (length - gram) + 1
    raw = np.concatenate([raw, np.zeros(2 * length, np.uint8)])
    for s in range(0, len(a), 2048):
        c = slice(s, s + 2048)
        rows = raw[a[c, None] + np.arange(width + gram - 1)]
        h = tb.Hasher(rows.reshape(-1))
        at = np.arange(len(rows))[:, None] * rows.shape[1] + np.arange(width)
        g = tb.mix((h.pre[at + gram] - h.pre[at]) * h.inv[at])
        v[c] = g[:, : length - gram + 1].min(1)
        same = (g == v[c, None]) & (np.arange(width) < n[c, None] + length - gram)
        place[c] = np.where((same.sum(1) == 1) & (n[c] <= length - gram + 1), same.argmax(1), -1)
    return v, place


def _may_repeat(spans: list[bytes], place: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Equal windows share their anchor and at least half of the rest of the
    window before or after it; spans that share neither with another are settled.
    A span in which the anchor stands more than once is never settled, and every
    stand of it counts for the others."""
    half = (length - gram) // 2
    data = np.frombuffer(b"".join(spans), np.uint8)
    sizes = np.array([len(x) for x in spans], np.int64)
    begin = np.cumsum(sizes) - sizes
    h = tb.Hasher(data)
    keep = place < 0
    one, many = np.flatnonzero(~keep), np.flatnonzero(keep)
    m = sizes[many] - gram + 1
    first = np.cumsum(m) - m
    at = np.repeat(begin[many] - first, m) + np.arange(m.sum())
    g = tb.mix((h.pre[at + gram] - h.pre[at]) * h.inv[at])
    v = g[first[:, None] + np.arange(length - gram + 1)].min(1)
    stands = g == np.repeat(v, m)
    who = np.concatenate([one, np.repeat(many, m)[stands]])
    p = np.concatenate([begin[one] + place[one], at[stands]])
    b, e = begin[who], begin[who] + sizes[who]
    for ok, s, t in ((p - half >= b, p - half, p + gram), (p + gram + half <= e, p, p + gram + half)):
        often, _ = tb.repeated(h(s[ok], t[ok]))
        keep[who[ok][often]] = True
    return keep


def _compare(spans: DataFrame, length: int, gram: int) -> DataFrame:
    """(chunk, at, n): runs of windows of the contested spans that stand earlier."""

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[_may_repeat([bytes(x) for x in pdf["span"]], pdf["place"].to_numpy(), length, gram)]
        order = _ranks(pdf["doc"].to_numpy(), pdf["chunk"].to_numpy(), pdf["at"].to_numpy())
        found = repeated_windows([bytes(x) for x in pdf["span"]], order, length) if len(pdf) else []
        tb.release()
        who = np.array([f[0] for f in found], np.int64)
        return pd.DataFrame({"chunk": pdf["chunk"].to_numpy()[who], "at": pdf["at"].to_numpy()[who] + np.array([f[1] for f in found], np.int64), "n": np.array([f[2] for f in found], np.int64)})

    def windows(batches):
        for b in batches:
            for doc, chunk, at, span in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc", "chunk", "at", "span"))):
                h = tb.Hasher(np.frombuffer(span, np.uint8))
                s = np.arange(len(span) - length + 1)
                n = len(s)
                yield pa.RecordBatch.from_arrays([pa.array(h(s, s + length).view(np.int64)), pa.array([doc] * n, pa.int64()), pa.array([chunk] * n, pa.int64()), pa.array(at + s)], names=["key", "doc", "chunk", "at"])

    cold = spans.where("not hot").select("bucket", "doc", "chunk", "at", "place", "span").groupBy("bucket").applyInPandas(bucket, "chunk long, at long, n long")
    each = stored(spans.where("hot").select("doc", "chunk", "at", "span").mapInArrow(windows, "key long, doc long, chunk long, at long"), "windows")
    least = stored(each.groupBy("key").agg(F.min(F.struct("doc", "chunk", "at")).alias("least"), F.count("*").alias("n")).where("n > 1"), "least")
    late = join_counted(each, least, "key").where(F.struct("doc", "chunk", "at") > F.col("least")).select("chunk", "at", F.lit(1).cast("long").alias("n"))
    return cold.union(late)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, keep: tuple[str, ...] = ("doc_id",), hot: int = HOT) -> DataFrame:
    """Per document the ``keep`` columns (doc_id among them), n_bytes, n_removed, n_spans, kept_sha256, and with
    ``with_text`` the text that is left (bytes of a cut character are dropped from it)."""
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    packed = chunks.pack(rows, keep)
    answers = stored(chunks.resolve(_requests(packed, length, gram), packed.count, _slots(packed), Spans(hot)), "settled")
    n_open = answers.agg(F.sum("a")).first()[0] or 0
    late = stored(_compare(_spans(packed, answers, -(-n_open // BUCKET_SPANS) or 1, length, gram), length, gram), "late")
    marks = answers.groupBy(F.col("unit").alias("chunk")).agg(F.collect_list("got").alias("got"))  # at most FAN a chunk
    lists = late.groupBy("chunk").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))

    def run(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            for i in range(b.num_rows):
                raw, offs, _, where = _ordered(col("data")[i].as_py(), col("sizes")[i].as_py(), col("doc_id")[i].as_py())
                runs = [_runs(col("got")[i].as_py() or [], SURE)]
                runs.append((np.array(col("at")[i].as_py() or [], np.int64), np.array(col("n")[i].as_py() or [], np.int64)))
                a, n = (np.concatenate(x) for x in zip(*runs))
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, a + n + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = [col(c)[i].values.take(pa.array(where)) for c in keep]
                out = []
                for s, e in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    g = gone[s:e]
                    left = raw[s:e][~g].tobytes()
                    spans = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum())
                    out.append((e - s, int(g.sum()), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
                cols = list(zip(*out)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])
                del raw, out, cols, gone, edge
                tb.release()

    joined = packed.chunks.join(marks, "chunk", "left").join(lists, "chunk", "left")
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    out = joined.mapInArrow(run, f"{fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    return out if with_text else out.drop("text")
