"""Language identification by multilingual mixture inference.

Each language is a multinomial over hashed letter trigrams, counted over all
labelled training rows (``BUCKETS`` numbers a language, so the model is
bounded). A document is a mixture: every word comes from one language or from a
uniform background, with the product of its trigram likelihoods.
Expectation-maximisation estimates the proportions; then languages are dropped,
smallest share first, as long as the penalised likelihood does not fall.

Edge cases: a null text or one without a letter is ``und`` with score 0 and no
languages; rows without a language do not train; without any training row all
is ``und``; a null doc_id counts as the empty string where folds are dealt;
equal texts get equal results, one row out for each row in; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from . import textbytes as tb
from .scratch import batches_of

BUCKETS = 1 << 16
#: for each further language, this times the log of the number of words
PENALTY = 3.0
OTHER_LOG = -math.log(BUCKETS)

_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter; its lower-case form."""
    if not _TABLES:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        lower = np.arange(0x110000, dtype=np.uint32)
        for i in np.flatnonzero(letter).tolist():
            if len(x := chr(i).lower()) == 1:
                lower[i] = ord(x)
        _TABLES.extend((letter, lower))
    return _TABLES[0], _TABLES[1]


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of the texts: the bucket of its trigram, its document,
    and whether it begins a word. Anything between two words is one blank."""
    letter, lower = _tables()
    n = len(offs) - 1
    spread = np.full(len(data) + n + 1, 10, np.uint8)
    spread[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offs))] = data
    codes = np.frombuffer(spread.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = (spread & 0xC0) != 0x80
    at = np.cumsum(lead)[offs[:-1] + np.arange(n)] if n else np.zeros(0, np.int64)  # code points up to each document
    is_letter = letter[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    where = np.flatnonzero(keep)
    x = np.where(is_letter, lower[codes], 0)[where].astype(np.uint64)
    mid = np.flatnonzero(x)
    if not len(mid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    x = np.append(x, np.uint64(0))
    h = tb.mix((x[mid - 1] << tb.U(42)) | (x[mid] << tb.U(21)) | x[mid + 1])
    return (h >> tb.U(48)).astype(np.int64), np.searchsorted(at, where[mid], "right") - 1, x[mid - 1] == 0


#: text taken at once: its letters' likelihoods take some hundred times as much
SLICE_BYTES = 1 << 19


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities by bucket, from columns ``text`` and ``lang``."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")

    def run(batches):
        tb.forget()
        held: dict[str, np.ndarray] = {}
        for b, data, offs in tb.pieces(batches, "text", SLICE_BYTES):
            bucket, doc, _ = trigrams(data, offs)
            lang = b.column(0).dictionary_encode()
            code = lang.indices.to_numpy()[doc]
            for k, name in enumerate(lang.dictionary.to_pylist()):
                add = np.bincount(bucket[code == k], minlength=BUCKETS)
                held[name] = held[name] + add if name in held else add
        for name, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"])

    # at most BUCKETS rows a language
    with batches_of(docs.sparkSession, 2 << 20):
        found = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.ones((BUCKETS, len(langs)))
    counts[found["bucket"].to_numpy(), np.searchsorted(langs, found["lang"])] += found["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0) if len(starts) else np.zeros((0, x.shape[1]), x.dtype)


def _em(p: np.ndarray, unit: np.ndarray, starts: np.ndarray, w: np.ndarray, size: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        r = p * w[unit]
        r /= r.sum(axis=1, keepdims=True)
        w = _sums(r, starts) / size
    return w


def _likelihood(p, unit, starts, w) -> np.ndarray:
    return _sums(np.log((p * w[unit]).sum(axis=1, keepdims=True)), starts)[:, 0]


def mixtures(bucket: np.ndarray, doc: np.ndarray, first: np.ndarray, logp: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Documents with letters, and their proportions of the languages and, last, of the background."""
    word_at = np.flatnonzero(first)
    ll = np.add.reduceat(np.concatenate([logp[bucket], np.full((len(bucket), 1), OTHER_LOG, np.float32)], axis=1), word_at, axis=0)
    ll -= ll.max(axis=1, keepdims=True)
    p = np.exp(np.maximum(ll, -60)).astype(np.float32) + np.float32(1e-30)
    owner = doc[word_at]
    docs, starts, size = np.unique(owner, return_index=True, return_counts=True)
    unit = np.repeat(np.arange(len(docs)), size)
    count = size[:, None].astype(np.float32)
    n_lang = logp.shape[1]
    w = _em(p, unit, starts, np.full((len(docs), n_lang + 1), 1 / (n_lang + 1), np.float32), count, 12)
    active = np.ones(w.shape, bool)
    now = _likelihood(p, unit, starts, w)
    cost = penalty * np.log1p(size)
    open_ = np.arange(len(docs))
    for _ in range(n_lang - 1):
        if not len(open_):
            break
        # the documents that may still lose a language, with their words
        pick = np.isin(unit, open_, assume_unique=False)
        sub = p[pick]
        n = size[open_]
        at = np.cumsum(n) - n
        own = np.repeat(np.arange(len(open_)), n)
        share = np.where(active[open_, :n_lang], w[open_, :n_lang], 2)
        least = share.argmin(axis=1)
        mask = active[open_].copy()
        mask[np.arange(len(open_)), least] = False
        start = (w[open_] + np.float32(1e-3)) * mask
        less = _em(sub, own, at, start / start.sum(axis=1, keepdims=True), count[open_], 8)
        then = _likelihood(sub, own, at, less)
        good = then + cost[open_] >= now[open_]
        took = open_[good]
        w[took], now[took], active[took] = less[good], then[good], mask[good]
        open_ = took[active[took, :n_lang].sum(axis=1) > 1]
    return docs, w


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, keep: tuple[str, ...] = ("doc_id",), penalty: float = PENALTY) -> DataFrame:
    """Adds lang_pred, score, languages (name and share of the set) and other_share to the ``keep`` columns."""
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(logp)  # BUCKETS numbers a language
    others = [c for c in keep if c != "text"]
    kept = docs.select(*others, F.col("text").cast("string").alias("text"))
    sent = kept.columns if "text" in keep else others

    def run(batches):
        tb.forget()
        for b, data, offs in tb.pieces(batches, "text", SLICE_BYTES):
            name, score, sets, other = ["und"] * b.num_rows, np.zeros(b.num_rows), [[] for _ in range(b.num_rows)], np.zeros(b.num_rows)
            bucket, doc, first = trigrams(data, offs)
            if len(bucket) and langs:
                which, w = mixtures(bucket, doc, first, model.value, penalty)
                share = w[:, :-1] / np.maximum(w[:, :-1].sum(axis=1, keepdims=True), 1e-30)
                best = share.argmax(axis=1)
                score[which] = np.clip(share[np.arange(len(which)), best].astype(float), 0, 1)
                other[which] = w[:, -1]
                for i, k, s in zip(which.tolist(), best.tolist(), share.tolist()):
                    name[i] = langs[k]
                    sets[i] = [{"lang": langs[j], "share": x} for j, x in enumerate(s) if x > 0]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(sent))), pa.array(name, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))), pa.array(other)],
                names=[*sent, "lang_pred", "score", "languages", "other_share"],
            )

    found = ["lang_pred", "score", "languages", "other_share"]
    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in sent)
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double, languages array<struct<lang: string, share: double>>, other_share double").select(*keep, *found)


def identify(docs: DataFrame, folds: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Trains on the rows outside fold 0 and predicts every row."""
    langs, logp = train(docs.where(fold(F.col("doc_id"), folds) != 0))
    return predict(docs, langs, logp, keep).withColumn("held_out", fold(F.col("doc_id"), folds) == 0)
