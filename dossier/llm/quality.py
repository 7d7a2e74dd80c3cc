"""Quality rules with adaptive thresholds.

Counts of each text come from one vectorised pass. Each measure is an odds or a
mean, with one added to both sides of an odds, so that a short text without a
fault is not taken for a faultless one and every measure has a spread in every
group. It goes into a mergeable quantile sketch of logarithmic buckets (relative
error ``ERROR``) per language and source, over the texts that pass the base
rule: a sketch is a set of (bucket, count) rows, and merging is adding counts,
so Spark builds them with partial sums. Fences lie ``FACTOR`` times the distance
of the quartiles beyond them, in buckets, that is on a logarithmic scale; no
fixed cutoff or least width takes part. Quartiles of small groups lean on those
of their language, and these on those of everything, with the weight of
``LEAN`` documents. The documents are then joined with the fences.

Edge cases: a null or blank text has no words, fails the base rule and isn't
kept; a null language or source is a group of its own; equal rows get equal
results, one row out for each row in; an empty table gives an empty result;
further columns of the input are ignored. Lines and windows of a text are known
by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship_package
from . import textbytes as tb
from .scratch import stored

ERROR = 0.01
GAMMA = (1 + ERROR) / (1 - ERROR)
#: the bucket of values that have no logarithm
ZERO = -1_000_000
#: distance of a fence from its quartile, in distances of the quartiles
FACTOR = 2
#: documents that the next wider group counts for
LEAN = 100
#: measure: (value in SQL, whether low values are faults too)
MEASURES = {
    "symbols": ("(n_symbols + 1) / (word_chars - n_symbols + 1)", False),
    "dup_lines": ("(n_dup_lines + 1) / (n_lines - n_dup_lines + 1)", False),
    "word_length": ("word_chars / greatest(n_words, 1)", True),
    "repeats": ("(n_repeat_words + 1) / (n_words - n_repeat_words + 1)", False),
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    ws, we, wd = tb.words(data, offs)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offs])
    h = tb.Hasher(data)
    salt = tb.mix(np.arange(1, n + 1, dtype=tb.U))
    wh = h(ws, we)
    repeat = np.zeros(n, np.int64)
    if len(wh) > 2:
        key = tb.mix(wh[:-2] * tb.U(3) + tb.mix(wh[1:-1] * tb.U(5) + tb.mix(wh[2:]))) + salt[wd[:-2]]
        whole = wd[:-2] == wd[2:]
        at = np.flatnonzero(whole)
        often, _ = tb.repeated(key[at])
        covered = np.zeros(len(wh), bool)
        for k in range(3):
            covered[at[often] + k] = True
        repeat = tb.per_doc(wd[covered], n)
    ls, le, ld = tb.words(data, offs, _LINE)
    filled = np.searchsorted(ws, le, "left") > np.searchsorted(ws, ls, "left")
    ls, le, ld = ls[filled], le[filled], ld[filled]
    _, later = tb.repeated(h(ls, le) + salt[ld])
    return {
        "n_words": tb.per_doc(wd, n),
        "word_chars": total(_LEAD[data] & ~tb.SPACE[data]),
        "n_symbols": total(_SYMBOL[data]),
        "n_dup_lines": tb.per_doc(ld[later], n),
        "n_repeat_words": repeat,
        "n_lines": tb.per_doc(ld, n),
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The counts of each whole text beside the ``keep`` columns."""
    ship_package(docs.sparkSession)
    kept = docs.select(*keep, F.col("text").cast("string").alias("text"))

    def run(batches):
        for b, data, offs in tb.pieces(batches, "text"):
            m = _measure(data, offs)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(m[c], pa.int64()) for c in COUNTS)], names=[*keep, *COUNTS])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, fields + "".join(f", {c} bigint" for c in COUNTS))


def _bucket(measure: str) -> Column:
    value = F.expr(MEASURES[measure][0])
    return F.when(value <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(value) / F.lit(math.log(GAMMA))).cast("int"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one mergeable sketch per group."""
    rows = measured.where(~F.expr(BASE_FAILED)).select(
        "lang",
        "source",
        F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), _bucket(k).alias("bucket")) for k in MEASURES))).alias("x"),
    )
    return rows.groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Size and buckets of the quartiles of the sketches merged by ``by``."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("size", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("size") - 1)), F.col("bucket")))
    return ranked.groupBy(*by, "measure").agg(F.max("size").alias("size"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def fences(sketch: DataFrame, lean: int = LEAN, factor: int = FACTOR) -> DataFrame:
    """One row per (lang, source) with the highest bucket of each measure and,
    where low values are faults, the lowest."""
    own = _quartiles(sketch, ["lang", "source"])
    lang = _quartiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("measure").alias("m"), F.col("size").alias("lsize"), F.col("q1").alias("lq1"), F.col("q3").alias("lq3"))
    every = _quartiles(sketch, []).select(F.col("measure").alias("em"), F.col("q1").alias("eq1"), F.col("q3").alias("eq3"))
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))).join(every, F.col("measure") == F.col("em"))
    leant = lambda q, size, wider: (F.col(size) * F.col(q) + lean * wider) / (F.col(size) + lean)
    quart = lambda q: F.floor(leant(q, "size", leant("l" + q, "lsize", F.col("e" + q))) + 0.5).cast("int")
    rows = both.select("lang", "source", "measure", quart("q1").alias("q1"), quart("q3").alias("q3"))
    # a sketch knows a value up to its bucket
    width = factor * (F.col("q3") - F.col("q1") + 1)
    out = []
    for k, (_, low) in MEASURES.items():
        out.append(F.max(F.when(F.col("measure") == k, F.col("q3") + width)).alias(f"max_{k}"))
        if low:
            out.append(F.max(F.when(F.col("measure") == k, F.col("q1") - width)).alias(f"min_{k}"))
    return rows.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, lean: int = LEAN, factor: int = FACTOR) -> DataFrame:
    """Measures and verdict of each document: ``base_failed`` by the fixed base
    rule, ``kept`` also by the fences of its language and source."""
    m = stored(measures(docs), "quality")
    f = fences(sketches(m), lean, factor).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = m.join(f, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    failed = F.expr(BASE_FAILED)
    fits = F.lit(True)
    for k, (_, low) in MEASURES.items():
        fits = fits & (_bucket(k) <= F.col(f"max_{k}"))
        if low:
            fits = fits & (_bucket(k) >= F.col(f"min_{k}"))
    return joined.select(
        "doc_id",
        "lang",
        "source",
        *COUNTS,
        failed.alias("base_failed"),
        (~failed & F.coalesce(fits, F.lit(True))).alias("kept"),
    )
