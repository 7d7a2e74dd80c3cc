"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint maps to 32 two-bit segments; the embedding is the bit
count (0 to 2) of each. Manhattan distance between embeddings is a lower bound
of the Hamming distance, so fingerprints that differ in at most 2 bits differ
in at most 2 of 5 blocks of segments: they share a grid cell in one of the ten
3-block projections. Candidates meet in those cells (equi-join), are filtered
by Manhattan distance and verified by Hamming distance.

Cells of more than ``dense`` distinct fingerprints are not paired. Their
fingerprints take an exact linear way: each is put under itself and its 64
one-bit neighbours, and two fingerprints differ in at most 2 bits exactly when
they share such a key; linking all under a key to the smallest keeps the same
components without pairs.

Edge cases: a null text or one without words has fingerprint zero and is linked
like any other; equal rows share a fingerprint and a component; rows with a
null doc_id are put out, but the smallest id of a component is taken over the
others (null if there are none); an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from . import textbytes as tb
from .components import connected_components
from .scratch import stored
from .skew import join_counted

BLOCKS = (7, 7, 6, 6, 6)
EVEN = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def projection_masks() -> list[int]:
    """The ten unions of 3 of the 5 blocks of segments, as bit masks."""
    masks, at = [], 0
    for n in BLOCKS:
        masks.append(((1 << 2 * n) - 1) << 2 * at)
        at += n
    return [_signed(a | b | c) for a, b, c in combinations(masks, 3)]


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int32)


def fingerprint(text: bytes, size: int) -> int:
    """Majority bits of the XXH64 of all ``size``-word shingles."""
    words = text.translate(tb.LOWER.tobytes()).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, 42)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])[: len(words) - size + 1].tolist()
    ends = np.concatenate([gaps, [len(line)]])[size - 1 :].tolist()
    h64 = xxhash.xxh64_intdigest
    h = np.array([h64(line[s:e], 42) for s, e in zip(starts, ends)], np.uint64)
    cells = h.view(np.uint8).reshape(-1, 8)
    bits = np.zeros(64, np.int64)
    for k in range(8):
        bits[8 * k : 8 * k + 8] = np.bincount(cells[:, k], minlength=256) @ _BITS[:, ::-1]
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(h))


def fingerprints(docs: DataFrame, size: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and fp: the fingerprint of each whole text as a signed 64-bit number."""
    ship_package(docs.sparkSession)
    kept = docs.select(*keep, F.col("text").cast("string").alias("text"))

    def run(batches):
        for b, data, offs in tb.pieces(batches, "text"):
            raw, o = data.tobytes(), offs.tolist()
            fps = [_signed(fingerprint(raw[s:e], size)) for s, e in zip(o, o[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fps, pa.int64())], names=[*keep, "fp"])

    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(run, f"{fields}, fp bigint")


def _embedded(fps: DataFrame) -> DataFrame:
    """``emb``: in each two-bit segment of the fingerprint the number of its bits."""
    low = F.col("fp").bitwiseAND(F.lit(EVEN))
    high = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(EVEN))
    return fps.select("fp", F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high)).alias("emb"))


def links(fps: DataFrame, most: int = 2, dense: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of column ``fp`` whose
    components are those of Hamming distance at most 2."""
    if most != 2:
        raise ValueError("the blocks guarantee a distance of 2")
    masks = projection_masks()
    e = _embedded(fps)
    cells = e.select("fp", "emb", F.posexplode(F.array(*(F.col("emb").bitwiseAND(F.lit(m)) for m in masks))).alias("grid", "cell"))
    cells = stored(cells.select("fp", "emb", F.struct("grid", "cell").alias("key")), "cells")
    sizes = stored(cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    members = stored(join_counted(cells, sizes, "key").select("fp", "emb", "key.grid", "key.cell", "n"), "members")
    few = members.where(F.col("n") <= dense)
    left = few.select("grid", "cell", F.col("fp").alias("a"), F.col("emb").alias("ea"))
    right = few.select("grid", "cell", F.col("fp").alias("b"), F.col("emb").alias("eb"))
    manhattan = F.aggregate(
        F.sequence(F.lit(0), F.lit(62), F.lit(2)),
        F.lit(0),
        lambda t, k: t + F.abs(F.call_function("shiftrightunsigned", F.col("ea"), k).bitwiseAND(F.lit(3)) - F.call_function("shiftrightunsigned", F.col("eb"), k).bitwiseAND(F.lit(3))).cast("int"),
    )
    near = left.join(right, ["grid", "cell"]).where(F.col("a") < F.col("b"))
    near = near.where(manhattan <= most).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most).select("a", "b")
    crowd = members.where(F.col("n") > dense).select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), *(F.array(F.lit(_signed(1 << i))) for i in range(64)))
    keyed = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    low = keyed.groupBy("key").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    starred = keyed.join(low, "key").where(F.col("fp") != F.col("low")).select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return near.union(starred)


def _least(f: DataFrame, place: Column, dense: int) -> DataFrame:
    """(fp, least, n): for each fingerprint of ``f`` the smallest ``place`` in its component, and its rows."""
    each = stored(f.groupBy("fp").agg(F.min(place).alias("low"), F.count("*").alias("n")), "distinct")
    comp = stored(connected_components(links(each.select("fp"), dense=dense)), "components")
    least = comp.join(each, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("low").alias("least"), F.count("*").alias("n"))
    linked = join_counted(comp, stored(least, "least"), "component").select("node", "least")
    named = each.join(linked, F.col("fp") == F.col("node"), "left")
    return stored(named.select("fp", F.coalesce("least", "low").alias("least"), "n"), "named")


def near_duplicates(docs: DataFrame, size: int = 3, dense: int = 64) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for each row of ``docs``."""
    f = stored(fingerprints(docs, size), "fingerprints")
    out = join_counted(f, _least(f, F.col("doc_id"), dense), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"), "fp")


def first_copies(docs: DataFrame, tie: str, size: int = 3, dense: int = 64) -> DataFrame:
    """(doc_id, ``tie``, first) for each row of ``docs``: whether it has the
    smallest id of its component, null ids last, and of equal ids the smallest
    ``tie``. Each component has one such row, or several equal in both."""
    place = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id"), F.col(tie))
    f = stored(fingerprints(docs, size, ("doc_id", tie)), "fingerprints")
    return join_counted(f, _least(f, place, dense), "fp").select("doc_id", tie, place.eqNullSafe(F.col("least")).alias("first"))
