"""Packing of token sequences by minimum bin slack.

Documents are tokenized whole and cut only beyond the capacity. What is packed
depends on the lengths alone, and there are at most ``capacity`` of them: the
histogram of lengths goes to the driver. A bin starts with the longest length
left; bitset subset-sum dynamic programming over the others finds the fullest
feasible combination, which is taken as often as the counts allow. Each
combination uses up a length, so their number is bounded whatever the input.
Only the tokenizing runs in Python; pieces and their ids then stay in the JVM.
Pieces find their place by their rank among the pieces of their length;
ranks come from counts per task and length, not from sorting pieces.

Edge cases: a null text is empty and has the end id alone; null or repeated
doc_ids are packed row by row; an empty table gives an empty result; special
tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship_package
from . import textbytes as tb
from .encode import SLICE_BYTES, encoder, with_end
from .scratch import BATCH_BYTES, stored

CAPACITY = 4096


#: bytes sent to a Python worker at once: ids come back as a multiple of the text
LEAN_BATCH = 2 << 20


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of lengths (at most ``counts`` of each) with the largest sum up to ``room``."""
    full, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            left, part = left - take, part * 2
            wider = (reach | reach << length * take) & full
            if wider != reach:
                steps.append((length, take, reach))
                reach = wider
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, number in a bin, bins, first bin, offset)."""
    left, used, rows, bins = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = {longest: 1}
        for length, n in fullest({k: v for k, v in left.items() if v}, capacity - longest).items():
            combination[length] = combination.get(length, 0) + n
        left[longest] += 1
        times = min(left[k] // n for k, n in combination.items())
        offset = 0
        for length in sorted(combination, reverse=True):
            n = combination[length]
            rows.append((length, used[length], n, times, bins, offset))
            offset += length * n
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        bins += times
    return rows


def pieces(docs: DataFrame, vocabulary: str, end_id: int, drop_space: bool = True, capacity: int = CAPACITY, with_ids: bool = False, lean: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank[, ids]); rank among the pieces of the length in the part."""
    ship_package(docs.sparkSession)
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        enc, part, seen = encoder(vocabulary, drop_space), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b, data, offs in tb.pieces(batches, "text", SLICE_BYTES // 2 if lean else SLICE_BYTES):
            ids, begins = with_end(*enc.encode(data, offs), end_id)
            each = -(-np.diff(begins) // capacity)
            doc = np.repeat(np.arange(len(each)), each)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
            start = piece * capacity
            length = np.minimum(np.diff(begins)[doc] - start, capacity)
            order = np.argsort(length, kind="stable")
            have = np.bincount(length, minlength=capacity + 1)
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.repeat(np.cumsum(have) - have, have)
            rank += seen[length]
            seen += have
            wide = ids.astype("<u4")
            at = (begins[doc] + start).tolist()
            crc = [zlib.crc32(wide[s : s + n]) for s, n in zip(at, length.tolist())]
            out = [b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank)]
            if with_ids:
                # pieces stand one after the other, so the list column is the flat ids and where each begins
                out.append(pa.ListArray.from_arrays(pa.array([*at, len(wide)], pa.int32()), pa.array(wide.view("<i4"))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"][: len(out)])
        if lean:
            del enc
            tb.forget()  # 85 MB, not kept by every worker that had a task

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, vocabulary: str, end_id: int, drop_space: bool = True, capacity: int = CAPACITY, with_ids: bool = False, lean: bool = False) -> DataFrame:
    """Each piece with its ``sequence_id`` and ``offset``. ``lean`` is for
    executors that other stages have filled: less text at once, and workers
    that drop their tokenizer after each task, for more CPU time."""
    p = stored(pieces(docs, vocabulary, end_id, drop_space, capacity, with_ids, lean), "pieces", LEAN_BATCH if lean else BATCH_BYTES)
    counts = stored(p.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, first, n, _, start, offset in plan(totals, capacity):
        slots.setdefault(length, []).append((first, n, start, offset))
    # at most `capacity` lengths and combinations, so this table never grows beyond that
    places = p.sparkSession.createDataFrame(list(slots.items()), "length long, slots array<struct<first: long, n: long, bin: long, offset: long>>")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = p.join(base, ["part", "length"]).join(F.broadcast(places), "length").withColumn("rank", F.col("rank") + F.col("base"))
    # the ranks of a length fall to its combinations in order: the last that begins at or before the rank
    held = ranked.withColumn("slot", F.element_at(F.filter("slots", lambda x: x["first"] <= F.col("rank")), -1))
    names = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids") if c in p.columns]
    return held.select(
        *names,
        F.expr("slot.bin + (rank - slot.first) div slot.n").alias("sequence_id"),
        F.expr("slot.offset + (rank - slot.first) % slot.n * length").alias("offset"),
    )
