"""A corpus as packed chunks of whole documents, and counting over them.

Operators that count strings of the whole corpus work in rounds: every chunk
asks for its distinct keys once, keys are dealt over slots by their value (a
key that fills a third of the corpus is one entry per chunk), and each slot
answers every chunk. Rows are blobs, so the work stays in vectorised code while
Spark deals, joins and recovers it. A chunk makes at most ``FAN`` rows, however
large the corpus. Up to ``DIRECT`` times as many chunks each slot settles all
it is asked, and requests are moved once; beyond, a slot's pieces are merged in
bundles of ``FAN``, and the bundles ask finer slots in turn (:func:`resolve`).
"""

from __future__ import annotations

from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from . import textbytes as tb
from .scratch import stored

CHUNK_BYTES = 4 << 20
#: rows that a chunk, or a bundle of chunks, asks with at most
FAN = 2048
#: a slot settles the pieces of at most ``DIRECT * FAN`` chunks at once: with chunks of 6 MB some 50 MB
DIRECT = 4


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def expand(blob, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype)


def _planes(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)


def encode(*arrays: np.ndarray) -> bytes:
    """Arrays in one blob, by byte planes. Unsigned 64-bit ones are hashes, best
    sorted: of their differences only the upper planes can be compressed."""
    parts = []
    for a in arrays:
        if a.dtype == tb.U:
            planes = _planes(np.diff(a, prepend=tb.U(0)))
            fifth = zstandard.compress(planes[5].tobytes(), 1)
            raw = len(fifth).to_bytes(4, "little") + planes[:5].tobytes() + fifth + zstandard.compress(planes[6:].tobytes(), 1)
        else:
            if a.dtype.kind == "i" and (not len(a) or a.min() >= 0):
                fits = np.min_scalar_type(int(a.max()) if len(a) else 0)
                a = a.astype(fits if fits != tb.U else np.int64)
            raw = zstandard.compress(_planes(a).tobytes(), 1)
        parts.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(4, "little") + raw)
    return np.array([len(parts), *map(len, parts)], "<i4").tobytes() + b"".join(parts)


def decode(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    at, out = 4 * (n + 1), []
    for size in np.frombuffer(blob, "<i4", n, 4).tolist():
        part = blob[at : at + size]
        kind, many, raw = np.dtype(part[:4].decode().strip()), int.from_bytes(part[4:8], "little"), part[8:]
        if kind == tb.U:
            cut = 4 + 5 * many
            upper = cut + int.from_bytes(raw[:4], "little")
            data = raw[4:cut] + zstandard.decompress(raw[cut:upper]) + zstandard.decompress(raw[upper:])
        else:
            data = zstandard.decompress(raw)
        a = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, many).T).view(kind).reshape(-1)
        out.append(np.cumsum(a, dtype=tb.U) if kind == tb.U else a)
        at += size
    return out


class Packed(NamedTuple):
    chunks: DataFrame
    count: int

    @property
    def slots(self) -> int:
        return max(1, min(self.count, FAN))


def pack(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), chunk_bytes: int = CHUNK_BYTES) -> Packed:
    """The written table (chunk, data, sizes, then an array for each ``keep``
    column): whole texts in chunks of about ``chunk_bytes``, null as empty;
    chunks are numbered from 0."""
    ship_package(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in keep}

    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def row():
            data = zstandard.compress(b"".join(h[1].tobytes() for h in held), 3)
            sizes = squeeze(np.concatenate([np.diff(h[2]) for h in held]).astype("<i8"))
            kept = [pa.concat_arrays([h[0].column(i) for h in held]) for i in range(len(keep))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), k) for k in kept]
            return pa.RecordBatch.from_arrays([pa.array([part + seq], pa.int64()), pa.array([data], pa.binary()), pa.array([sizes], pa.binary()), *lists], names=["chunk", "data", "sizes", *keep])

        for b, data, offs in tb.pieces(batches, "text"):
            held.append((b, data, offs))
            size += len(data)
            if size >= chunk_bytes:
                yield row()
                held, size, seq = [], 0, seq + 1
        if held:
            yield row()

    found = stored(rows.mapInArrow(run, "chunk long, data binary, sizes binary" + "".join(f", `{c}` array<{k}>" for c, k in kinds.items())), "chunks")
    part = F.shiftright("chunk", 32).cast("int")
    have = sorted(tuple(r) for r in found.groupBy(part).count().collect())  # a row per task
    before = np.zeros(have[-1][0] + 1 if have else 1, np.int64)
    at = 0
    for p, n in have:
        before[p], at = at, at + n
    return Packed(found.withColumn("chunk", F.get(F.lit(before), part) + F.col("chunk").bitwiseAND(F.lit((1 << 32) - 1))), at)


def texts(data, sizes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a packed chunk."""
    raw = expand(data, np.uint8)
    return raw, np.concatenate([[0], np.cumsum(expand(sizes, "<i8"))]).astype(np.int64)


def slices(data: np.ndarray, offs: np.ndarray, most: int = 1 << 20):
    """(first document, bytes, offsets) of runs of whole documents of at most ``most`` bytes."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def edges(slot: int, slots: int, sub: int) -> np.ndarray:
    """The keys at which ``slot`` of ``slots`` equal ranges falls into ``sub`` ranges."""
    return np.array([((slot * sub + j) << 64) // (slots * sub) for j in range(1, sub)], dtype=tb.U)


def split(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each range's keys begin among sorted keys, and their end."""
    return np.concatenate([[0], np.searchsorted(keys, at), [len(keys)]]).astype(np.int64)


#: an answer, and two numbers that Spark can see
Answer = tuple[bytes, int, int]


class Job(Protocol):
    def settle(self, bodies: list[bytes]) -> list[Answer]:
        """Answers for all the requests of one slot."""

    def merge(self, bodies: list[bytes], at: np.ndarray) -> list[bytes]:
        """The requests as one, cut at the keys ``at``."""

    def spread(self, bodies: list[bytes], answers: list[Answer]) -> list[Answer]:
        """Answers for the requests from those for what ``merge`` made of them."""


ANSWER = "slot long, unit long, got binary, a long, b long"


def _table(slot, unit, answers: list[Answer]) -> pd.DataFrame:
    got, a, b = zip(*answers)
    return pd.DataFrame({"slot": slot, "unit": unit, "got": got, "a": a, "b": b})


def resolve(pieces: DataFrame, units: int, slots: int, job: Job, fan: int | None = None) -> DataFrame:
    """(slot, unit, got, a, b) for each row (slot, unit, body) of ``pieces``:
    unit, from 0 up to ``units``, asks in at most ``fan`` rows, each for a slot
    of the keys. Rows grow with the units, not with their square."""
    fan = fan or FAN
    if units <= DIRECT * fan:

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            out = _table(pdf["slot"], pdf["unit"], job.settle(list(pdf["body"])))
            tb.release()
            return out

        return pieces.groupBy("slot").applyInPandas(settle, ANSWER)
    bundles = -(-units // fan)
    sub = min(bundles, fan)
    put = stored(pieces.withColumn("bundle", F.floor(F.col("unit") / fan).cast("long")), "pieces")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        slot = int(pdf["slot"].iloc[0])
        made = job.merge(list(pdf["body"]), edges(slot, slots, sub))
        tb.release()
        return pd.DataFrame({"slot": slot * sub + np.arange(sub), "unit": pdf["bundle"].iloc[0], "body": made})

    def spread(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        back = back.sort_values("part")
        out = _table(pdf["slot"], pdf["unit"], job.spread(list(pdf["body"]), list(zip(back["got"], back["a"], back["b"]))))
        tb.release()
        return out

    merged = stored(put.groupBy("slot", "bundle").applyInPandas(merge, "slot long, unit long, body binary"), "merged")
    found = resolve(merged, bundles, slots * sub, job, fan)
    back = found.select(F.floor(F.col("slot") / sub).cast("long").alias("slot"), F.col("unit").alias("bundle"), F.col("slot").alias("part"), "got", "a", "b")
    return put.groupBy("slot", "bundle").cogroup(back.groupBy("slot", "bundle")).applyInPandas(spread, ANSWER)
