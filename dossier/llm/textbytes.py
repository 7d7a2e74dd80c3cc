"""Vectorised work on the UTF-8 bytes of a batch of texts.

A batch is one byte array with document offsets. Words, windows and lines are
index ranges into it; their identity is a 64-bit polynomial hash from prefix
sums over a table of random byte values, so that any range costs O(1).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_R = 0x9E3779B97F4A7C15
_RI = pow(_R, -1, 1 << 64)
BYTE_VALUES = np.random.RandomState(7).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(U) * U(2) + U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not the GNU C library
    _trim = None


def release() -> None:
    """Gives freed memory back: Python workers outlive their tasks, and an
    executor keeps several."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: what this worker keeps between tasks, such as tokenizers
CACHES: list[dict] = []


def forget() -> None:
    """Drops what earlier stages left in this worker, for stages that have no use for it."""
    for held in CACHES:
        held.clear()
    release()


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches, column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``most`` bytes of text (one longer
    text is a slice of its own), each with its bytes and offsets."""
    for b in batches:
        data, offs = column_bytes(b.column(b.schema.get_field_index(column)))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield b.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
        del b, data
        release()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


class Hasher:
    """Hash of any range of the bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        p = np.full(n + 1, U(_R), U)
        p[0] = U(1)
        np.multiply.accumulate(p, out=p)
        self.pre = np.zeros(n + 1, U)
        np.cumsum(BYTE_VALUES[data] * p[:n], out=self.pre[1:])
        p = np.full(n + 1, U(_RI), U)
        p[0] = U(1)
        self.inv = np.multiply.accumulate(p, out=p)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.pre[end] - self.pre[start]) * self.inv[start]
        return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; a word never crosses a document."""
    n = len(data)
    inside = ~sep[data]
    edge = np.zeros(n + 1, bool)
    edge[offs[:-1]] = True
    start = inside.copy()
    start[1:] &= sep[data[:-1]] | edge[1:n]
    starts = np.flatnonzero(start)
    end = np.ones(n, bool) if n else np.zeros(0, bool)
    if n:
        end[:-1] = ~inside[1:] | edge[1:n]
        end &= inside
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def per_doc(doc: np.ndarray, n: int, weights=None) -> np.ndarray:
    """Counts, or sums of integer weights, by document."""
    if weights is None:
        return np.bincount(doc, minlength=n).astype(np.int64)
    return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more; whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    often, later = np.empty(len(k), bool), np.empty(len(k), bool)
    later[order] = same[:-1]
    often[order] = same[:-1] | same[1:]
    return often, later
