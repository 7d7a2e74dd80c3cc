"""Whole texts to token ids with a public tokenizer, one batch at a time.

Texts are cut where the tokenizer's own pre-tokenizer is sure to cut: before
white space that follows something else, and between an ASCII letter and ASCII
punctuation. The tokenizers library encodes each distinct piece once; its ids
are kept in a bounded hash table per Python worker. Texts with other white
space than blanks and line feeds, and pieces of over ``LONG`` bytes, go to the
library whole each time.
"""

from __future__ import annotations

import os

import numpy as np

from . import textbytes as tb

LONG = 64
SLOTS = 1 << 21

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[0x21:0x7F] = True
_PUNCT[0x30:0x3A] = False
_PUNCT &= ~_LETTER
_ODD = np.zeros(256, bool)
_ODD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def odd_documents(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents with white space other than blanks and line feeds."""
    at = np.flatnonzero(_ODD[data])
    lead = np.flatnonzero(_LEADS[data])
    if len(lead):
        pad = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = pad[lead], pad[lead + 1], pad[lead + 2]
        rare = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        rare |= (a == 0xE1) & ((b == 0x9A) | (b == 0xA0))
        rare |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        rare |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        rare |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        at = np.concatenate([at, lead[rare]])
    odd = np.zeros(len(offs) - 1, bool)
    odd[np.searchsorted(offs, at, "right") - 1] = True
    return odd


def cut(data: np.ndarray, offs: np.ndarray, drop_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces; with ``drop_space`` without their leading white space."""
    n = len(data)
    gap = _GAP[data]
    first = gap.copy()
    first[1:] &= ~gap[:-1]
    first[1:] |= _PUNCT[data[1:]] & _LETTER[data[:-1]]
    odd = odd_documents(data, offs)
    if odd.any():
        first &= ~np.repeat(odd, np.diff(offs))
    edges = offs[:-1][np.diff(offs) > 0]
    first[edges] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)[: len(starts)]
    if drop_space:
        filled = np.flatnonzero(~gap)
        to = np.searchsorted(filled, starts)
        starts = np.where(to < len(filled), np.append(filled, n)[to], n)
        keep = starts < ends
        starts, ends = starts[keep], ends[keep]
    return starts, ends


#: pieces that the tokenizer encodes at once: its result for one takes far more room than the ids
BATCH_WORDS = 2048
#: bytes of text encoded at once: offsets, hashes and slots of its words take some seventy times as much
SLICE_BYTES = 1 << 19


class Encoder:
    """``drop_space``: the tokenizer ignores white space between words."""

    def __init__(self, path: str, drop_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.drop_space = drop_space
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(SLOTS, tb.U)
        self.at = np.zeros(SLOTS, np.int32)
        self.length = np.zeros(SLOTS, np.uint16)
        self.pool = np.zeros(1 << 20, self.dtype)
        self.used = self.filled = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        slot = (keys & tb.U(SLOTS - 1)).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            s = slot[open_]
            have = self.keys[s]
            hit = have == keys[open_]
            out[open_[hit]] = s[hit]
            open_ = open_[~hit & (have != 0)]
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
        return out

    def _append(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), self.dtype, int(length.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(length) - length
        self.used += len(flat)
        return at, length

    def _texts(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist())]
        out = []
        for k in range(0, len(words), BATCH_WORDS):
            out += [x.ids for x in self.tokenizer.encode_batch_fast(words[k : k + BATCH_WORDS], add_special_tokens=False)]
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and where each text's ids begin."""
        starts, ends = cut(data, offs, self.drop_space)
        if self.filled > SLOTS // 2 or self.used > 1 << 24:
            self._clear()
        keys = tb.Hasher(data)(starts, ends) | tb.U(1)
        brief = ends - starts <= LONG
        slot = self._find(keys)
        raw = data.tobytes()
        new, one = np.unique(keys[brief & (slot < 0)], return_index=True)
        if len(new):
            where = np.flatnonzero(brief & (slot < 0))[one]
            at, length = self._append(self._texts(raw, starts[where], ends[where]))
            self._insert(new, at, length)
            slot = np.where(brief, self._find(keys), -1)
        mark = self.used
        at, length = self.at[slot].astype(np.int64), self.length[slot].astype(np.int64)
        long = np.flatnonzero(~brief)
        if len(long):
            at[long], length[long] = self._append(self._texts(raw, starts[long], ends[long]))
        total = int(length.sum())
        begin = np.cumsum(length) - length
        ids = self.pool[np.repeat(at - begin, length) + np.arange(total)]
        self.used = mark
        pre = np.append(begin, total)
        return ids, pre[np.searchsorted(starts, offs)]

    def _insert(self, keys: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
        slot = (keys & tb.U(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == 0
            took, one = np.unique(slot[left[free]], return_index=True)
            got = left[free][one]
            self.keys[took], self.at[took], self.length[took] = keys[got], at[got], length[got]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        self.filled += len(keys)


_READY: dict[tuple[str, bool], Encoder] = {}
tb.CACHES.append(_READY)


def encoder(path: str, drop_space: bool) -> Encoder:
    """The worker's encoder, with what it has learnt from earlier batches."""
    if (path, drop_space) not in _READY:
        _READY[path, drop_space] = Encoder(path, drop_space)
    return _READY[path, drop_space]


def with_end(ids: np.ndarray, begins: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text."""
    n = len(begins) - 1
    out = np.full(len(ids) + n, end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(begins))] = ids
    return out, begins + np.arange(n + 1)
