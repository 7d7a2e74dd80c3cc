"""Language-model scoring with a weighted backoff automaton.

A trigram model with Dirichlet smoothing. With counts c over the training
texts, N tokens and V distinct ones,

    P(w)    = (c(w) + 1) / (N + V + 1)
    P(w|h)  = (c(h w) + K1 P(w)) / (c(h) + K1)
    P(w|gh) = (c(g h w) + K2 P(w|h)) / (c(g h) + K2)

As an automaton (:class:`Automaton`): the states are the root, each seen word
and each seen pair of words, as the longest history that training knows. A
state has an arc for each word seen after it, with the word's log-probability,
to the state of the longest seen end of history and word; and a failure arc to
the state of the shorter history, with weight log(K / (c + K)). The root has an
arc for every word. A text starts in the begin state and ends with an end
token; a traversal from left to right carries the state and adds the weights of
the arcs it takes.

No machine holds the whole automaton. Chunks of documents ask slots for the
counts of their own distinct n-grams (:mod:`.chunks`) and build the part that
their texts can visit; n-grams are known by 64-bit hashes. Texts are walked
side by side in stretches: a state depends on two words at most, so a stretch
that begins two words early at the root is in the right state where it counts.

Scores are rounded to six places. Edge cases: a null or blank text is the end
token alone; a null doc_id counts as the empty string where folds are dealt;
repeated rows count as often as they stand and get equal scores; without
training texts every token is unknown and N is 0; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from . import textbytes as tb
from .langid import fold
from .scratch import stored

#: strength of the shorter history against the counts after one and after two
#: words; held-out texts of sf0.1 are likeliest near these (of 2 to 32 each)
K = (32.0, 8.0)
END = tb.U(0x5851F42D4C957F2D)
BEGIN = tb.U(0x14057B7EF767814F)
STRETCH = 128
#: larger chunks ask for fewer n-grams twice
CHUNK_BYTES = 6 << 20


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each document, and their document."""
    tok, doc = [], []
    for at, part, o in chunks.slices(data, offs):
        part = tb.LOWER[part]
        s, e, d = tb.words(part, o)
        n, count = len(o) - 1, tb.per_doc(d, len(o) - 1)
        t = np.full(len(s) + n, END, tb.U)
        t[np.arange(len(s)) + d] = tb.Hasher(part)(s, e)
        tok.append(t)
        doc.append(at + np.repeat(np.arange(n), count + 1))
    if not tok:
        return np.zeros(0, tb.U), np.zeros(0, np.int64)
    return np.concatenate(tok), np.concatenate(doc)


def _gram(history: np.ndarray, tok: np.ndarray) -> np.ndarray:
    return tb.mix(history * tb.U(3) + tb.mix(tok ^ tb.U(0xC2B2AE3D27D4EB4F)))


def ngrams(tok: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token with the one before (the begin counts as one), hash
    with the two before, the positions of the latter (all but a text's first
    token), and the positions of first tokens."""
    new = np.ones(len(tok), bool)
    new[1:] = doc[1:] != doc[:-1]
    before = np.where(new, BEGIN, np.roll(tok, 1))
    pair = _gram(before, tok)
    later = np.flatnonzero(~new)
    return pair, _gram(tb.mix(pair[later - 1]), tok[later]), later, np.flatnonzero(new)


def _distinct(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their ``n``."""
    if not len(keys):
        return keys, n.astype(np.int64)
    order = np.argsort(keys)
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n[order].astype(np.int64), first)


class Counts:
    """Requests are three pairs (distinct keys, their counts in training), for
    one, two and three words; answers the counts in the whole corpus, and as
    numbers the distinct words and tokens of training, told once."""

    def _summed(self, bodies):
        asked = [chunks.decode(x) for x in bodies]
        return asked, [_distinct(np.concatenate([a[k] for a in asked]), np.concatenate([a[k + 1] for a in asked])) for k in (0, 2, 4)]

    def _told(self, asked, known, words, tokens):
        out = []
        for a in asked:
            got = [n[np.searchsorted(keys, a[2 * k])] if len(a[2 * k]) else np.zeros(0, np.int64) for k, (keys, n) in enumerate(known)]
            out.append((chunks.encode(*got), 0, 0) if out else (chunks.encode(*got), words, tokens))
        return out

    def settle(self, bodies):
        asked, known = self._summed(bodies)
        return self._told(asked, known, int((known[0][1] > 0).sum()), int(known[0][1].sum()))

    def merge(self, bodies, at):
        _, known = self._summed(bodies)
        cuts = [chunks.split(keys, at) for keys, _ in known]
        return [chunks.encode(*(x[c[i] : c[i + 1]] for c, both in zip(cuts, known) for x in both)) for i in range(len(at) + 1)]

    def spread(self, bodies, answers):
        asked, known = self._summed(bodies)
        got = [chunks.decode(x) for x, _, _ in answers]
        known = [(keys, np.concatenate([g[k] for g in got]).astype(np.int64)) for k, (keys, _) in enumerate(known)]
        return self._told(asked, known, sum(a for _, a, _ in answers), sum(b for _, _, b in answers))


def _requests(packed: chunks.Packed) -> DataFrame:
    slots = packed.slots

    def run(batches):
        for b in batches:
            for chunk, data, sizes, held in zip(*(b.column(b.schema.get_field_index(c)) for c in ("chunk", "data", "sizes", "held"))):
                tok, doc = tokens(*chunks.texts(data.as_py(), sizes.as_py()))
                train = ~np.array(held.as_py(), bool)[doc]
                pair, triple, later, _ = ngrams(tok, doc)
                whole = [_distinct(keys, n) for keys, n in ((tok, train), (pair, train), (triple, train[later]))]
                cuts = [chunks.split(keys, chunks.edges(0, 1, slots)) for keys, _ in whole]
                ones = [i for i in range(slots) if any(c[i] < c[i + 1] for c in cuts)]
                bodies = [chunks.encode(*(x[c[i] : c[i + 1]] for c, both in zip(cuts, whole) for x in both)) for i in ones]
                yield pa.RecordBatch.from_arrays([pa.array(ones, pa.int64()), pa.array([chunk.as_py()] * len(ones), pa.int64()), pa.array(bodies, pa.binary())], names=["slot", "unit", "body"])
                del whole, tok, doc, pair, triple, bodies
                tb.release()

    return packed.chunks.select("chunk", "data", "sizes", "held").mapInArrow(run, "slot long, unit long, body binary")


class Automaton:
    """The states and arcs that some texts can visit. State 0 is the root, word
    t of the texts is state 1 + t, the begin is one more, then come the pairs."""

    def __init__(self, tok: np.ndarray, doc: np.ndarray, counts, words: int, total: int, k: tuple[float, float]):
        """``counts``: of the sorted distinct words, pairs and triples of the texts."""
        pair, triple, later, begins = ngrams(tok, doc)
        c1, c2, c3 = (np.asarray(c, np.int64) for c in counts)
        known, self.word = np.unique(tok, return_inverse=True)
        _, one2, self_pair = np.unique(pair, return_index=True, return_inverse=True)
        _, one3 = np.unique(triple, return_index=True)
        n = len(known)
        self.words, self.begin = n, n + 1
        history = np.append(c1, c1[np.searchsorted(known, END)])  # each text begins and ends once
        before = np.roll(self.word, 1)
        before[begins] = n
        # arcs of the root, of words and of pairs: (state, word), log-probability, next state
        p1 = (c1 + 1) / (total + words + 1)
        h, w = before[one2], self.word[one2]
        p2 = (c2 + k[0] * p1[w]) / (history[h] + k[0])
        at = later[one3]
        g, x = self_pair[at - 1], self_pair[at]
        p3 = (c3 + k[1] * p2[x]) / (c2[g] + k[1])
        two, three = c2 > 0, c3 > 0
        arcs = np.concatenate([np.arange(n), ((1 + h) * n + w)[two], ((n + 2 + g) * n + self.word[at])[three]])
        weight = np.log10(np.concatenate([p1, p2[two], p3[three]]))
        to = np.concatenate([np.where(c1 > 0, 1 + np.arange(n), 0), n + 2 + np.flatnonzero(two), (n + 2 + x)[three]])
        order = np.argsort(arcs)
        self.arcs, self.weight, self.to = arcs[order], weight[order], to[order]
        self.failure = np.concatenate([[0], np.zeros(n + 1, np.int64), 1 + w])
        self.failure_weight = np.log10(np.concatenate([[1.0], k[0] / (history + k[0]), k[1] / (c2 + k[1])]))
        self.base = np.log10(p1)[self.word]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads a word in each state: the next states and the weights of the arcs taken."""
        state, weight = state.copy(), np.zeros(len(state))
        left = np.arange(len(state))
        while len(left):
            key = state[left] * self.words + word[left]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[at] == key
            took = left[hit]
            weight[took] += self.weight[at[hit]]
            state[took] = self.to[at[hit]]
            left = left[~hit]
            weight[left] += self.failure_weight[state[left]]
            state[left] = self.failure[state[left]]
        return state, weight

    def walk(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Weight of each token of the texts that lie between ``starts`` and ``ends``."""
        out = np.zeros(len(self.word))
        n = -(-(ends - starts) // STRETCH)
        text = np.repeat(np.arange(len(starts)), n)
        first = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        last = np.minimum(first + STRETCH, ends[text])
        at = np.maximum(first - 2, starts[text])
        state = np.where(at == starts[text], self.begin, 0)
        order = np.argsort(at - last, kind="stable")  # longest first
        first, last, at, state = (x[order] for x in (first, last, at, state))
        for _ in range(STRETCH + 2):
            open_ = int(np.searchsorted(at - last, 0))
            if not open_:
                break
            first, last, at, state = (x[:open_] for x in (first, last, at, state))
            state, weight = self.step(state, self.word[at])
            counts = at >= first
            out[at[counts]] = weight[counts]
            at = at + 1
        return out


def score(docs: DataFrame, folds: int = 7, held_fold: int = 2, k: tuple[float, float] = K, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and scores of every text: n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(*keep, (fold(F.col("doc_id"), folds) == held_fold).alias("held"), "text")
    packed = chunks.pack(rows, (*keep, "held"), CHUNK_BYTES)
    answers = stored(chunks.resolve(_requests(packed), packed.count, packed.slots, Counts()), "answers")
    words, total = (int(x or 0) for x in answers.agg(F.sum("a"), F.sum("b")).first())
    mine = answers.groupBy(F.col("unit").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("slot", "got"))).alias("got"))  # at most FAN a chunk

    def run(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            for i in range(b.num_rows):
                tok, doc = tokens(*chunks.texts(col("data")[i].as_py(), col("sizes")[i].as_py()))
                n = len(col("held")[i])
                got = [chunks.decode(g["got"]) for g in col("got")[i].as_py()]
                counts = [np.concatenate([g[x] for g in got]) for x in range(3)]
                model = Automaton(tok, doc, counts, words, total, k)
                starts = np.searchsorted(doc, np.arange(n))
                add = lambda x: np.add.reduceat(x, starts)
                weight = model.walk(starts, np.append(starts[1:], len(tok)))
                seen = (counts[0] > 0)[model.word].astype(np.int64)
                out = [tb.per_doc(doc, n), add(seen), np.full(n, total), np.round(add(model.base), 6), np.round(add(weight), 6)]
                yield pa.RecordBatch.from_arrays([*(col(x)[i].values for x in (*keep, "held")), *map(pa.array, out)], names=[*keep, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                del tok, doc, got, counts, model, weight, seen
                tb.release()

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return packed.chunks.join(mine, "chunk").select(*keep, "held", "data", "sizes", "got").mapInArrow(run, f"{fields}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
