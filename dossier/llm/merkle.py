"""Merkle manifest of a dataset: who has a row, its siblings and the root can
check the row.

Every row is a leaf; leaves of a group in the order of their key are joined
three by three up to a subroot, subroots in the order of their group up to the
root. A tree is cut into aligned subtrees of ``height`` levels, the blocks; the
roots of blocks are the leaves of the next tier, until one block is left. A
block is one row of a table, with its nodes in van Emde Boas order: the upper
half of the levels first, then each subtree below it, every part laid out the
same way, so that a walk from a leaf to the root stays within few stretches
whatever the size of a cache line or page. :func:`address` gives a node's place
and serves building and reading alike.

A task holds one block: 3**height leaves at most, however large a group is.

Edge cases: a null value is hashed as ``-``; a null key stands first in its
group, a null group first of all; rows with equal keys stand in the order of
their leaves, equal rows are leaves of their own; an empty table has an empty
manifest. Only the named columns are hashed; others, and what they are called,
change nothing.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranked import ranked
from .scratch import stored

ARITY = 3
#: levels of edges in a block: 729 leaves, 35 KB of nodes
HEIGHT = 6
DIGEST = 32


def size(levels: int) -> int:
    """Nodes of a full tree."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of a depth in a tree of ``levels`` levels."""
    at = np.zeros_like(index)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = ARITY ** (depth - top)
        at = at + size(top) + index // below * size(levels - top)
        index, depth, levels = index % below, depth - top, levels - top
    return at


@functools.cache
def places(levels: int) -> list[list[int]]:
    """All addresses, by depth."""
    return [address(levels, d, np.arange(ARITY**d)).tolist() for d in range(levels)]


def joined(*hexes: str) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def levels_for(leaves: int) -> int:
    """Levels of a tree that ends in one node."""
    n = 1
    while ARITY ** (n - 1) < leaves:
        n += 1
    return n


def build(leaves: Sequence[bytes], levels: int) -> bytes:
    """The nodes of a block; those that a ragged block lacks are zero."""
    out = bytearray(size(levels) * DIGEST)
    row = [x.hex() for x in leaves]
    for depth in range(levels - 1, -1, -1):
        for at, node in zip(places(levels)[depth], row):
            out[at * DIGEST : (at + 1) * DIGEST] = bytes.fromhex(node)
        if depth:
            row = [joined(*row[i : i + ARITY]) for i in range(0, len(row), ARITY)]
    return bytes(out)


class Step(NamedTuple):
    """One level of a proof: the siblings of a node and its place among them."""

    place: int
    siblings: list[str]

    def up(self, node: str) -> str:
        return joined(*self.siblings[: self.place], node, *self.siblings[self.place :])


def proofs(nodes: bytes, levels: int, leaves: int) -> Iterator[list[Step]]:
    """The steps within a block, for each of its leaves."""
    text = nodes.hex()
    rows = []
    n = leaves
    for depth in range(levels - 1, 0, -1):
        rows.append([text[at * 64 : at * 64 + 64] for at in places(levels)[depth][:n]])
        n = -(-n // ARITY)
    for leaf in range(leaves):
        steps, i = [], leaf
        for row in rows:
            first = i - i % ARITY
            steps.append(Step(i - first, row[first:i] + row[i + 1 : first + ARITY]))
            i //= ARITY
        yield steps


def packed(steps: list[Step]) -> bytes:
    return b"".join(bytes([s.place << 2 | len(s.siblings)]) + bytes.fromhex("".join(s.siblings)) for s in steps)


def unpacked(data: bytes) -> list[Step]:
    steps, i = [], 0
    while i < len(data):
        n = data[i] & 3
        body = data[i + 1 : i + 1 + n * DIGEST].hex()
        steps.append(Step(data[i] >> 2, [body[k : k + 64] for k in range(0, len(body), 64)]))
        i += 1 + n * DIGEST
    return steps


def _named(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _with(batch: pa.RecordBatch, drop: set[str], **columns: pa.Array) -> pa.RecordBatch:
    kept = {n: c for n, c in zip(batch.schema.names, batch.columns) if n not in drop}
    return pa.RecordBatch.from_pydict(kept | columns)


def tiers(leaves: DataFrame, own: list[str], height: int = HEIGHT) -> list[DataFrame]:
    """The blocks of all groups, from the leaves (g, at, digest, own columns) to
    one block for each group: (g, block, sole, own columns as arrays, levels, leaves, nodes)."""
    most = ARITY**height
    out = []
    while True:
        item = F.struct("at", "digest", *own)
        got = leaves.groupBy("g", F.floor(F.col("at") / most).cast("long").alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        # only of a full first block it is open whether others follow
        more = got.where("block = 1").select("g", F.lit(0).cast("long").alias("block"), F.lit(True).alias("more"))
        got = got.join(more, ["g", "block"], "left").withColumn("sole", (F.col("block") == 0) & F.col("more").isNull())
        of = lambda c: F.transform("items", lambda x: x[c]).alias(c)
        flat = got.select("g", "block", "sole", of("digest"), *map(of, own))

        def run(batches):
            for b in batches:
                digests = _named(b, "digest")
                levels = [levels_for(len(d)) if sole else height + 1 for d, sole in zip(digests, _named(b, "sole"))]
                nodes = [build(d, n) for d, n in zip(digests, levels)]
                yield _with(b, {"digest"}, levels=pa.array(levels, pa.int32()), leaves=pa.array(map(len, digests), pa.int32()), nodes=pa.array(nodes, pa.binary()))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema if f.name != "digest")
        out.append(stored(flat.mapInArrow(run, f"{kinds}, levels int, leaves int, nodes binary"), "blocks"))
        if out[-1].where("not sole").isEmpty():
            return out
        # a block's root is the first of its nodes
        leaves, own = out[-1].where("not sole").select("g", F.col("block").alias("at"), F.substring("nodes", 1, DIGEST).alias("digest")), []


def _subroots(blocks: list[DataFrame]) -> DataFrame:
    each = [b.where("sole").select("g", F.substring("nodes", 1, DIGEST).alias("digest")) for b in blocks]
    return functools.reduce(DataFrame.union, each)


class Manifest(NamedTuple):
    """Blocks of the groups' trees and of the tree over their subroots, by tier."""

    groups: list[DataFrame]
    top: list[DataFrame]


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*values: Column) -> Column:
    """Digest of a row, as 64 hex digits."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def manifest(rows: DataFrame, group: str, key: str, digest: str, own: Sequence[str] = (), height: int = HEIGHT) -> Manifest:
    """Builds the trees over ``digest`` (hex); ``key`` and the ``own`` columns are kept by the leaves' blocks."""
    g = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group)))
    leaves = rows.select(g.alias("g"), key, F.unhex(digest).alias("digest"), *own)
    groups = tiers(ranked(leaves, "g", [key, "digest"]), [key, *own], height)
    subroots = _subroots(groups).select(F.lit("").alias("g"), F.col("g").alias("named"), "digest")
    return Manifest(groups, tiers(ranked(subroots, "g", ["named"]), ["named"], height))


_PATH = "path binary, subroot binary, root binary"


def _handed_down(blocks: DataFrame, most: int, own: str | None) -> DataFrame:
    """For each leaf of the blocks, which stands for a block or group of the
    tier below, the steps from there to the root."""

    def run(batches):
        for b in batches:
            for i, nodes in enumerate(_named(b, "nodes")):
                g, block, path, sub, root = (_named(b, c)[i] for c in ("g", "block", "path", "subroot", "root"))
                n, levels = _named(b, "leaves")[i], _named(b, "levels")[i]
                digests = [nodes[a * DIGEST : (a + 1) * DIGEST] for a in places(levels)[-1][:n]]
                yield pa.RecordBatch.from_pydict({
                    "g": pa.array(_named(b, own)[i] if own else [g] * n, pa.string()),
                    "block": pa.array([0] * n if own else range(block * most, block * most + n), pa.int64()),
                    "sole": pa.array([own is not None] * n),
                    "path": pa.array((packed(s) + path for s in proofs(nodes, levels, n)), pa.binary()),
                    "subroot": pa.array(digests if own else [sub] * n, pa.binary()),
                    "root": pa.array([root] * n, pa.binary()),
                })

    return blocks.mapInArrow(run, f"g string, block long, sole boolean, {_PATH}")


def _down(blocks: list[DataFrame], above: DataFrame, most: int, own: str | None) -> tuple[DataFrame, DataFrame | None]:
    """From the last tier to the first: the first's blocks with the way from
    their roots to the root, and those ways for what the leaves stand for."""
    given = above
    for k in range(len(blocks) - 1, 0, -1):
        met = blocks[k].join(given, ["g", "block", "sole"])
        given = stored(above.union(_handed_down(met, most, None)), "ways")
    met = blocks[0].join(given, ["g", "block", "sole"])
    return met, _handed_down(met, most, own) if own else None


def _answers(blocks: DataFrame, key: str, changed: str) -> DataFrame:
    kind = blocks.schema[key].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                nodes, levels, n, path, sub, root, keys, others = (_named(one, c)[0] for c in ("nodes", "levels", "leaves", "path", "subroot", "root", key, changed))
                upper, sub, root = unpacked(path), sub.hex(), root.hex()
                own = [nodes[a * DIGEST : (a + 1) * DIGEST].hex() for a in places(levels)[-1][:n]]
                hashes, folded = [], []
                for node, other, steps in zip(own, others, proofs(nodes, levels, n)):
                    steps = steps + upper
                    hashes.append(joined(*(x for s in steps for x in s.siblings)))
                    node = node if other is None else other.hex()
                    for s in steps:
                        node = s.up(node)
                    folded.append(node)
                yield pa.RecordBatch.from_pydict({
                    key: pa.array(keys, one.schema.field(key).type.value_type),
                    "leaf": pa.array(own), "subroot": pa.array([sub] * n), "root": pa.array([root] * n),
                    "proof_sha256": pa.array(hashes), "folded_root": pa.array(folded), "verified": pa.array([f == root for f in folded]),
                })

    return blocks.mapInArrow(run, f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def verify(m: Manifest, key: str, changed: str, height: int = HEIGHT) -> DataFrame:
    """A row for each leaf: its proof's hash, the root that the leaf in
    ``changed`` (a digest kept by the blocks; null: unchanged) and the stored
    siblings fold to, and whether that is the root."""
    most = ARITY**height
    last = m.top[-1]
    root = F.substring("nodes", 1, DIGEST)
    above = last.where("sole").select("g", "block", "sole", F.lit(b"").alias("path"), root.alias("subroot"), root.alias("root"))
    _, ways = _down(m.top, above, most, "named")
    found, _ = _down(m.groups, stored(ways, "ways"), most, None)
    return _answers(found, key, changed)


def tampered(docs: DataFrame) -> DataFrame:
    """Leaves of documents, and what they become without line feeds where 2 divides the crc32 of the id (null: unchanged)."""
    columns = ("doc_id", "source", "lang", "n_chars")
    short = F.replace(F.col("text"), F.lit("\n"))
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    d = docs.select(*columns, F.col("text").cast("string").alias("text"))
    others = [F.col(c) for c in columns]
    return d.select("doc_id", "source", leaf(*others, F.col("text")).alias("digest"), F.when(hit, F.unhex(leaf(*others, short))).alias("changed"))


def audit(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Manifest of ``docs`` by source and doc_id, checked against tampered rows."""
    m = manifest(tampered(docs), "source", "doc_id", "digest", ["changed"], height)
    return verify(m, "doc_id", "changed", height)
