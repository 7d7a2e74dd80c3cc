"""The Merkle manifest against a plain tree, and its layout."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from dossier.llm import merkle, ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, at long, digest string, leaf string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc, text, lang, source, n):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def beside(levels, i):
    for row in levels[:-1]:
        first = i // 3 * 3
        yield row[first:i], row[i + 1 : first + 3]
        i //= 3


def plain(rows):
    if not rows:
        return []
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0], leaf_of(*r[:5]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc, own, r) in enumerate(groups[s]):
            steps = [*beside(trees[s], i), *beside(top, k)]
            node = own
            if doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 and r[1] is not None:
                node = leaf_of(r[0], r[1].replace("\n", ""), *r[2:5])
            for left, right in steps:
                node = sha(*left, node, *right)
            root = top[-1][0]
            out.append((doc, own, trees[s][-1][0], root, sha(*(x for a, b in steps for x in a + b)), node, node == root))
    return out


# rows, sources, height: no row, a lone leaf, full and ragged blocks, several tiers within and above sources
@pytest.mark.parametrize("n, sources, height", [(0, 1, 2), (1, 1, 2), (9, 1, 2), (10, 2, 2), (28, 2, 1), (243, 1, 2), (300, 40, 1), (120, 5, 6)])
def test_against_a_plain_tree(spark, n, sources, height):
    r = random.Random(n)
    rows = [
        (r.choice([None, r.randrange(10**6), i // 2]), r.choice([None, "", "a\nb" * r.randrange(4), "é\n"]), r.choice([None, "en"]), r.choice([None, "é", *(f"s{k}" for k in range(sources))][-sources:]), r.choice([None, i]), "clash", 1, "clash", "clash")
        for i in range(n)
    ]
    rows += rows[:3]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, merkle.audit(df, height).collect()), key=repr) == sorted(plain(rows), key=repr)


def test_very_long_text(spark):
    rows = [(2, "é" * (5 << 20) + "\n", "en", "s", 1), (4, "x", None, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, merkle.audit(df).collect()), key=repr) == sorted(plain(rows), key=repr)


def test_layout_keeps_every_subtree_together():
    for levels in range(1, 8):
        seen = sorted(x for d in merkle.places(levels) for x in d)
        assert seen == list(range(merkle.size(levels)))
    # a tree of four levels: the upper two, then nine trees of two
    assert merkle.address(4, 1, np.arange(3)).tolist() == [1, 2, 3]
    assert merkle.address(4, 2, np.arange(9)).tolist() == [4 + 4 * k for k in range(9)]
    assert merkle.address(4, 3, np.arange(27)).tolist() == [4 + 4 * (k // 3) + 1 + k % 3 for k in range(27)]


def test_blocks_hold_the_proofs():
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(20)]
    nodes = merkle.build(leaves, 4)
    for leaf, steps in zip(leaves, merkle.proofs(nodes, 4, 20)):
        node = leaf.hex()
        for s in merkle.unpacked(merkle.packed(steps)):
            node = s.up(node)
        assert node == nodes[:32].hex()


def test_places_in_groups_larger_than_a_partition(spark):
    groups = ["a"] * 500 + ["b"] + ["c"] * 300 + ["d"] * 3
    keys = [7] * 200 + list(range(300)) + [0] + [None] * 100 + list(range(200)) + [1, 1, 1]
    rows = list(zip(groups, keys))
    random.Random(2).shuffle(rows)
    got = ranked.ranked(spark.createDataFrame(rows, "g string, k long").repartition(5), "g", ["k"]).collect()
    for g in "abcd":
        mine = sorted((x.at, -1 if x.k is None else x.k) for x in got if x.g == g)
        assert [a for a, _ in mine] == list(range(groups.count(g)))
        assert [k for _, k in mine] == sorted(k for _, k in mine)
