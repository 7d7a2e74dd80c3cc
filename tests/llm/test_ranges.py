"""Range shards, skewed joins and what is written in them: ids that crowd, lie far off or repeat."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.llm import ranges, skew, tokenfile, warc
from dossier.llm.queries import vocabulary

CASES = {
    "far": [*range(999), 1 << 60],
    "dense": list(range(1000)),
    "beyond doubles": [(1 << 60) + i for i in range(1000)],
    "ends": [-(1 << 63) + 1, (1 << 63) - 1, *range(500)],
    "one id": [7] * 1000,
    "null": [None] * 300 + list(range(300)),
}


@pytest.mark.parametrize("name", list(CASES))
def test_shards_follow_the_sizes(spark, name):
    ids = CASES[name]
    rows = [(i, k if name == "one id" else 0, 20) for k, i in enumerate(ids)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, tie long, size int").repartition(5)
    shard, span, n, _ = ranges.shards(df, "id", "tie", F.col("size"), 400)
    got = [tuple(r) for r in df.select(F.coalesce("id", F.lit(ranges.FIRST)), "tie", shard.alias("s"), span.alias("w")).collect()]
    held = {}
    for i, t, s, w in got:
        held[s] = held.get(s, 0) + 1
        assert 0 <= s and s + w < n
        if w == 0:
            continue
        assert name == "null" and i == ranges.FIRST and w == 300 * 20 // 400 - 1
    if name != "null":
        assert max(held.values()) <= 21 and n >= len(ids) * 20 // 400
    ordered = sorted(got)
    assert [s for *_, s, _ in ordered] == sorted(s for *_, s, _ in ordered)


def test_equal_rows_beyond_a_shard_are_dealt(spark):
    docs = spark.createDataFrame([(5, "same text " * 30)] * 200 + [(9, "other")], "doc_id long, text string").repartition(3)
    base, manifest = tokenfile.write(docs, vocabulary("byte_bpe_50k.json"), 2, shard_bytes=3000, sequence=64)
    files = manifest.collect()
    assert len(files) > 10 and max(f.docs for f in files) < 60
    got = sorted(tuple(r) for r in tokenfile.read(spark, base).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert len(got) == 201 and len({r[2:] for r in got}) == 2
    at = 0
    for _, start, size, _ in got:
        assert start == at
        at += size


def test_rows_of_a_mapped_file_are_views(spark):
    docs = spark.createDataFrame([(i, f"document {i} " * 40) for i in range(60)], "doc_id long, text string")
    base, manifest = tokenfile.write(docs, vocabulary("byte_bpe_50k.json"), 2, sequence=64)
    f = tokenfile.TokenFile(base, manifest.first().file)
    assert isinstance(f.source, pa.MemoryMappedFile)
    f.source.seek(0)
    whole = f.source.read_buffer()  # the map itself
    for k in (0, 3):
        ids, mask = f.row(k)
        inside = lambda address: whole.address <= address < whole.address + whole.size
        assert inside(ids.ctypes.data) and not ids.flags.owndata
        assert inside(f.bits(k).buffers()[1].address) and len(mask) == 64


def test_warc_repeated_pages(spark):
    rows = [(3, "http://a/", "<p>same</p>" * 30)] * 80 + [(None, "http://n/", "<p>same</p>" * 30)] * 3 + [(3, "http://a/", "other"), (4, "http://b/", "other"), (2, None, "zero")]
    base, manifest = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), shard_bytes=2000, roll_bytes=1000)
    got = [tuple(r) for r in warc.read(spark, base).select("page_id", "record_type", "refers_to").collect()]
    assert len(got) == len(rows)
    assert sorted(got, key=str) == sorted([(3, "response", None)] * 81 + [(None, "revisit", 3)] * 3 + [(4, "revisit", 3), (2, "response", None)], key=str)
    files = [r.content for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(base).collect()]
    heads = [warc.parse(m)[0] for c in files for m in warc._members([bytes(c)])]
    assert len({h["warc-record-id"] for h in heads}) == len(heads)
    named = {h["warc-record-id"] for h in heads if h["warc-type"] == "response"}
    assert all(h["warc-refers-to"] in named for h in heads if h["warc-type"] == "revisit")


def test_join_of_hot_keys(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(3000)] + [(None, -1)], "key string, v int")
    counted = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    got = {(r.key, r.v): r.low for r in skew.join_counted(rows, counted, "key").collect()}
    assert len(got) == 3000 and got["hot", 2999] == 1 and got["k2997", 2997] == 2997


def test_blobs_of_arrays():
    import numpy as np

    from dossier.llm import chunks

    r = np.random.RandomState(4)
    keys = np.sort(r.randint(0, 2**63 - 1, 5000).astype(np.uint64) * np.uint64(2))
    given = [keys, keys[::-1].copy(), keys[:0], np.zeros(0, np.int64), np.array([0, 255]), np.array([256, 1]), np.array([1 << 40]), np.array([-5, 7]), np.array([True, False]), np.array([(1 << 64) - 1, 0], np.uint64)]
    for a, b in zip(given, chunks.decode(chunks.encode(*given)), strict=True):
        assert a.tolist() == b.tolist() and (a.dtype == b.dtype or a.dtype.kind != "u")
