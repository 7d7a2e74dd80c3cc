"""Token ids as Arrow files of fixed-size-list batches.

Documents are range-sorted by id into shards. A shard file is an Arrow IPC file
whose batches have the columns ``ids`` and ``mask``, fixed-size lists of the
sequence length: the values of a batch are one gap-free buffer, so sequence k
of a memory-mapped file is an offset and no copy. The last sequence of a shard
is padded and masked. A second Arrow file has each document's id and place.

Edge cases: a null text is empty and has the end id alone; null doc_ids come
first, among the least long; rows with equal doc_ids follow each other ordered
by a hash of their text; special tokens' strings in a text are ordinary text; an
empty table gives no files. Ids must be whole numbers (Spark's cast fails on
others).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship_package
from . import ranges, store
from . import textbytes as tb
from .encode import SLICE_BYTES, encoder, with_end
from .scratch import new_path, stored

SHARD_BYTES = 32 << 20
SEQUENCE = 2048
BATCH_ROWS = 512
MANIFEST = "shard int, file string, places string, docs long, tokens long, bytes long"


def _batch(ids: np.ndarray, count: int, sequence: int) -> pa.RecordBatch:
    rows = -(-len(ids) // sequence)
    flat = np.zeros(rows * sequence, ids.dtype)
    flat[: len(ids)] = ids
    mask = np.arange(rows * sequence) < count
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), sequence)], names=["ids", "mask"])


class _Shard:
    def __init__(self, base: str, shard: int, sequence: int, dtype):
        self.shard, self.sequence, self.dtype = shard, sequence, dtype
        self.ids, self.places = store.Writer(base, f"ids-{shard:06d}.arrow"), store.Writer(base, f"places-{shard:06d}.arrow")
        kind = pa.from_numpy_dtype(dtype)
        self.sink = pa.ipc.new_file(self.ids.out, pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))]))
        self.index = pa.ipc.new_file(self.places.out, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.rest = np.zeros(0, dtype)
        self.docs = self.tokens = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, begins: np.ndarray) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(begins[:-1] + self.tokens), pa.array(np.diff(begins))], names=["doc_id", "start", "n_tokens"]))
        self.docs, self.tokens = self.docs + len(doc_ids), self.tokens + len(ids)
        self.rest = np.concatenate([self.rest, ids])
        step = self.sequence * BATCH_ROWS
        while len(self.rest) >= step:
            self.sink.write_batch(_batch(self.rest[:step], step, self.sequence))
            self.rest = self.rest[step:]

    def close(self) -> dict:
        if len(self.rest):
            self.sink.write_batch(_batch(self.rest, len(self.rest), self.sequence))
        self.sink.close()
        self.index.close()
        size = self.ids.out.tell() + self.places.out.tell()
        self.ids.commit()
        self.places.commit()
        return {"shard": self.shard, "file": self.ids.name, "places": self.places.name, "docs": self.docs, "tokens": self.tokens, "bytes": size}


def write(docs: DataFrame, vocabulary: str, end_id: int, drop_space: bool = False, base: str | None = None, shard_bytes: int = SHARD_BYTES, sequence: int = SEQUENCE) -> tuple[str, DataFrame]:
    """Writes the files to ``base``; gives the folder and the manifest."""
    spark = docs.sparkSession
    ship_package(spark)
    base = base or new_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    cuts = ranges.shards(rows, "doc_id", "tie", F.octet_length("text") + 1, shard_bytes)
    dealt = ranges.dealt(rows, cuts).repartitionById(cuts.count, "shard").sortWithinPartitions("shard", "doc_id", "tie", "text").select("doc_id", "shard", "text")
    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("places", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        enc, now = encoder(vocabulary, drop_space), None
        for b, data, offs in tb.pieces(batches, "text", SLICE_BYTES):
            ids, begins = with_end(*enc.encode(data, offs), end_id)
            shard = b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for s, e in zip(cuts, cuts[1:]):
                if now is not None and now.shard != shard[s]:
                    yield pa.RecordBatch.from_pylist([now.close()], schema=schema)
                    now = None
                now = now or _Shard(base, int(shard[s]), sequence, enc.dtype)
                now.add(b.column(0).slice(s, e - s), ids[begins[s] : begins[e]], begins[s : e + 1] - begins[s])
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.close()], schema=schema)

    manifest = stored(dealt.mapInArrow(run, MANIFEST), "manifest")
    manifest.coalesce(1).write.mode("overwrite").json(f"{base}/manifest")
    return base, manifest


class TokenFile:
    """Random access to the sequences of one shard file. A file with a local
    path is memory-mapped: batches, and rows of them, are views into the map,
    and only the pages that are looked at are read."""

    def __init__(self, base: str, name: str):
        self.source = store.mapped(base, name)
        self.file = pa.ipc.open_file(self.source)
        self.batches = self.file.num_record_batches
        self.sequence = self.file.schema.field("ids").type.list_size

    def flat(self, k: int) -> np.ndarray:
        """Ids of batch ``k`` as one array."""
        return self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)

    def bits(self, k: int) -> pa.BooleanArray:
        """Mask of sequence ``k``, its bits where they lie in the file."""
        return self.file.get_batch(k // BATCH_ROWS).column(1).slice(k % BATCH_ROWS, 1).flatten()

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sequence ``k`` where they lie in the file, and its mask spread to booleans."""
        ids = self.file.get_batch(k // BATCH_ROWS).column(0).slice(k % BATCH_ROWS, 1).flatten()
        return ids.to_numpy(zero_copy_only=True), self.bits(k).to_numpy(zero_copy_only=False)


def read(spark: SparkSession, base: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    ship_package(spark)
    manifest = spark.read.schema(MANIFEST).json(f"{base}/manifest")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = manifest.withColumn("before", before)  # a row per shard of 32 MB
    files = max(1, manifest.count())

    def run(batches):
        for b in batches:
            for file, places, first in zip(*(c.to_pylist() for c in b.columns)):
                ids = TokenFile(base, file)
                index = pa.ipc.open_file(store.open_file(base, places))
                at, have, begin = 0, np.zeros(0, np.uint16), 0
                for k in range(index.num_record_batches):
                    x = index.get_batch(k)
                    start, size = x.column(1).to_numpy(), x.column(2).to_numpy()
                    crc = []
                    for s, n in zip(start.tolist(), size.tolist()):
                        while begin + len(have) < s + n:
                            drop = max(0, s - begin)
                            have = np.concatenate([have[drop:], ids.flat(at)])
                            begin, at = begin + drop, at + 1
                        crc.append(zlib.crc32(have[s - begin : s - begin + n].astype("<u4").tobytes()))
                    yield pa.RecordBatch.from_arrays([x.column(0), pa.array(start + first), x.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.select("file", "places", "before").repartition(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
