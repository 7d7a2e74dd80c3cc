"""WARC archives, written in deterministic shards and read back.

Pages are range-sorted by id, and within an id by a hash of url and payload,
into shards that follow the sizes; each shard is a run of files that roll over
by compressed size. Headers and digests are made anew from the
payload. Of equal payloads the smallest page_id gets the response record and
the others revisit records that refer to it. Files are written under temporary
names, moved, and count only once the manifest names them, so repeated tasks
do no harm.

Edge cases: null html is an empty payload; a null url gives a record without
target; a null page_id is written as such and never referred to (if a payload
has no other pages, all its records are responses); rows that repeat the
smallest page_id of a payload are all responses; an empty table gives an empty
archive; control characters in a url are percent-encoded. Ids must be whole
numbers (Spark's cast fails on others). Record ids are unique: beside the page
they name a hash of its url and payload and a number among equal rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package
from . import ranges, store
from .scratch import new_path, stored
from .skew import join_counted

SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, shard int, records long, bytes long, digest string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*head, ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Length", str(len(block)))]]
    raw = ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _urn(page_id, tie: int, copy: int, nth: int) -> str:
    """Page, a hash of its url and payload, and a number among equal rows."""
    return f"<urn:x-page:{page_id}:{tie & (1 << 64) - 1:016x}:{copy}:{nth}>"


def _record(urn: str, url, payload: bytes, owner: str | None) -> bytes:
    found = digest_of(payload)
    head = [("WARC-Type", "revisit" if owner else "response"), ("WARC-Record-ID", urn), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    head.append(("WARC-Payload-Digest", f"sha1:{found}"))
    if owner:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", owner)]
    head.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(head, http if owner else http + payload)


def write(pages: DataFrame, base: str | None = None, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> tuple[str, DataFrame]:
    """Writes the archive to ``base`` and gives the folder and its manifest."""
    spark = pages.sparkSession
    ship_package(spark)
    base = base or new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("tie", F.xxhash64(F.coalesce("url", F.lit("")), "html"))
    # who revisits whom, by digests alone; these few columns go to the shards as
    # rows of their own, each just before its page, so payloads move once
    digests = rows.select("page_id", "tie", F.sha1(F.col("html").cast("binary")).alias("sha"))
    page = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "tie"))
    owners = stored(digests.groupBy("sha").agg(F.min(page).alias("owner"), F.count("*").alias("n")).where("n > 1"), "owners")
    known = join_counted(digests, owners, "sha").where("owner is not null and not (owner.page_id <=> page_id)")
    cuts = ranges.shards(rows, "page_id", "tie", F.octet_length("html"), shard_bytes)
    told = known.select("page_id", "tie", "sha", "owner", cuts.shard.alias("shard"), F.explode(F.sequence(F.lit(0), cuts.span)).alias("copy")).distinct()
    none = F.lit(None).cast("struct<page_id: bigint, tie: bigint>")
    payloads = ranges.dealt(rows, cuts).select("shard", "page_id", "tie", "copy", "url", "html", none.alias("owner"))
    every = payloads.union(told.select(F.col("shard") + F.col("copy"), "page_id", "tie", "copy", "sha", F.lit(None).cast("string"), "owner"))
    dealt = every.repartitionById(cuts.count, "shard").sortWithinPartitions("shard", "page_id", "tie", F.col("html").isNotNull(), "url", "html")
    dealt = dealt.select("shard", "page_id", "tie", "copy", "url", "html", F.col("owner.page_id").alias("owner"), F.col("owner.tie").alias("owner_tie"))

    def run(batches):
        out = crc = shard = None
        seq = records = nth = 0
        told, of = {}, None

        def close():
            out.commit()
            return pa.RecordBatch.from_pylist([{"file": out.name, "shard": shard, "records": records, "bytes": out.bytes, "digest": crc.hexdigest()}], schema=schema)

        for b in batches:
            for s, i, tie, copy, url, html, owner, owner_tie in zip(*(c.to_pylist() for c in b.columns)):
                if (s, i, tie) != of:
                    told, of, nth = {}, (s, i, tie), 0
                if html is None:  # the digest of a payload of this page, and what it revisits
                    told[url] = _urn(owner, owner_tie, 0, 0)
                    continue
                if out is not None and (s != shard or out.bytes >= roll_bytes):
                    yield close()
                    out, seq = None, seq + 1 if s == shard else 0
                if out is None:
                    shard, records, crc = s, 0, hashlib.sha1()
                    out = store.Writer(base, f"shard-{s:06d}-{seq:05d}.warc.gz")
                    first = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{out.name}>"), ("WARC-Date", DATE), ("WARC-Filename", out.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(first)
                    crc.update(first)
                payload = html.encode()
                data = _record(_urn(i, tie, copy, nth), url, payload, told.get(hashlib.sha1(payload).hexdigest()) if told else None)
                out.write(data)
                crc.update(data)
                records, nth = records + 1, nth + 1
        if out is not None:
            yield close()

    schema = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string())])
    manifest = stored(dealt.mapInArrow(run, MANIFEST), "manifest")
    manifest.coalesce(1).write.mode("overwrite").json(f"{base}/manifest")
    return base, manifest


def _members(chunks):
    """The gzip members of a file given in chunks."""
    z, parts = zlib.decompressobj(31), []
    for c in chunks:
        while c:
            parts.append(z.decompress(c))
            c = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _page(urn: str | None):
    found = re.fullmatch(r"<urn:x-page:(-?\d+):[0-9a-f]{16}:\d+:\d+>", urn or "")
    return int(found[1]) if found else None


def read(spark: SparkSession, base: str, payloads: bool = True) -> DataFrame:
    """The page records of the files that the manifest names. Digests are
    checked; a revisit has the payload's size and digest, but no payload."""
    ship_package(spark)
    names = spark.read.schema(MANIFEST).json(f"{base}/manifest").select("file")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(base).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches):
        for b in batches:
            for content in b.column(0):
                raw = content.as_buffer()
                rows = []
                for m in _members(raw.slice(i, min(1 << 16, len(raw) - i)).to_pybytes() for i in range(0, len(raw), 1 << 16)):
                    f, block = parse(m)
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
                        raise ValueError(f"record {f['warc-record-id']} does not have the payload it names")
                    rows.append((_page(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], _page(f.get("warc-refers-to")), payload if payloads and f["warc-type"] == "response" else None, size, digest))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return files.join(names, "file", "left_semi").select("content").mapInArrow(run, RECORD)
