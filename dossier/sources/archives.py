"""Members of nested archives and text of image metadata, for rule scans."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package
from .formats import decode

MOST_MEMBERS, MOST_BYTES, MOST_DEPTH = 10_000, 250 << 20, 3


def members(data: bytes, path: str, depth: int = 0) -> Iterator[tuple[str, bytes, str]]:
    """(path, bytes, note) of all members; limits give a note instead of bytes."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        yield path, b"", "not_an_archive"
        return
    with z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > MOST_MEMBERS or sum(i.file_size for i in infos) > MOST_BYTES:
            yield path, b"", "archive_over_limits"
            return
        for i in infos:
            inner, body = f"{path}!{i.filename}", z.read(i)
            if i.filename.lower().endswith(".zip"):
                if depth + 1 >= MOST_DEPTH:
                    yield inner, b"", "archive_too_deep"
                else:
                    yield from members(body, inner, depth + 1)
            else:
                yield inner, body, ""


def png_text(data: bytes) -> list[tuple[str, str]]:
    """Keyword and text of the text chunks of a PNG file."""
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        return []
    out, at = [], 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        key, _, rest = body.partition(b"\0")
        if kind == b"tEXt":
            out.append((key.decode("latin-1"), rest.decode("latin-1")))
        elif kind == b"zTXt":
            out.append((key.decode("latin-1"), zlib.decompress(rest[1:]).decode("latin-1")))
        elif kind == b"iTXt":
            packed, rest = rest[:1] == b"\1", rest[2:].split(b"\0", 2)[2]
            out.append((key.decode("latin-1"), (zlib.decompress(rest) if packed else rest).decode("utf-8", "replace")))
    return out


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, note) of every file below a folder, archives and PNG metadata included."""
    ship_package(spark)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def rows(path: str, data: bytes):
        low = path.lower()
        if low.endswith((".zip", ".docx", ".xlsx")):
            for inner, body, note in members(data, path):
                if note:
                    yield inner, "", note
                else:
                    yield from rows(inner, body)
        elif low.endswith(".png"):
            yield path, "\n".join(f"{k}: {v}" for k, v in png_text(data)), ""
        else:
            yield path, decode(data), ""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = [r for p, c in zip(pdf["path"], pdf["content"]) for r in rows(p, bytes(c))]
            yield pd.DataFrame(out, columns=["path", "text", "note"])

    return f.mapInPandas(run, "path string, text string, note string").withColumn("n_chars", F.length("text"))
