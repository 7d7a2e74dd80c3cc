"""Identities: stable across runs and machines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_id(path: Column) -> Column:
    """Of a package-relative path."""
    return F.concat(F.lit("doc_"), F.substring(F.sha1(F.lower(F.translate(path, "\\", "/")).cast("binary")), 1, 12))


def block_id(document: Column, order: Column) -> Column:
    return F.format_string("%s_b%05d", document, order)


def keyed(prefix: str, length: int, *parts: Column, sep: str = ":") -> Column:
    """A prefix and the first ``length`` digits of the SHA-1 of the joined parts; null parts are empty."""
    joined = F.concat_ws(sep, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined.cast("binary")), 1, length))


def signature(*parts: Column, length: int = 16) -> Column:
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.substring(F.sha2(joined, 256), 1, length)
