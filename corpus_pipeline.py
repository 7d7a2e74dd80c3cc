"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept, as Parquet in the shared
folder, and its decisions take effect: rejected documents, further members of a
group of near copies, repeated bytes and contaminated documents are gone for
the stages after it. What a stage wrote for itself is removed once its result
is written.

Edge cases, the same in all stages: rows are known by all their columns, never
by doc_id alone, so null and repeated ids lose nothing that has another text;
of rows equal in every column near-dedup keeps one. A null, empty or blank text
has no letter and is rejected by language ID; later stages take it as empty: it
is a near copy of the other empty ones, suffix dedup drops it, and packing gives
it the end id alone. Ties go to the smallest id, null last, then to the
smallest hash of the row. Texts of any length are taken whole. An empty table
stays empty through all stages. Further columns are carried along, whatever
their names; n_chars is counted anew where a text changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import decontam, langid, packing, scratch, simhash, suffix
from dossier.llm.queries import vocabulary
from dossier.llm.scratch import stored
from dossier.runtime import table

#: a document with more of its words than this in no known language is rejected
MOST_OTHER = 0.8


_KNOWN = ("doc_id", "text", "lang")


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in _KNOWN]


def _col(name: str) -> Column:
    """A column by its whole name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def _hashable(docs: DataFrame, name: str) -> Column:
    """A column as the row's hash takes it: maps, which it refuses, as text."""
    return F.to_json(F.struct(_col(name).alias("_"))) if "map<" in docs.schema[name].dataType.simpleString() else _col(name)


def _packed(docs: DataFrame, *more: Column) -> DataFrame:
    """The columns that operators know, and the others as one, so that no name of theirs can clash."""
    rest = F.struct(F.lit(0).alias("_"), *(_col(c).alias(f"c{k}") for k, c in enumerate(_others(docs))))
    return docs.select(*(c for c in _KNOWN if c in docs.columns), rest.alias("rest"), *more)


def _unpacked(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, some with new values."""
    held = {c: F.col(f"rest.c{k}") for k, c in enumerate(_others(docs))}
    return df.select(*((new.get(c, held[c] if c in held else _col(c))).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or mostly in no learned language. Where
    no row tells its language there is none to learn, and all with a letter stay."""
    if docs.where("lang is not null and text is not null").isEmpty():
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    found = langid.identify(_packed(docs), keep=(*_KNOWN, "rest"))
    return _unpacked(found.where((F.col("lang_pred") != "und") & (F.col("other_share") <= MOST_OTHER)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that with the smallest id,
    null last, and of equal ids that with the smallest hash over its columns.
    Rows are known by id and hash: other texts under a null or repeated id stay."""
    # the hash passes over nulls; which columns are null is hashed too
    columns = [_hashable(docs, c) for c in docs.columns]
    named = _packed(docs, F.xxhash64(*columns, *(F.isnull(c) for c in columns)).alias("row_hash"))
    found = simhash.first_copies(named, "row_hash")
    rows = stored(found.groupBy("doc_id", "row_hash").agg(F.max("first").alias("stays"), F.count("*").alias("n")), "rows")
    # written, so that Spark knows their size and moves texts only if it must; ids of which no row stays need no hash
    gone = stored(rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("stays").alias("stays")).where("not stays").select(F.col("doc_id").alias("d")), "gone")
    single = rows.where("not stays and doc_id is not null").join(gone, F.col("doc_id") == F.col("d"), "left_anti")
    some = stored(single.union(rows.where("not stays and doc_id is null")).select(F.col("doc_id").alias("d"), F.col("row_hash").alias("h")), "gone-rows")
    kept = named.join(gone, F.col("doc_id") == F.col("d"), "left_anti")
    if not some.isEmpty():
        kept = kept.join(some, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_hash") == F.col("h")), "left_anti")
    if not rows.where("stays and n > 1").isEmpty():  # equal rows
        kept = kept.dropDuplicates(["doc_id", "row_hash"])
    return _unpacked(kept, docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that stand earlier; documents of which nothing is left go."""
    found = suffix.dedup(_packed(docs), with_text=True, keep=("doc_id", "lang", "rest")).where("text <> ''")
    return _unpacked(found, docs, n_chars=F.length("text").cast("long"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark passage, known by id and hash of the text."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), with_hash=True)
    hit = stored(found.where("contaminated").select(F.col("doc_id").alias("d"), F.col("th").alias("h")).distinct(), "hit")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64(F.col("text").cast("string")) == F.col("h"))
    return _unpacked(_packed(docs).join(hit, same, "left_anti"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096: each piece with its ids and its place."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 1, with_ids=True, lean=True)


STAGES = [("language id", language_id), ("simhash near-dedup", near_dedup), ("suffix-array dedup", suffix_dedup), ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]

#: SQL expresses neither the tokenizer nor the mixture model
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = scratch.written(spark)
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        *own, _ = scratch.written(spark)[len(before) :]
        scratch.remove(spark, own)
    return docs
