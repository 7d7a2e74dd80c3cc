"""Packages of files and their runs: inventories, scopes, stage states, progress, views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text


def inventory(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, size, sha256) of files given with their bytes; one pass, no shuffle."""
    return files.select(F.col(path), F.length(content).alias("size"), F.sha2(content, 256).alias("sha256"))


def repeated_names(files: DataFrame, path: str = "path") -> DataFrame:
    """File names that more than one path has, case aside."""
    name = F.lower(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1))
    return files.groupBy(name.alias("name")).agg(F.count("*").alias("n_files")).where("n_files > 1")


def integrity(stored: DataFrame, current: DataFrame, path: str = "path") -> DataFrame:
    """Stored against current inventory: ok, size_changed, content_changed, missing or new."""
    s = stored.select(path, F.col("size").alias("_s"), F.col("sha256").alias("_h"))
    c = current.select(path, F.col("size").alias("_cs"), F.col("sha256").alias("_ch"))
    state = F.when(F.col("_ch").isNull(), "missing").when(F.col("_h").isNull(), "new").when(F.col("_s") != F.col("_cs"), "size_changed").when(F.col("_h") != F.col("_ch"), "content_changed").otherwise("ok")
    return s.join(c, path, "full_outer").select(path, state.alias("state"))


def files_signature(files: DataFrame, by: Sequence[str], path: str = "path") -> DataFrame:
    """One signature per group that does not depend on the order of rows: the
    sum of row hashes and their number, so no group is collected."""
    row = F.xxhash64(F.lower(path), "size", "sha256").cast("decimal(38,0)")
    return files.groupBy(*by).agg(F.count("*").alias("n_files"), ids.signature(F.sum(row), F.count("*")).alias("signature"))


def in_scope(files: DataFrame, selection: DataFrame, path: str = "path") -> DataFrame:
    """Files whose path, case aside, is selected."""
    return files.join(selection.select(text.file_key(F.col(path)).alias("_k")).distinct(), text.file_key(F.col(path)) == F.col("_k"), "left_semi")


def stage_status(good: Column, total: Column, blocked: Column | None = None) -> Column:
    """success, partial_success, failed (nothing good) or blocked."""
    s = F.when((total > 0) & (good == total), "success").when(good > 0, "partial_success").otherwise("failed")
    return s if blocked is None else F.when(blocked, "blocked").otherwise(s)


# fixed values: what earlier runs called the states of a file
STATUS_NAMES = {"ok": "translated", "done": "translated", "success": "translated", "translated": "translated", "partial": "partial", "partial_success": "partial", "skip": "skipped", "skipped": "skipped", "cached": "skipped", "error": "failed", "failed": "failed", "blocked": "blocked"}


def file_status(status: Column, skipped: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in STATUS_NAMES.items() for x in kv))
    return F.when(skipped, "skipped").otherwise(F.coalesce(F.try_element_at(names, F.lower(F.trim(status))), F.lit("pending")))


def progress(files: DataFrame, by: Sequence[str], status: str = "status") -> DataFrame:
    """Files by state, the share done and a label."""
    n = lambda s: F.count(F.when(F.col(status) == s, 1))
    g = files.groupBy(*by).agg(F.count("*").alias("n_files"), *(n(s).alias(f"n_{s}") for s in ("translated", "partial", "skipped", "failed", "blocked", "pending")))
    done = F.col("n_files") - F.col("n_pending")
    label = F.when(F.col("n_pending") > 0, "running").when(F.col("n_failed") + F.col("n_blocked") == F.col("n_files"), "failed").when(F.col("n_failed") + F.col("n_blocked") + F.col("n_partial") > 0, "partial_success").otherwise("success")
    return g.withColumn("done_ratio", F.round(done / F.col("n_files"), 4)).withColumn("label", label)


def field_units(values: DataFrame, by: Sequence[str], unit: str, order: str, default: Column) -> DataFrame:
    """Distinct units of a field in order of first sight, joined by ``/``."""
    first = values.where(F.trim(unit) != "").groupBy(*by, unit).agg(F.min(order).alias("o"))
    joined = first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col(unit).alias("u")))), lambda x: x["u"]), "/").alias("units"))
    return values.select(*by).distinct().join(joined, list(by), "left").withColumn("units", F.coalesce("units", default))


def artifact_names(df: DataFrame, name: str, order: Sequence[str], to: str = "artifact") -> DataFrame:
    """Safe names without conflicts: ``a.txt``, ``a-2.txt``, … in order."""
    safe = F.regexp_replace(F.regexp_replace(F.col(name), r'[\\/:*?"<>|\x00-\x1F]+', "_"), r"^[. ]+|[. ]+$", "")
    d = df.withColumn("_n", F.when(safe == "", "file").otherwise(safe))
    k = F.row_number().over(Window.partitionBy(F.lower("_n")).orderBy(*order))
    head, tail = F.regexp_extract("_n", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("_n", r"^(.*?)(\.[^.]*)?$", 2)
    return d.withColumn(to, F.when(k == 1, F.col("_n")).otherwise(F.concat(head, F.lit("-"), k.cast("string"), tail))).drop("_n")


def searched(collections: Sequence[tuple[str, DataFrame, Sequence[str], str]], query: str) -> DataFrame:
    """Rows of several collections any of whose columns contains the query,
    case aside; (kind, id) with the collections in their order."""
    out = None
    for i, (kind, df, columns, key) in enumerate(collections):
        hit = F.exists(F.array(*(F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")) for c in columns)), lambda x: x.contains(query.lower()))
        rows = df.where(hit).select(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def within_limits(files: DataFrame, by: Sequence[str], size: str, most_files: int, most_each: int, most_total: int) -> DataFrame:
    """The first broken limit of each upload, or empty."""
    g = files.groupBy(*by).agg(F.count("*").alias("n"), F.max(size).alias("m"), F.sum(size).alias("t"))
    return g.select(*by, F.when(F.col("n") > most_files, "too_many_files").when(F.col("m") > most_each, "file_too_large").when(F.col("t") > most_total, "upload_too_large").otherwise("").alias("broken"))


def safe_path(path: Column) -> Column:
    """Relative, without a drive, parent steps, reserved names or control characters."""
    p = F.translate(path, "\\", "/")
    parts = F.split(p, "/")
    reserved = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
    return (p != "") & ~p.startswith("/") & ~p.rlike(r"^[A-Za-z]:") & ~p.rlike(r"[\x00-\x1F]") & ~F.exists(parts, lambda x: (x == "..") | x.rlike(reserved))


def failure_summary(log: Column, most: int = 240) -> Column:
    """The last line of a log that is no part of a trace, with paths masked."""
    lines = F.filter(F.transform(F.split(log, "\n"), F.trim), lambda x: (x != "") & ~x.rlike(r'^(Traceback|File "|at |\^)'))
    last = F.try_element_at(lines, F.lit(-1))
    masked = F.regexp_replace(last, r"([A-Za-z]:\\|/)[^ \t:'\"]+", "<path>")
    return text.truncated(masked, most)


def log_metrics(log: Column) -> Column:
    """Struct of numbers in an engine's log: last progress, failures, time in all and at most."""
    num = lambda p: F.transform(F.regexp_extract_all(log, F.lit(p), 1), lambda x: x.try_cast("double"))
    times = num(r"time[ =:]+([0-9.]+) ?s")
    return F.struct(
        F.try_element_at(num(r"progress[ =:]+([0-9]+)"), F.lit(-1)).alias("progress"),
        F.size(F.regexp_extract_all(log, F.lit(r"(?i)(failed|error)"), 1)).alias("n_failures"),
        F.round(F.aggregate(times, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 3).alias("seconds"),
        F.array_max(times).alias("longest"),
    )


def overlap_share(a: Column, b: Column) -> Column:
    """Share of rectangle ``a`` that ``b`` covers."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0))
    h = F.greatest(F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]), F.lit(0))
    return F.coalesce(F.try_divide(w * h, (a["x1"] - a["x0"]) * (a["bottom"] - a["top"])), F.lit(0.0))
