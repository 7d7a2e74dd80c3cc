"""Names of translated outputs: no two alike, none that is taken already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from .order import rank_by_range, running_total

#: what a translated file's stem ends in
MARK = "-译"
# fixed values: extensions and those of their translations
EXTENSIONS = {".doc": ".docx", ".docx": ".docx", ".xls": ".xlsx", ".xlsx": ".xlsx", ".pdf": ".pdf"}
# fixed values: names that Windows keeps for devices
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{k}" for k in range(1, 10)), *(f"LPT{k}" for k in range(1, 10)))
MOST_PART = 96


def output_extension(path: Column) -> Column:
    """``.docx`` for ``.doc``, and so on; null where there is no translation of the kind."""
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return known[F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))]


def safe_part(c: Column, most: int = MOST_PART) -> Column:
    """A path's part as every system can write it."""
    clean = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), "[ .]+$", "")
    clean = F.when(clean == "", "_").otherwise(clean)
    clean = F.when(F.upper(F.substring_index(clean, ".", 1)).isin(*RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)
    cut = F.concat(F.substring(clean, 1, most - 13), F.lit("~"), F.substring(F.sha2(clean, 256), 1, 12))
    return F.when(F.length(clean) > most, cut).otherwise(clean)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)[^/]*$", 1)


def _numbered(stem: Column, k: Column, extension: Column) -> Column:
    return F.concat(stem, F.lit(MARK), F.when(k > 1, F.concat(F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(""), extension)


def _slot(path: Column) -> tuple[Column, Column]:
    """(what numbers are dealt for, number) of a name that an output may have: the two tell all about it."""
    number = F.regexp_extract(path, rf"{MARK} \(([0-9]{{1,9}})\)(\.[^./]+)$", 1)
    group = F.lower(F.concat(F.regexp_replace(path, rf"{MARK}(?: \([0-9]{{1,9}}\))?(\.[^./]+)$", MARK), F.lit("|"), F.regexp_extract(path, r"(\.[^./]+)$", 1)))
    return group, F.when(number == "", 1).otherwise(number.cast("long"))


def plan(sources: DataFrame, occupied: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(source, output, number, reused, renamed) for distinct relative paths.

    Sources in the order of their paths, case aside, get the first number that
    neither an ``occupied`` path (column ``path``) nor an earlier source has;
    case does not tell names apart. A source that ``previous`` (source, output)
    has a plan for keeps it; of several with one output the first does. Files of
    a kind without translation get none. ``renamed``: the name had to be made
    safe or numbered.

    Names of one stem differ by their numbers alone, so the m-th source of a
    stem takes the m-th number that is free: m and as many as are taken before
    it. Both counts are running ones over range partitions, so a stem may hold
    any part of the sources."""
    path = F.regexp_replace(F.translate("source", "\\", "/"), "/+", "/")
    s = sources.select("source").distinct().withColumn("_path", path).withColumn("_ext", output_extension(path)).where("_ext is not null")
    parts = F.split(F.regexp_replace(_folder(F.col("_path")), "/$", ""), "/")
    folder = F.when(_folder(F.col("_path")) == "", "").otherwise(F.concat(F.array_join(F.transform(parts, lambda x: safe_part(x)), "/"), F.lit("/")))
    name = F.regexp_replace(F.regexp_replace("_path", "^.*/", ""), r"\.[^.]+$", "")
    stem = safe_part(F.concat(name, F.lit(MARK)), 173)
    s = s.withColumn("_stem", F.concat(folder, F.regexp_replace(stem, f"{MARK}$", ""))).withColumn("_plain", F.concat(_folder(F.col("_path")), name))
    s = written(s.withColumn("_group", _slot(_numbered(F.col("_stem"), F.lit(1), F.col("_ext")))[0]), "sources")
    order = F.struct(F.lower("_path"), "_path", "source")
    taken = occupied.select(F.regexp_replace(F.translate("path", "\\", "/"), "/+", "/").alias("_p"))
    kept = None
    if previous is not None:
        prior = previous.select("source", F.col("output").alias("_out")).distinct().join(s, "source")
        first = prior.groupBy(F.lower("_out").alias("_key")).agg(F.min(F.struct(order.alias("o"), "source", "_out")).alias("f"))
        kept = first.groupBy("f.source").agg(F.min("f._out").alias("output"))
        kept = written(kept, "kept")
        taken = taken.union(kept.select("output"))
        open_ = s.join(kept, "source", "left_anti")
    else:
        open_ = s
    group, number = _slot(F.col("_p"))
    held = taken.select(group.alias("_group"), number.alias("_k")).distinct().join(s.select("_group").distinct(), "_group", "left_semi")
    # place of a source among those of its stem, and of a taken number among the taken ones
    base = lambda d, by: d.join(d.groupBy("_group").agg(F.min("_n").alias("_first")), "_group").withColumn("_m", F.col("_n") - F.col("_first") + 1) if by else d
    mine = rank_by_range(open_.withColumn("_order", F.lower("_path")), ["_group", "_order", "_path", "source"], "_n")
    mine = base(mine, True).select("source", "_group", "_stem", "_plain", "_ext", "_m")
    theirs = base(rank_by_range(held, ["_group", "_k"], "_n"), True).select("_group", (F.col("_k") - F.col("_m")).alias("_free"))  # numbers that are free before it
    both = mine.select("_group", F.col("_m").alias("_v"), F.lit(0).alias("_kind"), "source", "_stem", "_plain", "_ext", F.lit(0).cast("long").alias("_one"))
    both = both.unionByName(theirs.select("_group", F.col("_free").alias("_v"), F.lit(1).alias("_kind"), F.lit(1).cast("long").alias("_one")), allowMissingColumns=True)
    run = running_total(both, ["_group", "_v", "_kind"], "_one", "_run")
    run = written(run, "numbers")
    begin = run.groupBy("_group").agg(F.min(F.col("_run") - F.col("_one")).alias("_begin"))
    dealt = run.where("_kind = 0").join(begin, "_group").withColumn("number", F.col("_v") + F.col("_run") - F.col("_begin"))
    new = dealt.select("source", _numbered(F.col("_stem"), F.col("number"), F.col("_ext")).alias("output"), "number", F.lit(False).alias("reused"), ((F.col("number") > 1) | (F.col("_stem") != F.col("_plain"))).alias("renamed"))
    if kept is None:
        return new
    old = kept.join(s, "source").select("source", "output", _slot(F.col("output"))[1].alias("number"), F.lit(True).alias("reused"))
    return new.unionByName(old.join(s.select("source", "_plain", "_ext"), "source").select("source", "output", "number", "reused", (F.col("output") != _numbered(F.col("_plain"), F.lit(1), F.col("_ext"))).alias("renamed")))
