"""Evidence that meets by place and text: translations for the values of a card.

A place has levels (page, sheet, cell, paragraph); either side may leave out
any. Two places are compatible if no level that both name differs, within the
same file. The segments of a file are one array, which its values look through;
both sides are moved once, by file. Files of more than ``MOST`` segments are met
by equal keys instead: which levels a row names is one of 16 patterns: every row is taken
once for each pattern of the other side, with the levels that both name as its
key, so a compatible pair has exactly one equal key and the join is an
equi-join. Containment of texts is found through three-letter grams: the text
that is to be contained waits under the gram of it that the fewest others in
its place hold. Both sides are reduced to distinct texts a place before they
meet, and to the first translation a text, so no group of pairs is formed.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, text
from ..runtime import written

LEVELS = ("page", "sheet", "cell", "paragraph")
#: the segments of a file that are held as one array
MOST = 1024


def base_name(path: Column) -> Column:
    """The last part of a path, alike on all systems. Files are the same if
    these are: a whole path can only equal a path or name that ends alike."""
    return F.regexp_replace(text.file_key(F.coalesce(path, F.lit(""))), "^.*/", "")


def coordinate(c: Column, level: str) -> Column:
    """A level's value as it is compared; null if it names nothing."""
    t = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    if level == "cell":
        t = F.replace(t, F.lit("$"), F.lit(""))
    if level == "page":
        number = F.regexp_extract(t, "[0-9]+", 0)
        t = F.when(number != "", number).otherwise(t)
    return F.nullif(t, F.lit(""))


def _mask() -> Column:
    return functools.reduce(lambda a, b: a + b, (F.when(F.col(x).isNull(), 0).otherwise(1 << k) for k, x in enumerate(LEVELS)))


def _by_file(df: DataFrame) -> DataFrame:
    """Rows by ``_file``, one for each of ``_files``."""
    return df.withColumn("_file", F.explode(F.filter(F.array_distinct("_files"), lambda f: f != ""))).drop("_files")


def _large(segments: DataFrame) -> DataFrame | None:
    """The files with more than ``MOST`` segments, if there are any."""
    found = written(segments.groupBy("_file").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("_file"), "large")
    return None if found.isEmpty() else found


def _looked_up(values: DataFrame, segments: DataFrame, large: DataFrame | None) -> DataFrame:
    """Values with the segments of their file as the array ``segs``; large files are left out."""
    few = segments if large is None else segments.join(large, "_file", "left_anti")
    held = few.groupBy("_file").agg(F.collect_list(F.struct(*(c for c in few.columns if c not in ("_file", "_mask")))).alias("segs"))
    return values.join(held.hint("merge"), "_file")  # no broadcast: arrays take far more room than their files


def _compatible(x: Column) -> Column:
    """Whether a segment's place is compatible with that of the row."""
    return functools.reduce(lambda a, b: a & b, (F.col(c).isNull() | x[c].isNull() | (F.col(c) == x[c]) for c in LEVELS))


def _placed(df: DataFrame, others: DataFrame) -> DataFrame:
    """Rows by ``place``, one for each pattern of ``others``."""
    patterns = sorted(r[0] for r in others.select("_mask").distinct().collect())  # 16 at most
    rows = df.withColumn("_other", F.explode(F.lit(patterns).cast("array<int>")))
    named = [F.when((F.col("_mask").bitwiseAND(F.col("_other")).bitwiseAND(F.lit(1 << k))) != 0, F.col(x)).otherwise("") for k, x in enumerate(LEVELS)]
    both = F.col("_mask").bitwiseAND(F.col("_other"))
    # a pattern of the one side with one of the other, whichever is which: the shared levels alone would let a pair meet twice
    return rows.withColumn("place", F.to_json(F.struct("_file", both.alias("both"), *(n.alias(x) for n, x in zip(named, LEVELS))))).withColumn("pair", F.struct("_mask", "_other"))


def _grams(c: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Distinct runs of one to three characters, in one walk over them."""

    def run(chars: Column, n: int) -> Column:
        begins = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(begins, lambda i: F.concat(*(F.get(chars, i + k) for k in range(n))))

    # held by a variable of a lambda, the characters are split off once and not for every place
    held = F.array(F.filter(F.split(c, ""), lambda x: x != ""))
    return F.array_distinct(F.get(F.transform(held, lambda chars: F.flatten(F.array(*(run(chars, n) for n in sizes)))), F.lit(0)))


def containing(small: DataFrame, large: DataFrame, on: list[str]) -> DataFrame:
    """(on, small, large) for the distinct texts ``t`` of both sides with equal
    ``on`` where the small one is not empty and contained in the large one.
    Grams travel with digests of the texts; texts follow for what met."""
    digest = F.sha2("t", 256)
    s = small.select(*on, "t").where("t <> ''").distinct().withColumn("s", digest)
    l = written(large.select(*on, "t").where("t <> ''").distinct().withColumn("l", digest), "texts")
    held = l.select(*on, "l", F.explode(_grams(F.col("t"))).alias("gram"))
    counts = held.groupBy(*on, "gram").agg(F.count("*").alias("n"))
    # a text of three characters or more is looked for by three
    mine = s.select(*on, "s", F.explode(F.when(F.length("t") >= 3, _grams(F.col("t"), (3,))).otherwise(F.array("t"))).alias("gram"))
    rare = mine.join(counts, [*on, "gram"], "left").groupBy(*on, "s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    met = rare.select(*on, "s", F.col("r.gram").alias("gram")).join(held, [*on, "gram"]).drop("gram")
    texts = s.select("s", F.col("t").alias("small")).distinct(), l.select("l", F.col("t").alias("large")).distinct()
    full = met.join(texts[0], "s").join(texts[1], "l")
    return full.where(F.contains("large", "small")).select(*on, "small", "large")


def _behind_label(labels: Sequence[str], t: Column) -> Column:
    """The value behind the first of the labels that has one."""
    return F.coalesce(F.lit(None).cast("string"), *(F.nullif(F.regexp_extract(t, rf"(?i)(?:^|[|；;\n])\s*{re.escape(x)}\s*[:：=]\s*([^|；;\n]+)", 1), F.lit("")) for x in labels))


def display_value(labels: Sequence[str], original_is_model: Column, translation: Column) -> Column:
    """What a translation says for a field, or empty: the value behind one of
    the field's labels, else the whole of a short text that names no tag,
    model or standard."""
    t = F.trim(translation)
    labelled = _behind_label(labels, t)
    model = t.contains("型号") & ~original_is_model
    unfit = (F.length(t) > 160) | (F.regexp_count(t, F.lit(r"\|")) > 1) | t.rlike(r"(?iU)\b(?:TAG\s*(?:NO)?|MODEL|STANDARD)\b") | model
    return F.when((t == "") | ~text.has_cjk(t), "").when(labelled.isNotNull(), F.trim(labelled)).when(unfit, "").otherwise(text.fold_space(t))


def _shown(translation: Column) -> list[Column]:
    """What a translation with Chinese says, once for all classes of fields:
    behind the labels of each, and as a whole for values without and with a model."""
    t = F.trim(translation)
    each = F.array(*(F.struct(F.lit(name).alias("class"), F.trim(_behind_label(labels, t)).alias("selected")) for name, labels in dims.TRANSLATED_LABELS.items()))
    return [F.filter(each, lambda x: x["selected"].isNotNull()).alias("labelled"), *(display_value((), F.lit(m), t).alias(c) for c, m in (("plain", False), ("plain_model", True)))]


def _selected(shown: Callable[[str], Column], name: Column, model: Column) -> Column:
    """:func:`display_value` for a class of fields, from the columns of :func:`_shown`."""
    own = F.get(F.filter(shown("labelled"), lambda x: x["class"] == name), F.lit(0))["selected"]
    return F.coalesce(own, F.when(model, shown("plain_model")).otherwise(shown("plain")))


def _class_of(field: Column) -> Column:
    return F.when(field.isin(*dims.TRANSLATED_LABELS), field).otherwise("")


def first_translations(values: DataFrame, segments: DataFrame) -> DataFrame:
    """For each value with a fitting translation the first one: (value_id,
    source_ord, seg_ord, selected).

    ``values``: value_id, source_ord, field, original_value, files (paths), and
    the levels; one row for each supporting source. ``segments``: seg_ord,
    files, the levels, original, translation. The first source that any
    segment fits counts, and of its segments the first with something to show."""
    places = [coordinate(F.col(x), x).alias(x) for x in LEVELS]
    names = F.transform("files", base_name).alias("_files")
    v = _by_file(values.select("value_id", "source_ord", _class_of(F.col("field")).alias("class"), F.lower("original_value").contains("model").alias("model"), text.evidence_text(F.col("original_value")).alias("t"), names, *places).where("t <> ''"))
    s = segments.where(text.has_cjk(F.col("translation"))).select("seg_ord", text.evidence_text(F.col("original")).alias("t"), *_shown(F.col("translation")), names, *places).where("t <> ''")
    s = written(_by_file(s), "segments")
    large = _large(s)
    t = F.col("t")
    held = lambda x: _compatible(x) & (F.contains(x["t"], t) | F.contains(t, x["t"]))
    told = lambda x: F.struct(x["seg_ord"].alias("seg_ord"), _selected(lambda c: x[c], F.col("class"), F.col("model")).alias("selected"))
    x = F.array_min(F.filter(F.transform(F.filter("segs", held), told), lambda x: x["selected"] != ""))
    found = _looked_up(v, s, large).select("value_id", "source_ord", x.alias("x")).where("x is not null")
    if large is not None:
        found = found.union(_first_by_grams(v.join(large, "_file", "left_semi"), s.join(large, "_file", "left_semi")))
    chosen = found.groupBy("value_id").agg(F.min(F.struct("source_ord", "x.seg_ord", "x.selected")).alias("c"))
    return chosen.select("value_id", "c.source_ord", "c.seg_ord", "c.selected")


def _first_by_grams(v: DataFrame, s: DataFrame) -> DataFrame:
    """(value_id, source_ord, x) of files with any number of segments."""
    every = F.array(*(F.struct(F.lit(name).alias("class"), F.lit(m).alias("model"), _selected(F.col, F.lit(name), F.lit(m)).alias("selected")) for name in (*dims.TRANSLATED_LABELS, "") for m in (False, True)))
    v = written(v.withColumn("_mask", _mask()), "values")
    s = written(s.withColumn("_mask", _mask()).withColumn("shows", F.filter(every, lambda x: x["selected"] != "")).drop("labelled", "plain", "plain_model").where("size(shows) > 0"), "segments")
    on = ["place", "pair"]
    placed_v = written(_placed(v, s), "placed")
    placed_s = _placed(s, v).withColumn("pair", F.struct(F.col("_other").alias("_mask"), F.col("_mask").alias("_other")))
    best = placed_s.select(*on, "t", "seg_ord", F.explode("shows").alias("x")).groupBy(*on, "t", "x.class", "x.model").agg(F.min(F.struct("seg_ord", "x.selected")).alias("x"))
    best = written(best, "translations")
    pairs = containing(placed_v, best, on).select(*on, F.col("small").alias("vt"), F.col("large").alias("st"))
    back = containing(best, placed_v, on).select(*on, F.col("large").alias("vt"), F.col("small").alias("st"))
    met = pairs.union(back).distinct().join(best.withColumnRenamed("t", "st"), [*on, "st"])
    first = met.groupBy(*on, F.col("vt").alias("t"), "class", "model").agg(F.min("x").alias("x"))
    return placed_v.select(*on, "t", "class", "model", "value_id", "source_ord").join(first, [*on, "t", "class", "model"]).select("value_id", "source_ord", "x")


def apply_translations(values: DataFrame, segments: DataFrame) -> DataFrame:
    """Values (value_id, field, other_name, value_cn and what
    :func:`first_translations` reads) with ``value_cn`` brought up to date,
    and the source and segment that it rests on.

    Only fields that hold words take a translation. A Chinese value that the
    translation merely adds to stays, and rests on it only if it says the same."""
    others = F.col("field") == "others"
    known = F.create_map(*(F.lit(x) for pair in dims.TRANSLATABLE_OTHERS.items() for x in pair))
    fit = F.when(others, known[F.col("other_name")].isNotNull()).otherwise(F.col("field").isin("pump_type", "fluid_name", "wetted_parts_material"))
    named = values.withColumn("_field", F.when(others, F.col("other_name")).otherwise(F.col("field")))
    rows = named.where(fit).select("value_id", "source_ord", F.col("_field").alias("field"), "original_value", "files", *LEVELS)
    found = first_translations(rows, segments)
    one = values.groupBy("value_id").agg(*(F.min(c).alias(c) for c in ("field", "other_name", "value_cn")))
    met = one.join(found, "value_id", "left")
    old = F.trim(F.coalesce("value_cn", F.lit("")))
    body = F.when((F.col("field") == "others") & old.contains("："), F.trim(F.regexp_replace(old, "(?s)^.*?：", ""))).otherwise(old)
    tight = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    kept = text.has_cjk(body) & F.contains(tight(F.col("selected")), tight(body))
    same = tight(body) == tight(F.col("selected"))
    new = F.when(F.col("field") == "others", F.concat(known[F.col("other_name")], F.lit("："), "selected")).otherwise(F.col("selected"))
    rests = F.col("selected").isNotNull() & (~kept | same)
    return met.select("value_id", F.when(F.col("selected").isNull() | kept, F.col("value_cn")).otherwise(new).alias("value_cn"), F.when(rests, F.col("source_ord")).alias("source_ord"), F.when(rests, F.col("seg_ord")).alias("seg_ord"))


def best_translations(values: DataFrame, segments: DataFrame) -> DataFrame:
    """For each value the segment that speaks of it most: (value_id, score,
    seg_ord, translation).

    ``values``: value_id, original_value, aliases (names of its field), files
    and the levels; ``segments`` as for :func:`first_translations`. A compatible
    segment that holds the value scores 8, one that also names the field 12, one
    that only names it 6; of equal scores the first counts, below there is none."""
    places = [coordinate(F.col(x), x).alias(x) for x in LEVELS]
    names = F.transform("files", base_name).alias("_files")
    aliases = F.array_sort(F.filter(F.array_distinct(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), text.evidence_text)), lambda a: a != ""))
    v = _by_file(values.select("value_id", text.evidence_text(F.col("original_value")).alias("t"), aliases.alias("aliases"), names, *places))
    s = segments.where(F.trim("translation") != "").select("seg_ord", text.evidence_text(F.col("original")).alias("t"), F.trim("translation").alias("translation"), names, *places).where("t <> ''")
    s = written(_by_file(s), "segments")
    large = _large(s)
    near = _looked_up(v, s, large)

    def told(x: Column) -> Column:
        has = (F.col("t") != "") & F.contains(x["t"], F.col("t"))
        named = F.exists("aliases", lambda a: F.contains(x["t"], a))
        score = F.when(has, F.when(named, 12).otherwise(8)).when(named, 6)
        return F.struct(score.alias("score"), (-x["seg_ord"]).alias("back"), x["seg_ord"].alias("seg_ord"), x["translation"].alias("translation"))

    b = F.array_max(F.filter(F.transform(F.filter("segs", _compatible), told), lambda x: x["score"].isNotNull()))
    found = near.select("value_id", b.alias("b")).where("b is not null")
    if large is not None:
        found = found.union(_best_by_grams(v.join(large, "_file", "left_semi"), s.join(large, "_file", "left_semi")))
    return found.groupBy("value_id").agg(F.max("b").alias("b")).select("value_id", F.col("b.score").cast("long").alias("score"), "b.seg_ord", "b.translation")


def _best_by_grams(v: DataFrame, s: DataFrame) -> DataFrame:
    """(value_id, b) of files with any number of segments. Those that hold the
    value are found by grams and then asked for the names; names alone are
    answered once for each place and name."""
    v, s = written(v.withColumn("_mask", _mask()), "values"), written(s.withColumn("_mask", _mask()), "segments")
    on = ["place", "pair"]
    placed_v = written(_placed(v, s).select("value_id", *on, "t", "aliases"), "placed")
    placed_s = _placed(s, v).withColumn("pair", F.struct(F.col("_other").alias("_mask"), F.col("_mask").alias("_other")))
    first = written(placed_s.groupBy(*on, "t").agg(F.max(F.struct((-F.col("seg_ord")).alias("back"), "seg_ord", "translation")).alias("s")), "translations")
    asked = placed_v.select(*on, "t", "aliases").distinct()
    held = containing(asked, first, on).join(asked.withColumnRenamed("t", "small"), [*on, "small"])
    named = F.exists("aliases", lambda a: F.contains(F.col("large"), a))
    told = lambda score: F.struct(score.alias("score"), "s.back", "s.seg_ord", "s.translation")
    scored = held.withColumn("score", F.when(named, 12).otherwise(8)).join(first.withColumnRenamed("t", "large"), [*on, "large"])
    by_value = scored.groupBy(*on, F.col("small").alias("t"), "aliases").agg(F.max(told(F.col("score"))).alias("b"))
    alias = asked.select(*on, F.explode("aliases").alias("t")).distinct()
    by_alias = containing(alias, first, on).join(first.withColumnRenamed("t", "large"), [*on, "large"]).groupBy(*on, F.col("small").alias("alias")).agg(F.max(told(F.lit(6))).alias("b"))
    mine = placed_v.select("value_id", *on, F.explode("aliases").alias("alias")).join(by_alias, [*on, "alias"]).select("value_id", "b")
    return placed_v.join(by_value, [*on, "t", "aliases"]).select("value_id", "b").union(mine)
