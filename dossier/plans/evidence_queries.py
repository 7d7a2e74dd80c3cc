"""Evidence queries: translations by place and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import located
from ..runtime import table

_FIELDS = ("pump_type", "fluid_name", "wetted_parts_material", "others", "density")
_OTHERS = ("service_name", "driver", "quantity")


def _nth(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _turns(spark, d):
    """Turns play sheets of a workbook for each conversation; each names some of its place."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    file = F.concat(F.lit("set/Conv_"), F.col("conv_id").cast("string"), F.lit(".XLSX"))
    return c.withColumn("file", file)


def _segments(spark, d):
    """Each line of a turn with a translation: behind a label, bare, or none."""
    lines = _turns(spark, d).select("*", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    n = F.col("conv_id") + F.col("turn") + F.col("k")
    told = F.when(n % 4 == 0, F.concat(F.lit("备注 | 介质："), F.col("line"))).when(n % 4 == 1, F.concat(F.lit("设备类型= "), "line", F.lit("；材质：钢"))).when(n % 4 == 2, F.concat(F.lit("译 "), F.substring("line", 1, 90))).otherwise(F.col("line"))
    return lines.select(
        ((F.col("conv_id") * 1000 + F.col("turn")) * 1000 + F.col("k")).alias("seg_ord"),
        F.array("file").alias("files"),
        F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("Page "), F.col("turn").cast("string"))).alias("page"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("S"), F.col("turn").cast("string"))).alias("sheet"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("$A$"), F.col("k").cast("string"))).alias("cell"),
        F.lit(None).cast("string").alias("paragraph"),
        F.col("line").alias("original"),
        told.alias("translation"),
    )


def _values(spark, d):
    """The first two words of each sentence as values; two sources each, of which the second names no sheet."""
    t = _turns(spark, d).select("*", F.posexplode(F.split("text", r"\.")).alias("k", "sentence"))
    words = F.slice(F.filter(F.split("sentence", r"[ \n]"), lambda x: x != ""), 1, 2)
    t = t.withColumn("original_value", F.array_join(words, " ")).where("original_value <> ''")
    ident = (F.col("conv_id") * 1000 + F.col("turn")) * 1000 + F.col("k")
    field = _nth(_FIELDS, F.col("k") + F.col("turn"))
    own = F.when(F.col("k") % 5 == 0, F.concat(F.lit("译 "), "original_value")).when(F.col("k") % 5 == 1, F.lit("水"))
    cell = F.when(F.col("k") % 3 == 0, F.concat(F.lit("a"), F.col("k").cast("string")))
    return t.select(
        ident.alias("value_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("source_ord"), field.alias("field"), _nth(_OTHERS, F.col("k")).alias("other_name"), "original_value", own.alias("value_cn"),
        F.array(F.concat(F.lit("x\\"), F.lower("file"))).alias("files"), F.col("turn").cast("string").alias("page"), F.col("turn").alias("n"), cell.alias("cell"), F.lit("p1").alias("paragraph"),
    ).withColumn("sheet", F.when(F.col("source_ord") == 0, F.concat(F.lit("s"), F.col("n").cast("string"))))


def evidence_translations(spark, d):
    return located.apply_translations(_values(spark, d), _segments(spark, d)).where("seg_ord is not null or value_cn is not null")


def evidence_best(spark, d):
    """For each value the line that holds it and a word that stands for its field, or one of them."""
    v = _values(spark, d).where("source_ord = 0").withColumn("aliases", F.array(_nth(("the", "und", "de la", "que"), F.col("value_id")), F.lit("")))
    return located.best_translations(v, _segments(spark, d)).select("value_id", "score", "seg_ord", F.md5(F.col("translation").cast("binary")).alias("translation_md5"))


QUERIES = {f.__name__: f for f in (evidence_translations, evidence_best)}


def _labels_sql(column: str) -> str:
    """The value behind a field's first label."""
    of = lambda labels: "coalesce(" + ", ".join(rf"nullif(regexp_extract({column}, '(?i)(?:^|[|；;\n])\s*{x}\s*[:：=]\s*([^|；;\n]+)', 1), '')" for x in labels) + ")"
    return "CASE f " + " ".join(f"WHEN '{name}' THEN {of(labels)}" for name, labels in dims.TRANSLATED_LABELS.items()) + " END"


_NORM = r"lower(trim(regexp_replace(coalesce({0}, ''), '[ \t\r\n\f]+', ' ', 'g')))"
_KNOWN = "CASE other_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.TRANSLATABLE_OTHERS.items()) + " END"

_SEG_SQL = r"""seg AS (SELECT (conv_id * 1000 + turn) * 1000 + k - 1 AS seg_ord, conv_id, CASE WHEN conv_id % 3 > 0 THEN turn END AS page, CASE WHEN turn % 2 = 0 THEN 's' || turn END AS sheet, CASE WHEN (k - 1) % 2 = 0 THEN 'a' || (k - 1) END AS cell, line,
        trim(CASE (conv_id + turn + k - 1) % 4 WHEN 0 THEN '备注 | 介质：' || line WHEN 1 THEN '设备类型= ' || line || '；材质：钢' WHEN 2 THEN '译 ' || line[1:90] ELSE line END) AS tr
      FROM (SELECT conv_id, turn, k, string_split(text, chr(10))[k] AS line FROM conversations, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(k)))"""
_VAL_SQL = r"""val AS (SELECT (conv_id * 1000 + turn) * 1000 + k - 1 AS value_id, conv_id, turn, ['pump_type', 'fluid_name', 'wetted_parts_material', 'others', 'density'][(k - 1 + turn) % 5 + 1] AS field, ['service_name', 'driver', 'quantity'][(k - 1) % 3 + 1] AS other_name,
        array_to_string(list_filter(regexp_split_to_array(sentence, '[ \n]'), lambda x: x <> '')[1:2], ' ') AS v, k - 1 AS k
      FROM (SELECT conv_id, turn, k, string_split(text, '.')[k] AS sentence FROM conversations, unnest(range(1, len(string_split(text, '.')) + 1)) AS u(k)))"""
_EVIDENCE_TRANSLATIONS = rf"""
    WITH {_SEG_SQL},
    {_VAL_SQL},
    src AS (SELECT *, CASE k % 5 WHEN 0 THEN '译 ' || v WHEN 1 THEN '水' END AS value_cn, source_ord, CASE WHEN source_ord = 0 THEN 's' || turn END AS sheet, CASE WHEN k % 3 = 0 THEN 'a' || k END AS cell,
        CASE WHEN field = 'others' THEN other_name ELSE field END AS f FROM val, unnest([0, 1]) AS u(source_ord) WHERE v <> ''),
    met AS (SELECT value_id, source_ord, seg_ord, v, f, tr, {_labels_sql("tr")} AS labelled FROM src JOIN seg ON src.conv_id = seg.conv_id AND coalesce(seg.page = src.turn, true) AND coalesce(seg.sheet = src.sheet, true) AND coalesce(seg.cell = src.cell, true)
      WHERE (field IN ('pump_type', 'fluid_name', 'wetted_parts_material') OR field = 'others' AND {_KNOWN} IS NOT NULL) AND {_NORM.format("line")} <> ''
        AND (contains({_NORM.format("line")}, {_NORM.format("v")}) OR contains({_NORM.format("v")}, {_NORM.format("line")}))),
    shown AS (SELECT value_id, source_ord, seg_ord, CASE WHEN NOT regexp_matches(tr, '[一-鿿]') THEN '' WHEN labelled IS NOT NULL THEN trim(labelled)
        WHEN length(tr) > 160 OR length(tr) - length(replace(tr, '|', '')) > 1 OR regexp_matches(tr, '(?i)\b(?:TAG\s*(?:NO)?|MODEL|STANDARD)\b') THEN '' ELSE trim(regexp_replace(tr, '\s+', ' ', 'g')) END AS s FROM met),
    best AS (SELECT value_id, min(ROW(source_ord, seg_ord, s)) AS b FROM shown WHERE s <> '' GROUP BY value_id),
    one AS (SELECT DISTINCT value_id, field, other_name, value_cn, trim(coalesce(value_cn, '')) AS body FROM src),
    j AS (SELECT one.*, b[3] AS s, b[1] AS source_ord, b[2] AS seg_ord, regexp_matches(body, '[一-鿿]') AND contains(regexp_replace(b[3], '\s+', '', 'g'), regexp_replace(body, '\s+', '', 'g')) AS kept,
        regexp_replace(b[3], '\s+', '', 'g') = regexp_replace(body, '\s+', '', 'g') AS same FROM one LEFT JOIN best USING (value_id))
    SELECT * FROM (SELECT value_id, CASE WHEN s IS NULL OR kept THEN value_cn WHEN field = 'others' THEN {_KNOWN} || '：' || s ELSE s END AS value_cn,
      CASE WHEN s IS NOT NULL AND (NOT kept OR same) THEN source_ord END AS source_ord, CASE WHEN s IS NOT NULL AND (NOT kept OR same) THEN seg_ord END AS seg_ord FROM j) WHERE seg_ord IS NOT NULL OR value_cn IS NOT NULL"""

_EVIDENCE_BEST = rf"""
    WITH {_SEG_SQL},
    {_VAL_SQL},
    q AS (SELECT *, {_NORM.format("v")} AS nv, ['the', 'und', 'de la', 'que'][value_id % 4 + 1] AS alias, 's' || turn AS sheet, CASE WHEN k % 3 = 0 THEN 'a' || k END AS cell FROM val WHERE v <> ''),
    met AS (SELECT value_id, seg_ord, tr, contains(nt, nv) AS has, contains(nt, alias) AS named FROM q JOIN (SELECT *, {_NORM.format("line")} AS nt FROM seg) seg ON q.conv_id = seg.conv_id AND coalesce(seg.page = q.turn, true) AND coalesce(seg.sheet = q.sheet, true) AND coalesce(seg.cell = q.cell, true)
      WHERE nt <> '' AND tr <> ''),
    best AS (SELECT *, CASE WHEN has AND named THEN 12 WHEN has THEN 8 ELSE 6 END AS score FROM met WHERE has OR named)
    SELECT value_id, score::BIGINT AS score, seg_ord, md5(full_tr) AS translation_md5 FROM (SELECT value_id, score, seg_ord, tr AS full_tr, row_number() OVER (PARTITION BY value_id ORDER BY score DESC, seg_ord) AS r FROM best) WHERE r = 1"""

ORACLE_SQL = {"evidence_translations": _EVIDENCE_TRANSLATIONS, "evidence_best": _EVIDENCE_BEST}
