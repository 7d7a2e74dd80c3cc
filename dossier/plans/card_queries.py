"""Card queries: units, values, conflicts, overview, issues, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims, text, units
from ..operators import cards, export
from ..runtime import table, written
from .candidates import FLOW_UNITS, PRESSURE_UNITS, candidates, dealt, line_candidates


def _converted(c, convert):
    """Distinct values with their counts, then one conversion each."""
    n = c.groupBy("value", "unit").agg(F.count("*").alias("n_rows")).withColumn("n", convert(F.col("value"), F.col("unit")))
    return n.select("value", "unit", F.col("n.value").alias("norm_value"), F.col("n.unit").alias("norm_unit"), F.col("n.note_en").alias("note"), "n_rows")


def unit_flow(spark, d):
    return _converted(line_candidates(spark, d).where("name = 'process_capacity'"), units.normalize_flow)


def unit_pressure(spark, d):
    return _converted(line_candidates(spark, d).where("name = 'suction_pressure'"), units.normalize_pressure)


def decimal_range(spark, d):
    li = table(spark, d, "lineitem")
    v = F.concat(F.col("l_quantity").cast("long").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(".50 to "), F.col("l_linenumber").cast("string"), F.lit(",000"))).otherwise(F.lit(".0 m")))
    return li.select(v.alias("v")).groupBy("v").agg(F.count("*").alias("n_rows")).select("v", "n_rows", F.size(units.decimals(F.col("v"))).cast("long").alias("n_numbers"), units.scaled(F.col("v"), "1").alias("shown"))


def _values(spark, d):
    c = candidates(spark, d)
    mine, apart = dealt(spark, d)
    rows = cards.repeated(mine)
    if apart is None:
        return cards.values(cards.normalised(rows, numbers_of=c), dealt=True)
    return cards.values(cards.normalised(rows.unionByName(cards.repeated(apart)), numbers_of=c))


def card_values(spark, d):
    return _values(spark, d).select("card", "field", "value", "unit", "note", "n_sources", F.round("confidence", 4).alias("confidence"), "has_ref", "verified", "first_ord")


def _fields(spark, d, keep=False):
    return cards.fields(_values(spark, d), keep)


def _issues(spark, d, f):
    return cards.issues(f, cards.card_key(candidates(spark, d)))


def card_conflicts(spark, d):
    return _fields(spark, d).where(F.col("status") == dims.CONFLICT).select("card", "tag", "field", "n_values", "display")


def card_missing(spark, d):
    return _fields(spark, d).where(F.col("status") == dims.MISSING).groupBy("field").agg(F.count("*").alias("n_cards"), F.min("card").alias("first_card"))


def card_overview(spark, d):
    return cards.overview(_fields(spark, d)).select("card", "tag", "pump_type", "density", "process_capacity", "suction_pressure", "others", "n_conflict", "n_missing", "n_low")


def card_issues(spark, d):
    return _issues(spark, d, _fields(spark, d))


def issue_counts_by_code(spark, d):
    return card_issues(spark, d).groupBy("code", "severity").agg(F.count("*").alias("n_issues"), F.countDistinct("card").alias("n_cards"))


def card_stats(spark, d):
    f = written(_fields(spark, d).select("card", "field", "n_values", "status", "review"), "fields")
    return cards.statistics(f, _issues(spark, d, f))


def export_parameters(spark, d):
    return export.parameters(_fields(spark, d, keep=True)).withColumn("confidence", F.round("confidence", 4))


def export_issues(spark, d):
    f = written(_fields(spark, d, keep=True).drop("display"), "fields")  # read for both kinds of findings
    return export.issue_rows(_issues(spark, d, f), export.parameters(f))


def duplicate_tags(spark, d):
    return cards.duplicate_tags(candidates(spark, d))


def natural_sort_rank(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("P-"), F.col("p_partkey").cast("string"), F.lit("/"), F.col("p_brand")).alias("tag"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("p-"), F.col("s_suppkey").cast("string")).alias("tag"))
    t = p.union(s).select("tag", F.lower("tag").alias("card")).distinct()
    return cards.in_natural_order(t).select("tag", "place")


def template_coverage(spark, d):
    """Field dimension against the cards that have it."""
    f = _fields(spark, d).where(F.col("status") != dims.MISSING).groupBy("field").agg(F.countDistinct("card").alias("n_cards"), F.min("card").alias("first_card"))
    return dims.fields_table(spark).join(f, "field", "left").select("field", F.col("field_ord").cast("long").alias("field_ord"), F.coalesce("n_cards", F.lit(0)).alias("n_cards"), "first_card", F.when(F.col("n_cards").isNull(), "missing").otherwise("covered").alias("coverage"))


def card_page_modes(spark, d):
    """Estimated lines of a card; over 17 it takes a page of its own."""
    f = _fields(spark, d).where("field <> 'tag_no'")
    n = f.groupBy("card").agg(F.sum(text.wrapped_lines(F.col("display"), 34)).alias("n_lines"), F.sum(F.length("display")).alias("n_chars"))
    return n.select("card", "n_lines", "n_chars", F.when((F.col("n_lines") > 17) | (F.col("n_chars") > 650), "single").otherwise("paired").alias("page_mode"))


QUERIES = {f.__name__: f for f in (unit_flow, unit_pressure, decimal_range, card_values, card_conflicts, card_missing, card_overview, card_issues, issue_counts_by_code, card_stats, export_parameters, export_issues, duplicate_tags, natural_sort_rank, template_coverage, card_page_modes)}

_list = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"
_PLAIN = "regexp_replace(regexp_replace(({0})::DECIMAL(38,10)::VARCHAR, '0+$', ''), '\\.$', '')"

LINE_SQL = f"""line AS (SELECT 'P-' || l_partkey AS tag, p.name, p.value, p.unit, (l_orderkey * 10 + l_linenumber) * 10 + p.k AS ord, l_orderkey || ':' || l_linenumber AS source_row,
    CASE WHEN l_tax < 0.07 THEN l_orderkey || ':' || l_linenumber END AS ref, l_tax < 0.05 AS verified, 1.0 - l_tax AS confidence
  FROM lineitem, unnest([
    {{'k': 0, 'name': 'density', 'value': (l_partkey % 3 + 980)::VARCHAR, 'unit': 'kg/m3'}},
    {{'k': 1, 'name': 'process_capacity', 'value': l_quantity::BIGINT::VARCHAR, 'unit': {_list(FLOW_UNITS)}[l_linenumber % {len(FLOW_UNITS)} + 1]}},
    {{'k': 2, 'name': 'suction_pressure', 'value': round(l_discount * 100)::BIGINT::VARCHAR, 'unit': {_list(PRESSURE_UNITS)}[l_linenumber % {len(PRESSURE_UNITS)} + 1]}}]) AS u(p))"""
CAND_SQL = f"""{LINE_SQL}, cand AS (SELECT * FROM line UNION ALL
  SELECT 'p-' || p_partkey, 'pump_type', p_type, '', p_partkey, 'part:' || p_partkey, 'part:' || p_partkey, true, 0.98 FROM part)"""


def _flow_sql(v: str, u: str) -> tuple[str, str, str]:
    val = f"CASE {u} WHEN 'm3/h' THEN {_PLAIN.format(v + '::DECIMAL(20,6) * 1000')} WHEN 'L/min' THEN {_PLAIN.format(v + '::DECIMAL(20,6) * 60')} ELSE {v} END"
    return val, f"CASE WHEN {u} = 'gpm' THEN 'gpm' ELSE 'L/h' END", f"CASE WHEN {u} = 'gpm' THEN '{units.REVIEW[1]}' ELSE '' END"


def _pressure_sql(v: str, u: str) -> tuple[str, str, str]:
    n = f"{v}::DECIMAL(20,6)"
    val = f"CASE {u} WHEN 'bar abs' THEN {_PLAIN.format(n + ' * 0.1')} WHEN 'kPa' THEN {_PLAIN.format(n + ' * 0.001')} WHEN 'kg/cm2 g' THEN {_PLAIN.format(f'floor({n} * 0.980665 * 100) / 100.0')} ELSE {v} END"
    unit = f"CASE WHEN {u} IN ('bar abs', 'kPa', 'MPa') THEN 'MPa' WHEN {u} IN ('bar g', 'kg/cm2 g') THEN 'bar.g' ELSE {u} END"
    note = f"CASE WHEN {u} = 'bar abs' THEN '{units.ABSOLUTE[1]}' WHEN {u} IN ('kPa', 'MPa') THEN '{units.NO_BASIS[1]}' WHEN {u} = 'psi' THEN '{units.REVIEW[1]}' ELSE '' END"
    return val, unit, note


_fv, _fu, _fn = _flow_sql("value", "unit")
_pv, _pu, _pn = _pressure_sql("value", "unit")
NORMAL_SQL = f"""{CAND_SQL}, normal AS (SELECT *, lower(tag) AS card, name AS field,
    CASE name WHEN 'process_capacity' THEN {_fv} WHEN 'suction_pressure' THEN {_pv} ELSE value END AS norm_value,
    CASE name WHEN 'process_capacity' THEN {_fu} WHEN 'suction_pressure' THEN {_pu} ELSE unit END AS norm_unit,
    CASE name WHEN 'process_capacity' THEN {_fn} WHEN 'suction_pressure' THEN {_pn} ELSE '' END AS note FROM cand)"""
VALUES_SQL = f"""{NORMAL_SQL}, vals AS (SELECT card, field, lower(norm_value) AS vk, lower(norm_unit) AS uk, min(ord) AS first_ord, arg_min(tag, ord) AS tag, arg_min(norm_value, ord) AS value, arg_min(norm_unit, ord) AS unit,
    arg_min(note, ord) AS note, count(*) AS n_sources, min(confidence) AS confidence, bool_or(ref IS NOT NULL) AS has_ref, bool_and(verified) AS verified FROM normal GROUP BY card, field, vk, uk)"""
_DIM = "(VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(dims.CARD_FIELDS)) + ") AS dim(field_ord, field)"
FIELDS_SQL = f"""{VALUES_SQL}, per AS (SELECT card, field, count(*) AS n_values, string_agg(trim(value || CASE WHEN unit <> '' THEN ' ' || unit ELSE '' END), '；' ORDER BY first_ord, value || ' ' || unit) AS display, bool_or(NOT verified AND NOT has_ref) AS low FROM vals GROUP BY card, field),
  cards AS (SELECT card, arg_min(tag, first_ord) AS tag FROM vals GROUP BY card),
  flds AS (SELECT card, tag, field_ord, field, n::BIGINT AS n_values, coalesce(display, CASE WHEN field = 'tag_no' THEN tag END, '') AS display,
      CASE WHEN n = 0 THEN '{dims.MISSING}' WHEN n > 1 AND field <> 'others' THEN '{dims.CONFLICT}' WHEN low THEN '{dims.LOW_CONFIDENCE}' ELSE '{dims.EXTRACTED}' END AS status
    FROM (SELECT c.card, c.tag, dim.field_ord, dim.field, display, low, coalesce(n_values, CASE WHEN dim.field = 'tag_no' THEN 1 ELSE 0 END) AS n FROM cards c CROSS JOIN {_DIM} LEFT JOIN per ON per.card = c.card AND per.field = dim.field))"""
ISSUES_SQL = f"""{FIELDS_SQL}, iss AS (SELECT *, 'issue_' || substr(sha1(code || ':' || card || ':' || field_name), 1, 12) AS issue_id FROM (
    SELECT card, field AS field_name, CASE status WHEN '{dims.MISSING}' THEN 'source_field_missing' WHEN '{dims.CONFLICT}' THEN 'field_value_conflict' ELSE 'source_evidence_low_confidence' END AS code,
      CASE WHEN status = '{dims.CONFLICT}' THEN 'high_risk' ELSE 'warning' END AS severity FROM flds WHERE status <> '{dims.EXTRACTED}'
    UNION ALL SELECT DISTINCT card, field, 'pressure_value_or_unit_unrecognized', 'high_risk' FROM normal WHERE note = '{units.REVIEW[1]}'
    UNION ALL SELECT card, 'tag_no', 'duplicate_tag_merged', 'information' FROM normal GROUP BY card HAVING count(DISTINCT source_row) > 1))"""
PARAMS_SQL = f"""params AS (SELECT f.card, f.tag, f.field, f.status, coalesce(v.value, CASE WHEN f.field = 'tag_no' THEN f.tag END, '') AS value, coalesce(v.unit, '') AS unit, coalesce(v.n_sources, 0)::BIGINT AS n_sources,
    CASE WHEN verified THEN 'yes' WHEN NOT verified THEN 'no' ELSE '' END AS evidence_verified, round(v.confidence, 4) AS confidence,
    CASE WHEN v.card IS NULL AND f.field <> 'tag_no' THEN 'f_field_without_values' WHEN NOT has_ref THEN 'f_parameter_without_source' END AS issue
  FROM flds f LEFT JOIN vals v ON v.card = f.card AND v.field = f.field)"""
_count = lambda s: f"count(*) FILTER (status = '{s}')"

ORACLE_SQL = {
    "unit_flow": f"WITH {LINE_SQL} SELECT value, unit, {_fv} AS norm_value, {_fu} AS norm_unit, {_fn} AS note, count(*) AS n_rows FROM line WHERE name = 'process_capacity' GROUP BY ALL",
    "unit_pressure": f"WITH {LINE_SQL} SELECT value, unit, {_pv} AS norm_value, {_pu} AS norm_unit, {_pn} AS note, count(*) AS n_rows FROM line WHERE name = 'suction_pressure' GROUP BY ALL",
    "decimal_range": """WITH x AS (SELECT l_quantity::BIGINT AS q, l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT CASE WHEN k % 2 = 0 THEN q || '.50 to ' || k || ',000' ELSE q || '.0 m' END AS v, sum(n)::BIGINT AS n_rows, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n_numbers, CASE WHEN k % 2 = 0 THEN q || '.5-' || k || '000' ELSE q::VARCHAR END AS shown FROM x GROUP BY ALL""",
    "card_values": f"WITH {VALUES_SQL} SELECT card, field, value, unit, note, n_sources, round(confidence, 4) AS confidence, has_ref, verified, first_ord FROM vals",
    "card_conflicts": f"WITH {FIELDS_SQL} SELECT card, tag, field, n_values, display FROM flds WHERE status = '{dims.CONFLICT}'",
    "card_missing": f"WITH {FIELDS_SQL} SELECT field, count(*) AS n_cards, min(card) AS first_card FROM flds WHERE status = '{dims.MISSING}' GROUP BY field",
    "card_overview": f"WITH {FIELDS_SQL} SELECT card, max(tag) AS tag, " + ", ".join(f"max(display) FILTER (field = '{f}') AS {f}" for f in ("pump_type", "density", "process_capacity", "suction_pressure", "others")) + f", {_count(dims.CONFLICT)} AS n_conflict, {_count(dims.MISSING)} AS n_missing, {_count(dims.LOW_CONFIDENCE)} AS n_low FROM flds GROUP BY card",
    "card_issues": f"WITH {ISSUES_SQL} SELECT card, field_name, code, severity, issue_id FROM iss",
    "issue_counts_by_code": f"WITH {ISSUES_SQL} SELECT code, severity, count(*) AS n_issues, count(DISTINCT card) AS n_cards FROM iss GROUP BY code, severity",
    "card_stats": f"WITH {ISSUES_SQL} SELECT * FROM (SELECT count(DISTINCT card) AS n_cards, 0::BIGINT AS n_untagged, {_count(dims.CONFLICT)} AS n_conflicts, {_count(dims.MISSING)} AS n_missing, {_count(dims.LOW_CONFIDENCE)} AS n_low, sum(n_values)::BIGINT AS n_values FROM flds) CROSS JOIN (SELECT count(*) AS n_issues, count(*) FILTER (code = 'duplicate_tag_merged') AS n_merged FROM iss)",
    "export_parameters": f"WITH {FIELDS_SQL}, {PARAMS_SQL} SELECT * FROM params",
    "export_issues": f"""WITH {ISSUES_SQL}, {PARAMS_SQL}, every AS (SELECT card, field_name, code, severity, issue_id FROM iss UNION ALL
        SELECT DISTINCT card, field, issue, 'warning', 'f_' || substr(sha1(issue || ':' || card || ':' || field), 1, 12) FROM params WHERE issue IS NOT NULL) SELECT *, 'confirm' AS review_action FROM every""",
    "duplicate_tags": f"WITH {CAND_SQL} SELECT lower(tag) AS card, count(DISTINCT source_row) AS n_rows, count(*) AS n_candidates FROM cand GROUP BY 1 HAVING count(DISTINCT source_row) > 1",
    "natural_sort_rank": """WITH t AS (SELECT DISTINCT tag FROM (SELECT 'P-' || p_partkey || '/' || p_brand AS tag FROM part UNION ALL SELECT 'p-' || s_suppkey FROM supplier))
        SELECT tag, row_number() OVER (ORDER BY array_to_string([CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END for x in regexp_extract_all(lower(tag), '[0-9]+|[^0-9]+')], ''), lower(tag)) AS place FROM t""",
    "template_coverage": f"WITH {FIELDS_SQL}, c AS (SELECT field, count(DISTINCT card) AS n_cards, min(card) AS first_card FROM flds WHERE status <> '{dims.MISSING}' GROUP BY field) SELECT dim.field, field_ord::BIGINT AS field_ord, coalesce(n_cards, 0) AS n_cards, first_card, CASE WHEN n_cards IS NULL THEN 'missing' ELSE 'covered' END AS coverage FROM {_DIM} LEFT JOIN c ON c.field = dim.field",
    "card_page_modes": f"""WITH {FIELDS_SQL}, w AS (SELECT card, sum(greatest(1, ceil((length(display) + length(regexp_replace(display, '[\\x00-\\x7F]', '', 'g'))) / 34.0)))::BIGINT AS n_lines, sum(length(display))::BIGINT AS n_chars FROM flds WHERE field <> 'tag_no' GROUP BY card)
        SELECT card, n_lines, n_chars, CASE WHEN n_lines > 17 OR n_chars > 650 THEN 'single' ELSE 'paired' END AS page_mode FROM w""",
}
