"""Data sheet queries: orders play pages, their lines the rows of a sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sheets
from ..runtime import table

# what a line says, by kind of sheet and line number; {x} is a column
_HEADS = {
    0: "CONTROLLED VOLUME PUMP DATA SHEET API 675 ITEM NO. PK{order6} PUMP ITEM NO'S P{order5}A , B",
    1: "DATA SHEET Centrifugal Pump\nITEM NUMBER {cust}-P-{order}AB SERVICE",
    2: "Process Datasheet GENERAL DATA Tag No.: Z01-SYN-{order5}-P{cust} A/B Description: {priority} pump 1 Fluid Name / State: {priority} / Liquid Quantity: 2",
}
_LINES = {
    0: ("CAPACITY @ PT (l/hr): MAXIMUM {q}0 MINIMUM {q} NORMAL{normal}", "SUCTION PRESSURE (BARG): MAXIMUM {d}.5", "SERVICE {name}\nMODEL M{q}", "VISCOSITY (cP) {t}.5", "SPECIFIC GRAVITY MAX 1.{d} MIN 1.0", "RATED CAPACITY (l/hr)  {rated}", "NO. OF PUMPS REQUIRED {q} ({t})"),
    1: ("{name} CASE 1", "CAPACITY (each)\nm3/hr {q} FURNISHED BY x", "SUCTION PRESSURE (kg/cm2)g {d}.5", "NORM/MIN/MAX TEMP {q} / 20 / 60 C MAX HEAD 3", "PUMP TYPE {kind} SKID", "PIPE MATERIAL {brand}\nTYPE t", "VISCOSITY @ P&T cP {t}.25 SEAL FLUSH no"),
    2: ("Service: {name} Type: {kind} 2 OPERATING DATA", "Operating Temperature (oC) {q} 3 Operating Pressure (barg) 2", "Suction / Discharge Pressure (barg) {d} / {q} 9 ELECTRICAL DATA", "Liquid Density (Kg/m3) 9{t}0 5 Liquid Viscosity (cP) {q} 6 DESIGN DATA", "Material {brand} 10 Differential Pressure 5.0", "", "more"),
}
_TAILS = ("OPERATING CONDITIONS", "CASE 9", "NOTES")
_STUFF = "API 675 {item}MATERIALS LIQUID END {brand} FRAME Carbon PROCESS DIAPHRAGM {kind}"


def _said(template: str, columns: dict):
    """A template with columns in place of names."""
    parts = [p.split("}") for p in template.split("{")]
    out = [F.lit(parts[0][0])]
    for name, rest in parts[1:]:
        out += [columns[name], F.lit(rest)]
    return F.concat(*out)


def _pages(spark, d):
    """(file, page, line, text): a page for each order, and one of materials for every other pump sheet."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("priority"), (F.col("o_orderkey") % 3).alias("sheet"))
    order = F.col("o_orderkey").cast("string")
    own = {"order": order, "order5": F.lpad(order, 5, "0"), "order6": F.lpad(order, F.greatest(F.length(order), F.lit(6)), "0"), "cust": F.col("o_custkey").cast("string"), "priority": F.col("priority")}
    by = lambda of: F.coalesce(*(F.when(F.col("sheet") == k, of(k)) for k in range(3)))
    place = (F.concat(F.lit("F"), F.col("o_custkey").cast("string")).alias("file"), (F.col("o_orderkey") * 2).alias("page"))
    heads = o.select(*place, F.lit(0).alias("line"), by(lambda k: _said(_HEADS[k], own)).alias("text"))
    ends = o.select(*place, F.lit(99).alias("line"), F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("sheet") + 1).cast("int")).alias("text"))
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"))
    whole = lambda c: F.round(c).cast("long").cast("string")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", whole(F.col("l_quantity")).alias("q"), whole(F.col("l_discount") * 100).alias("d"), whole(F.col("l_tax") * 100).alias("t"))
    li = li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(o, "o_orderkey")
    said = {c: F.col(c) for c in ("q", "d", "t", "name", "kind", "brand")}
    said["normal"] = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit(" "), "q", F.lit("5"))).otherwise("")
    said["rated"] = F.when(F.col("l_partkey") % 5 == 0, "---").otherwise(F.col("q"))
    body = li.select(*place, F.col("l_linenumber").cast("int").alias("line"), by(lambda k: F.coalesce(*(F.when(F.col("l_linenumber") == n + 1, _said(x, said)) for n, x in enumerate(_LINES[k])))).alias("text"))
    item = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("ITEM NO. PK"), own["order6"], F.lit(" "))).otherwise("")
    first = li.where("l_linenumber = 1 and sheet = 0 and o_orderkey % 2 = 0").groupBy("o_orderkey", "o_custkey").agg(F.min(F.struct("brand", "kind")).alias("m")).select("*", "m.*")
    stuff = first.select(place[0], F.when(F.col("o_custkey") % 2 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey") * 2 + 1).alias("page"), F.lit(1).alias("line"), _said(_STUFF, {"item": item, "brand": F.col("brand"), "kind": F.col("kind")}).alias("text"))
    return heads.union(ends).union(body).union(stuff)


def sheet_cards(spark, d):
    return sheets.cards(_pages(spark, d)).select("file", "page", "tag", "name", "value", "unit", F.coalesce("note", F.lit("")).alias("note"))


QUERIES = {f.__name__: f for f in (sheet_cards,)}


def _text_sql(template: str, columns: dict[str, str]) -> str:
    parts = [p.split("}") for p in template.replace("'", "''").split("{")]
    out = [f"'{parts[0][0]}'"]
    for name, rest in parts[1:]:
        out += [columns[name], f"'{rest}'"]
    return " || ".join(out)


def _sheet_cards_sql() -> str:
    own = {"order": "o_orderkey", "order5": "lpad(o_orderkey::VARCHAR, 5, '0')", "order6": "lpad(o_orderkey::VARCHAR, 6, '0')", "cust": "o_custkey", "priority": "o_orderpriority"}
    said = {"q": "round(l_quantity)::BIGINT", "d": "round(l_discount * 100)::BIGINT", "t": "round(l_tax * 100)::BIGINT", "name": "p_name", "kind": "p_type", "brand": "p_brand", "normal": "CASE WHEN l_partkey % 2 = 0 THEN ' ' || round(l_quantity)::BIGINT || '5' ELSE '' END", "rated": "CASE WHEN l_partkey % 5 = 0 THEN '---' ELSE round(l_quantity)::BIGINT::VARCHAR END", "item": "CASE WHEN o_custkey % 2 = 0 THEN 'ITEM NO. PK' || lpad(o_orderkey::VARCHAR, 6, '0') || ' ' ELSE '' END"}
    head = " ".join(f"WHEN {k} THEN {_text_sql(x, own)}" for k, x in _HEADS.items())
    line = " ".join(f"WHEN o_orderkey % 3 = {k} AND l_linenumber = {n + 1} THEN {_text_sql(x, said)}" for k, xs in _LINES.items() for n, x in enumerate(xs))
    number = r"[-+]?\d+(?:\.\d+)?"
    # each field by a pattern of its own over the page's whole text: (sheet, name, pattern with one group, unit, value)
    fields = (
        (0, "tag_no", r"PUMP\s+ITEM\s+NO'S\s+P(\d{4,8})\s*A\s*,\s*B", "''", "'P' || x || 'A/B'"),
        (0, "fluid_name", r"\bSERVICE\s+(.+?)\s+MODEL\b", "''", "'SERVICE ' || x"),
        (0, "process_capacity", rf"CAPACITY\s*@\s*PT\s*\([^)]+\)\s*:\s*MAXIMUM\s+{number}\s+MINIMUM\s+{number}\s+NORMAL\s+({number})", "'l/hr'", "x"),
        (0, "suction_pressure", rf"SUCTION\s+PRESSURE\s*\([^)]+\)\s*:\s*MAXIMUM\s+({number})", "'bar.g'", "x"),
        (0, "viscosity", rf"VISCOSITY\s*\([^)]+\)\s*({number})", "'cP'", "x"),
        (0, "density", rf"SPECIFIC\s+GRAVITY\s+MAX\s+({number})\s*MIN\b", "''", "'SG=' || x"),
        (0, "rated_capacity", rf"RATED\s+CAPACITY\s*\([^)]*\)\s+({number})\b", "'l/hr'", "x"),
        (0, "quantity", r"NO\.\s+OF\s+PUMPS\s+REQUIRED\s+\d+\s+\((\d+)\)", "''", "x"),
        (1, "tag_no", r"ITEM\s+NUMBER\s+(\d+-P-\d+)AB", "''", "x || 'A/B'"),
        (1, "service_name", r"\bSERVICE\s+((?-i:[a-z][a-z ]*?))\s+CASE\b", "''", "x"),
        (1, "process_capacity", rf"\bCAPACITY\s*\([^)]*\)\s*m3/hr\s+({number})", "'m3/hr'", "x"),
        (1, "suction_pressure", rf"SUCTION\s+PRESSURE\s*\(kg/cm2\)g\s+({number})", "'(kg/cm2)g'", "x"),
        (1, "fluid_temperature", r"NORM/MIN/MAX\s+TEMP\s+(.+?)\s*C\s+MAX\s+HEAD", "'℃'", "x"),
        (1, "pump_type", r"PUMP\s+TYPE\s+(.+?)\s+SKID", "''", "'Centrifugal Pump; ' || x"),
        (1, "wetted_parts_material", r"PIPE\s+MATERIAL\s+(.+?)\s+TYPE\b", "''", "'Pipe Material: ' || x"),
        (1, "viscosity", rf"VISCOSITY\s*@\s*P\s*&\s*T\s*cP\s+({number})", "'cP'", "x"),
        (2, "tag_no", r"Tag\s+No\.:\s*(Z\d{2}-SYN-\d{3,5}-P\d+)\s*A/B", "''", "x || ' A/B'"),
        (2, "fluid_name", r"Fluid\s+Name\s*/\s*State:\s*(.+?)\s+Quantity:", "''", "x"),
        (2, "quantity", r"Quantity:\s*(\d+)", "''", "x"),
        (2, "fluid_temperature", r"Operating\s+Temperature\s*\(oC\)\s*(.+?)\s+\d+\s+Operating\s+Pressure", "'℃'", "x"),
        (2, "suction_pressure", rf"Suction\s*/\s*Discharge\s+Pressure\s*\(barg\)\s*({number})\s*/", "'bar.g'", "x"),
        (2, "discharge_pressure", rf"Suction\s*/\s*Discharge\s+Pressure\s*\(barg\)\s*{number}\s*/\s*({number})", "'bar.g'", "x"),
        (2, "density", rf"Liquid\s+Density\s*\(Kg/m3\)\s*({number})", "'kg/m3'", "x"),
        (2, "viscosity", rf"Liquid\s+Viscosity\s*\(cP\)\s*({number})", "'cP'", "x"),
        (2, "wetted_parts_material", r"\bMaterial\s+(.+?)\s+\d+\s+Differential\s+Pressure", "''", "trim(regexp_replace(x, '[^A-Za-z0-9/ ._-].*$', ''))"),
        (2, "pump_type", r"Service:\s*(.+?\s+Type:\s*.+?)\s+\d+\s+OPERATING\s+DATA", "''", r"regexp_replace(x, '\s+Type:\s*', '; ')"),
    )
    q = lambda p: p.replace("'", "''")
    each = " UNION ALL ".join(f"SELECT file, page, sheet, o_orderkey, t, '{name}' AS name, {value} AS value, {unit} AS unit FROM (SELECT *, nullif(regexp_extract(t, '(?is){q(p)}', 1), '') AS x FROM doc WHERE sheet = {k}) WHERE x IS NOT NULL" for k, name, p, unit, value in fields)
    return rf"""
    WITH base AS (SELECT o_orderkey, o_custkey, 'F' || o_custkey AS file, o_orderkey * 2 AS page, o_orderkey % 3 AS sheet, CASE o_orderkey % 3 {head} END AS head, {list(_TAILS)}[o_orderkey % 3 + 1] AS tail, o_orderpriority FROM orders),
    body AS (SELECT o_orderkey, string_agg(s, chr(10) ORDER BY l_linenumber, s) AS b FROM (SELECT o_orderkey, l_linenumber, CASE {line} END AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) GROUP BY o_orderkey),
    doc AS (SELECT file, page, sheet, o_orderkey, o_orderpriority, regexp_replace(head || chr(10) || coalesce(b || chr(10), '') || tail, '\s+', ' ', 'g') AS t FROM base LEFT JOIN body USING (o_orderkey)),
    found AS ({each}),
    tags AS (SELECT file, page, o_orderkey, sheet, value AS tag FROM found WHERE name = 'tag_no'),
    most AS (SELECT file, page, regexp_extract(t, 'CAPACITY\s*@\s*PT\s*\(l/hr\): MAXIMUM (\d+)', 1) AS x FROM doc WHERE sheet = 0 AND (file, page) NOT IN (SELECT (file, page) FROM found WHERE name = 'process_capacity')),
    bare AS (SELECT doc.file, doc.page, o_orderpriority || ' pump' AS value FROM doc WHERE sheet = 2 AND (file, page) NOT IN (SELECT (file, page) FROM found WHERE name = 'pump_type')),
    stuff AS (SELECT o_orderkey, 'Liquid End: ' || m[1] || '; Process Diaphragm: ' || m[2] AS material FROM (SELECT l_orderkey AS o_orderkey, min(ROW(p_brand, p_type)) AS m
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1 AND l_orderkey % 2 = 0 AND l_orderkey % 3 = 0 GROUP BY l_orderkey))
    SELECT file, page, tag, name, value, unit, '' AS note FROM found JOIN tags USING (file, page)
    UNION ALL SELECT file, page, tag, 'process_capacity', x, 'l/hr', 'api675_normal_capacity_missing' FROM most JOIN tags USING (file, page) WHERE x <> ''
    UNION ALL SELECT file, page, tag, 'pump_type', value, '', '' FROM bare JOIN tags USING (file, page)
    UNION ALL SELECT file, page, tag, 'wetted_parts_material', coalesce(material, ''), '', CASE WHEN material IS NULL THEN 'api675_material_page_not_matched' ELSE '' END FROM tags LEFT JOIN stuff USING (o_orderkey) WHERE sheet = 0"""


ORACLE_SQL = {"sheet_cards": _sheet_cards_sql()}
