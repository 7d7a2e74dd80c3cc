"""Data sheets: labels, sections and parts of a page, read as a machine over
ordered rows.

A grammar is a small table of spellings. A page's lines, in order (lines with
equal numbers by their text), are cut at every spelling at once; each cut is a
row. What a row means hangs on what came before it on the page: a part
(``MAXIMUM``) belongs to the section that is open, and a stop closes it. That
state is carried over the rows by running ``last`` values, so values and labels
may span lines, and a page is the largest group. Slots then turn (section, part)
into card fields by precedence.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import written
from .evidence import keyed_or_next

API675, CENTRIFUGAL, MULTISOURCE = "api675", "centrifugal", "multisource"
NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?"


class Spelling(NamedTuple):
    sheet: str
    #: a blank stands for any white space
    label: str
    #: section opened, or "" for a part of the open one
    section: str = ""
    part: str = ""
    #: ends the value before it and has none of its own
    stop: bool = False


def _api(label: str, section: str = "", part: str = "", stop: bool = False) -> Spelling:
    return Spelling(API675, label, section, part, stop)


def _pump(label: str, section: str = "", stop: bool = False) -> Spelling:
    return Spelling(CENTRIFUGAL, label, section, "", stop)


def _multi(label: str, section: str = "", stop: bool = False) -> Spelling:
    return Spelling(MULTISOURCE, label, section, "", stop)


# fixed values: what the sheets call their fields
SPELLINGS = (
    _api("PUMP ITEM NO'S", "tag"), _api("PUMP ITEM NOS", "tag"), _api("PUMP ITEM NO", "tag"), _api("ITEM NO.", "item"), _api("ITEM NO", "item"), _api("NO. OF PUMPS REQUIRED", "quantity"), _api("SERVICE", "service"),
    _api("MODEL", stop=True), _api("SIZE AND TYPE", "type"), _api("MANUFACTURER", stop=True), _api("SERIAL", stop=True),
    _api("CAPACITY @ PT", "capacity"), _api("SUCTION PRESSURE", "suction"), _api("DISCHARGE PRESSURE", "discharge"), _api("SPECIFIC GRAVITY", "gravity"), _api("VISCOSITY", "viscosity"),
    _api("PUMPING TEMPERATURE", "temperature"), _api("RANGE OF AMBIENT TEMPS", "ambient"), _api("RATED CAPACITY", "rated"), _api("OPERATING CONDITIONS", stop=True), _api("MATERIALS", stop=True),
    _api("MAXIMUM", part="max"), _api("MINIMUM", part="min"), _api("NORMAL", part="normal"), _api("MAX", part="max"), _api("MIN/MAX", part="range"), _api("MIN", part="min"),
    _api("LIQUID END", "material", "Liquid End"), _api("PROCESS DIAPHRAGM", "material", "Process Diaphragm"), _api("VALVE BODY", "material", "Valve Body"), _api("FRAME", "material", "Frame"), _api("SPECIAL MATERIAL", stop=True),
    _pump("ITEM NUMBER", "tag"), _pump("SERVICE", "service"), _pump("CASE", stop=True), _pump("FLUID TYPE", "fluid"), _pump("MODEL", stop=True), _pump("CURVE NO", stop=True), _pump("CORROSION", stop=True), _pump("STAGES", stop=True),
    _pump("SPECIFIC GRAVITY @ P&T", "gravity"), _pump("VISCOSITY @ P&T", "viscosity"), _pump("VISCOSITY", "viscosity"), _pump("SEAL FLUSH", stop=True), _pump("CAPACITY", "capacity"), _pump("FURNISHED BY", stop=True),
    _pump("SUCTION PRESSURE", "suction"), _pump("DISCH PRESSURE", "discharge"), _pump("DISCHARGE PRESSURE", "discharge"), _pump("NORM/MIN/MAX TEMP", "temperature"), _pump("MAX HEAD", stop=True), _pump("VAPOR PRESSURE", stop=True),
    _pump("PUMP TYPE", "type"), _pump("SKID", stop=True), _pump("DRIVER", stop=True), _pump("PIPE MATERIAL", "material"), _pump("NO. OF RINGS", stop=True), _pump("TYPE", stop=True),
    _multi("Tag No.:", "tag"), _multi("Tag No:", "tag"), _multi("Description:", "description"), _multi("Fluid Name / State:", "fluid"), _multi("Fluid Name/ State:", "fluid"), _multi("Quantity:", "quantity"), _multi("Service:", "service"), _multi("Type:", "type"),
    _multi("OPERATING DATA", stop=True), _multi("Operating Temperature", "temperature"), _multi("Operating Pressure", "operating"), _multi("Liquid Density", "density"), _multi("Liquid Viscosity", "viscosity"), _multi("DESIGN DATA", stop=True),
    _multi("Flow Rate", "capacity"), _multi("Design Pressure / PSV Set Pressure", "design_pressure"), _multi("Design Temperature", "design_temperature"), _multi("Vapour Pressure", stop=True), _multi("Suction / Discharge Pressure", "pressures"),
    _multi("ELECTRICAL DATA", stop=True), _multi("FLUID CHARACTERISTICS", stop=True), _multi("NOTES", stop=True), _multi("Material", "material"), _multi("Differential Pressure", stop=True),
)
# fixed values: parts of an API 675 sheet that the liquid touches
WETTED = ("Liquid End", "Process Diaphragm", "Valve Body")


def sheet_kind(page: Column) -> Column:
    """Which grammar a page's text follows, or null."""
    grouped = multisource_tag(page).isNotNull()
    return (
        F.when(page.rlike(r"(?i)data\s+sheet\s+centrifugal\s+pump"), CENTRIFUGAL)
        .when(grouped & page.rlike(r"(?i)\bGENERAL\s+DATA\b") & page.rlike(r"(?i)Fluid\s+Name\s*/\s*State"), MULTISOURCE)
        .when(page.rlike(r"(?i)\bAPI\s*675\b|CONTROLLED\s+VOLUME\s+PUMP"), API675)
    )


def multisource_tag(c: Column) -> Column:
    """``Z00-SYN-0000-P0 A/B`` from the ways to write a pair, or null."""
    tight = F.regexp_replace(F.upper(c), r"\s+", "")
    base = r"[A-Z][0-9]{2}-[A-Z]{1,4}-[0-9]{3,5}-P[0-9]+"
    found = F.regexp_extract(tight, rf"({base})A(?:/B|,\1B|,?B)", 1)
    return F.when(found != "", F.concat(found, F.lit(" A/B")))


def api_tag(c: Column) -> Column:
    """``P00000A/B`` from the ways to write a pair, or null."""
    tight = F.regexp_replace(F.upper(c), r"\s+", "")
    found = F.regexp_extract(tight, r"P([0-9]{4,8})A(?:/B|,P\1B|,?B)", 1)
    return F.when(found != "", F.concat(F.lit("P"), found, F.lit("A/B")))


def centrifugal_tag(c: Column) -> Column:
    """``0-P-000A/B/C`` from ``0-P-000ABC``, or null."""
    found = F.regexp_extract(F.upper(F.regexp_replace(c, r"\s+", "")), r"^([0-9]+-P-[0-9]+)([A-Z/,]*)", 1)
    units = F.regexp_extract_all(F.regexp_extract(F.upper(F.regexp_replace(c, r"\s+", "")), r"^[0-9]+-P-[0-9]+([A-Z/,]*)", 1), F.lit("([A-Z])"), 1)
    return F.when(found != "", F.concat(found, F.array_join(units, "/")))


def _spelled(label: str) -> str:
    body = r"\s+".join(re.escape(w) for w in label.split(" "))
    return (r"\b" if label[0].isalnum() else "") + body + (r"\b" if label[-1].isalnum() else "")


def _pattern(sheet: str) -> str:
    labels = sorted((s.label for s in SPELLINGS if s.sheet == sheet), key=len, reverse=True)  # the longest that fits
    return "(?i)(" + "|".join(map(_spelled, labels)) + ")"


def _plain_label(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", " "))


def cuts(pages: DataFrame, page: list[str]) -> DataFrame:
    """Pages (page columns, t, sheet) cut at the spellings of their sheet: a
    row for each, with the text up to the next."""
    by = lambda f: F.coalesce(*(F.when(F.col("sheet") == s, f(_pattern(s))) for s in (API675, CENTRIFUGAL, MULTISOURCE)))
    labels = by(lambda p: F.regexp_extract_all("t", F.lit(p), 1))
    values = by(lambda p: F.split("t", p, -1))
    after = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    rows = pages.where("sheet is not null").select(*page, "sheet", F.posexplode(F.arrays_zip(labels.alias("label"), after.alias("value"))).alias("pos", "c"))
    spelled = F.create_map(*(x for s in SPELLINGS for x in (F.lit(f"{s.sheet}:{s.label.lower()}"), F.struct(F.lit(s.section).alias("section"), F.lit(s.part).alias("part"), F.lit(s.stop).alias("stop")))))
    return rows.select(*page, "sheet", "pos", F.col("c.value").alias("value"), spelled[F.concat("sheet", F.lit(":"), _plain_label(F.col("c.label")))].alias("means"))


def slots(pages: DataFrame, page: list[str]) -> DataFrame:
    """(page columns, sheet, section, part, unit, value) of pages: the first
    value of each slot. A unit stands in parentheses behind the section, and
    holds for its parts."""
    order = Window.partitionBy(*page).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when((F.col("means.section") != "") | F.col("means.stop"), F.struct(F.col("means.section").alias("section"), "pos"))
    c = cuts(pages, page).withColumn("open", F.last(opened, ignorenulls=True).over(upto)).where("open.section <> '' and not means.stop")
    unit = F.nullif(F.trim(F.regexp_extract("value", r"^\s*\(([^)]*)\)", 1)), F.lit(""))
    rest = text.clean_value(F.regexp_replace("value", r"^\s*\([^)]*\)", ""))
    read = c.select(*page, "sheet", "open", "pos", "means.part", unit.alias("unit"), F.when(unit.isNotNull(), rest).otherwise(text.clean_value(F.col("value"))).alias("value"))
    section = Window.partitionBy(*page, "open").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    read = read.withColumn("unit", F.coalesce("unit", F.last("unit", ignorenulls=True).over(section))).where(~F.col("value").rlike("^-*$"))  # dashes fill an empty field
    return read.groupBy(*page, "sheet", F.col("open.section").alias("section"), "part").agg(F.min_by("unit", "pos").alias("unit"), F.min_by("value", "pos").alias("value"))


def _number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, NUMBER, 0), F.lit(""))


def _barg(c: Column) -> Column:
    u = F.upper(F.regexp_replace(c, r"\s", ""))
    return F.when(u.isin("BARG", "BAR"), "bar.g").otherwise(c)


def parameters(found: DataFrame, page: list[str]) -> DataFrame:
    """(page columns, sheet, name, value, unit, rank): what slots say about a
    card's fields; where several slots serve a field, the least rank counts."""
    s, p, v, u, sheet = (F.col(c) for c in ("section", "part", "value", "unit", "sheet"))
    api, pump, multi = sheet == API675, sheet == CENTRIFUGAL, sheet == MULTISOURCE
    one = lambda name, value, unit=F.lit(""), rank=0: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), F.coalesce(unit, F.lit("")).alias("unit"), F.lit(rank).alias("rank"))
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+[0-9]+$", ""))  # noqa: E731  (the number of the next row)
    cp = F.when(F.lower(u) == "cp", "cP").otherwise(u)
    before, after = (text.clean_value(F.get(F.split(v, "/", 2), k)) for k in (0, 1))
    inner = F.regexp_extract(v, r"\(([0-9]+)\)", 1)
    rules = F.array(
        # API 675
        F.when(api & (s == "tag"), one("tag_no", api_tag(v))),
        F.when(api & (s == "item"), one("item_no", F.upper(F.nullif(F.regexp_extract(v, r"(?i)^(PK[0-9]{4,})", 1), F.lit(""))))),
        F.when(api & (s == "quantity"), one("quantity", F.coalesce(F.nullif(inner, F.lit("")), _number(v), v))),
        F.when(api & (s == "service"), one("fluid_name", F.concat(F.lit("SERVICE "), v))),
        F.when(api & (s == "type"), one("pump_type", F.when(F.upper(v).contains("API 675"), v).otherwise(F.concat(v, F.lit(", API 675"))))),
        F.when(api & (s == "capacity") & (p == "normal"), one("process_capacity", _number(v), u)),
        F.when(api & (s == "capacity") & (p == "max"), one("process_capacity", _number(v), u, 1)),
        F.when(api & s.isin("suction", "discharge") & (p == "max"), one("pressure", _number(v), _barg(u))),
        F.when(api & (s == "gravity") & (p == "max"), one("density", F.concat(F.lit("SG="), v))),
        F.when(api & (s == "viscosity") & (p == ""), one("viscosity", F.nullif(F.regexp_extract(v, rf"(?:<\s*)?{NUMBER}(?:\s*@\s*{NUMBER}\s*°?\s*C)?", 0), F.lit("")), cp)),
        F.when(api & (s == "temperature") & (p == "normal"), one("fluid_temperature", v)),
        F.when(api & (s == "ambient") & (p == "range"), one("environment_temperature", F.nullif(F.regexp_replace(F.regexp_extract(v, rf"({NUMBER}\s*/\s*{NUMBER})", 1), r"\s*/\s*", "-"), F.lit("")), F.lit("℃"))),
        F.when(api & (s == "rated"), one("rated_capacity", _number(v), F.lit("l/hr"))),
        # centrifugal
        F.when(pump & (s == "tag"), one("tag_no", centrifugal_tag(v))),
        F.when(pump & (s == "service"), one("service_name", F.trim(F.regexp_replace(v, r"(?i)\s+\(NOTE[^)]*\)", "")))),
        F.when(pump & (s == "fluid"), one("fluid_name", F.trim(F.regexp_replace(v, r"(?i)\s+\(Note[^)]*\)", "")))),
        F.when(pump & (s == "gravity"), one("density", _number(v))),
        F.when(pump & (s == "viscosity"), one("viscosity", _number(F.regexp_replace(v, r"(?i)^.*?\b(?:cP|cSt)\b\s*:?", "")), F.when(v.rlike(r"(?i)\bcst\b"), "cST").when(v.rlike(r"(?i)\bcp\b"), "cP"))),
        F.when(pump & (s == "capacity"), one("process_capacity", F.nullif(F.regexp_extract(F.regexp_replace(v, r"(?i)^.*?m[³3]\s*/\s*hr?\b", ""), NUMBER, 0), F.lit("")), F.when(v.rlike(r"(?i)m[³3]\s*/\s*h"), "m3/hr"))),
        F.when(pump & s.isin("suction", "discharge"), one("pressure", _number(F.regexp_replace(v, r"(?i)^[ga]\b", "")), F.when(u.isNotNull(), F.concat(F.lit("("), F.regexp_replace(u, r"\s", ""), F.lit(")"), F.regexp_extract(F.lower(v), "^([ga])(?:[^a-z]|$)", 1))))),
        F.when(pump & (s == "temperature"), one("fluid_temperature", F.array_join(F.filter(F.transform(F.split(F.regexp_replace(v, r"(?i)\s*C\b", ""), "/"), text.clean_value), lambda x: x != ""), " / "), F.lit("℃"))),
        F.when(pump & (s == "type"), one("pump_type", F.concat(F.lit("Centrifugal Pump; "), v))),
        F.when(pump & (s == "material"), one("wetted_parts_material", F.concat(F.lit("Pipe Material: "), v))),
        # several sources
        F.when(multi & (s == "tag"), one("tag_no", multisource_tag(v))),
        F.when(multi & (s == "description"), one("description", clean(v))),
        F.when(multi & (s == "fluid"), one("fluid_name", clean(v))),
        F.when(multi & (s == "quantity"), one("quantity", _number(v))),
        F.when(multi & (s == "service"), one("service_name", clean(v))),
        F.when(multi & (s == "type"), one("pump_type", clean(v))),
        F.when(multi & (s == "temperature"), one("fluid_temperature", clean(v), F.lit("℃"))),
        F.when(multi & (s == "density"), one("density", clean(v), F.lit("kg/m3"))),
        F.when(multi & (s == "viscosity"), one("viscosity", clean(v), F.lit("cP"))),
        F.when(multi & (s == "capacity"), one("process_capacity", clean(v), F.lit("lit/hr"))),
        F.when(multi & (s == "design_temperature"), one("design_temperature", clean(v), F.lit("℃"))),
        F.when(multi & (s == "pressures"), one("suction_pressure", before, _barg(u))),
        F.when(multi & (s == "pressures"), one("discharge_pressure", clean(after), _barg(u))),
        F.when(multi & (s == "material"), one("wetted_parts_material", F.trim(F.regexp_replace(clean(v), "[^A-Za-z0-9/ ._-].*$", "")))),
    )
    each = found.select(*page, "sheet", "section", F.explode(F.array_compact(rules)).alias("r")).select(*page, "sheet", "section", "r.*")
    name = F.when(F.col("name") == "pressure", F.concat("section", F.lit("_pressure"))).otherwise(F.col("name"))
    return each.select(*page, "sheet", name.alias("name"), "value", "unit", "rank").where("value <> ''").groupBy(*page, "sheet", "name").agg(F.min(F.struct("rank", "value", "unit")).alias("b")).select(*page, "sheet", "name", "b.value", "b.unit", "b.rank")


def materials(found: DataFrame, page: list[str]) -> DataFrame:
    """(page columns, material): what an API 675 material page says about the wetted parts, in their order."""
    known = found.where((F.col("sheet") == API675) & (F.col("section") == "material") & F.col("part").isin(*WETTED))
    said = F.array_sort(F.collect_list(F.struct(F.array_position(F.lit(list(WETTED)), F.col("part")).alias("k"), F.concat("part", F.lit(": "), "value").alias("s"))))
    return known.groupBy(*page).agg(F.array_join(F.transform(said, lambda x: x["s"]), "; ").alias("material"))


def cards(lines: DataFrame) -> DataFrame:
    """(file, page, tag, name, value, unit, note) from lines (file, page, line,
    text): the candidates of every data sheet page with a tag. An API 675 page
    takes its materials from the page with its item number, else from the next
    page of its file; ``note`` tells what a reviewer has to look at."""
    page = ["file", "page"]
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    about_materials = F.col("t").rlike(r"(?i)\bMATERIALS\b") & ~F.col("t").rlike(r"(?i)\bOPERATING\s+CONDITIONS\b")
    whole = lines.groupBy(*page).agg(t.alias("t")).withColumn("sheet", sheet_kind(F.col("t"))).where("sheet is not null")
    found = written(slots(whole, page), "slots")
    kinds = written(whole.select(*page, "sheet", about_materials.alias("about_materials")), "kinds")
    told = parameters(found, page)
    joined = F.nullif(F.array_join(F.array_compact(F.array(F.max(F.when(F.col("name") == "service_name", F.col("value"))), F.max(F.when(F.col("name") == "pump_type", F.col("value"))))), "; "), F.lit(""))
    multi = told.where(F.col("sheet") == MULTISOURCE)
    both = multi.groupBy(*page).agg(F.coalesce(joined, F.max(F.when(F.col("name") == "description", F.col("value")))).alias("value")).where("value is not null")
    told = told.where((F.col("sheet") != MULTISOURCE) | ~F.col("name").isin("service_name", "pump_type", "description")).unionByName(both.select(*page, F.lit(MULTISOURCE).alias("sheet"), F.lit("pump_type").alias("name"), "value", F.lit("").alias("unit"), F.lit(0).alias("rank")))
    told = written(told, "told")
    tags = told.where("name = 'tag_no'").select(*page, F.col("value").alias("tag"))
    items = told.where("name = 'item_no'").select(*page, F.col("value").alias("item"))
    rows = tags.join(told.where("name <> 'item_no'"), page)
    normal = F.when((F.col("sheet") == API675) & (F.col("name") == "process_capacity") & (F.col("rank") > 0), "api675_normal_capacity_missing")
    out = rows.select(*page, "tag", "name", "value", "unit", normal.alias("note"))
    stuff = materials(found, page).join(kinds.where("about_materials").select(*page), page).join(items, page, "left")
    stuff = stuff.withColumn("item", F.coalesce("item", F.concat(F.lit("?"), F.col("file").cast("string"), F.lit(":"), F.col("page").cast("string"))))  # no item of its own: found by its place alone
    asking = tags.join(kinds.where(F.col("sheet") == API675).select(*page), page).join(items, page, "left")
    met = keyed_or_next(asking, stuff, "item", "file", "page", "material")
    missing = F.when(F.col("material").isNull(), "api675_material_page_not_matched")
    more = met.select(*page, "tag", F.lit("wetted_parts_material").alias("name"), F.coalesce("material", F.lit("")).alias("value"), F.lit("").alias("unit"), missing.alias("note"))
    return out.unionByName(more)
