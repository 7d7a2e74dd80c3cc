"""Candidates from located text: labelled fields, summary tables, data sheets.

Field patterns are rows of a small table; each becomes one ``regexp_extract``
in one projection, so a text is read once and nothing is shuffled. Blocks
without a tag inherit the tags of their document by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text

_NUM = r"[-+]?[0-9]+(?:\.[0-9]+)?(?:\s*(?:[-–—]|to)\s*[-+]?[0-9]+(?:\.[0-9]+)?)?"
#: labels that end a text field
STOPS = ("tag no", "item", "density", "viscosity", "temperature", "capacity", "flow", "pressure", "material", "service", "quantity", "operating", "spare", "npsha", "driver", "type")

#: (name, label, unit pattern): a number or range with its unit
NUMERIC = (
    ("density", r"density", r"kg/m(?:3|³)"),
    ("viscosity", r"viscosity", r"cP|mPa[·.]s|cSt"),
    ("fluid_temperature", r"(?:pumping|fluid|operating) temperature", r"°?\s?C"),
    ("environment_temperature", r"(?:ambient|environment) temperature", r"°?\s?C"),
    ("process_capacity", r"(?:process|normal|required) (?:capacity|flow)", r"m(?:3|³)/h|L/h|L/min"),
    ("rated_capacity", r"(?:rated|design) (?:capacity|flow)", r"m(?:3|³)/h|L/h|L/min"),
    ("suction_pressure", r"(?:suction|inlet) pressure", r"(?:bar|MPa|kPa)(?:[ .]?\(?(?:abs|absolute|gauge|g|a)\)?(?![A-Za-z]))?"),
    ("discharge_pressure", r"(?:discharge|outlet) pressure", r"(?:bar|MPa|kPa)(?:[ .]?\(?(?:abs|absolute|gauge|g|a)\)?(?![A-Za-z]))?"),
)
#: (name, label): words up to the next label
TEXTUAL = (("fluid_name", r"fluid(?: name)?|liquid"), ("material", r"(?:wetted (?:parts )?)?material"), ("service_name", r"service|duty"))
#: (name, pattern with one group)
SINGLE = (
    ("quantity", r"(?i)(?:quantity|number required)\s*[:=]?\s*([0-9]+)"),
    ("operating", r"(?i)operating\s*[:=]\s*([0-9]+)"),
    ("spare", r"(?i)spare\s*[:=]\s*([0-9]+)"),
    ("npsha", r"(?i)(?:npsha|available npsh)\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?\s*(?:m|ft))"),
    ("design_standard", r"(API\s?67[45])"),
)
_PUMP = r"((?:[A-Za-z-]+ ){0,2}(?:metering|diaphragm|plunger|centrifugal|reciprocating|screw|gear) pumps?)"


def _field(name: str, value: Column, unit: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), text.clean_value(value).alias("value"), F.trim(unit).alias("unit"))


def fields(c: Column) -> Column:
    """Array of (name, value, unit) found in a text, the first of each name."""
    none = F.lit("")
    stop = "|".join(STOPS)
    found = []
    for name, label, unit in NUMERIC:
        p = rf"(?i)(?:{label})\s*[:=]?\s*({_NUM})\s*({unit})"
        found.append(_field(name, F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2)))
    for name, label in TEXTUAL:
        found.append(_field(name, F.regexp_extract(c, rf"(?is)(?:^|[^A-Za-z])(?:{label})\s*[:=]\s*(.{{1,120}}?)(?=\s+(?:{stop})(?:[^A-Za-z]|$)|[;\n]|$)", 1), none))
    found += [_field(name, F.regexp_extract(c, p, 1), none) for name, p in SINGLE]
    phrases = F.regexp_extract_all(c, F.lit(f"(?i){_PUMP}"), 1)
    longest = F.reduce(phrases, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    found.append(_field("pump_type", longest, none))
    return F.filter(F.array(*found), lambda f: f["value"] != "")


def candidates(blocks: DataFrame, document: str = "document_id", order: str = "text_order", body: str = "original_text", confidence: str = "confidence") -> tuple[DataFrame, DataFrame]:
    """Candidates of all blocks, and issues.

    A block's own tags get its fields; a block without tags gives its fields to
    all tags of its document; a document with fields but no tag is untagged."""
    b = blocks.select(document, order, "block_id", F.col(body).alias("_t"), F.col(confidence).alias("confidence")).withColumn("tags", text.tags(F.col("_t"))).withColumn("fields", fields(F.col("_t")))
    useful = b.where((F.size("fields") > 0) | (F.size("tags") > 0))
    of_doc = useful.groupBy(document).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("doc_tags"))
    joined = useful.where(F.size("fields") > 0).join(of_doc, document)
    tags = F.when(F.size("tags") > 0, F.col("tags")).when(F.size("doc_tags") > 0, F.col("doc_tags")).otherwise(F.array(F.lit("")))
    rows = joined.select(document, order, "block_id", "confidence", "_t", F.size("tags").alias("n_tags"), F.posexplode(tags).alias("tag_at", "tag"), "fields")
    flat = rows.select("*", F.posexplode("fields").alias("at", "f"))
    out = flat.select(
        document,
        F.nullif("tag", F.lit("")).alias("tag"),
        "f.name",
        "f.value",
        "f.unit",
        F.concat_ws("|", F.col(document), F.lpad(F.col(order).cast("string"), 9, "0"), F.lpad("tag_at", 4, "0"), F.lpad("at", 3, "0")).alias("ord"),
        F.col(document).alias("source_row"),
        ids.keyed("direct_raw_", 14, F.col(document), F.col("block_id"), F.col("f.name"), F.col("f.value")).alias("ref"),
        text.value_in_text(F.col("f.value"), F.col("_t")).alias("verified"),
        "confidence",
    )
    shared = rows.where("n_tags > 1").select(document, "block_id", F.lit("shared_multi_tag_parameters_require_confirmation").alias("code")).distinct()
    untagged = rows.where("tag = ''").select(document, F.lit(None).cast("string").alias("block_id"), F.lit("untagged_pump_requires_confirmation").alias("code")).distinct()
    return out, shared.unionByName(untagged)


# classes of a summary header; the first that fits wins
HEADER = (
    ("tag", r"tag|item no|equipment no"),
    ("description", r"description|service|duty"),
    ("installation", r"installation|location|indoor|outdoor"),
    ("type", r"type"),
    ("quantity", r"qty|quantity|number"),
    ("capacity", r"capacity|flow"),
    ("pressure", r"pressure|head"),
    ("material", r"material"),
)
REQUIRED = ("type", "capacity", "pressure", "material")


def header_class(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(HEADER):
        out = F.when(F.lower(c).rlike(p), name).otherwise(out)
    return out


def summary_layout(cells: DataFrame, table: list[str], deepest: int = 5) -> DataFrame:
    """Header depth and column classes of tables that sum up equipment: the
    least depth of 1 to ``deepest`` at which all required classes and a
    description or quantity are there. Rows: (table…, depth, col, class)."""
    top = cells.where(F.col("row") <= deepest)
    depths = top.select(*table, "col", "row", "text").join(F.broadcast(cells.sparkSession.range(1, deepest + 1).select(F.col("id").cast("int").alias("depth"))), F.col("row") <= F.col("depth"))
    heads = depths.groupBy(*table, "depth", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), " ").alias("head"))
    classed = heads.withColumn("class", header_class(F.col("head"))).where("class is not null")
    has = lambda *names: F.max(F.col("class").isin(*names))
    fit = classed.groupBy(*table, "depth").agg(*(has(n).alias(n) for n in REQUIRED), has("description", "quantity").alias("about"))
    good = fit.where(" and ".join((*REQUIRED, "about"))).groupBy(*table).agg(F.min("depth").alias("depth"))
    return classed.join(good, [*table, "depth"])


def summary_rows(cells: DataFrame, layout: DataFrame, table: list[str], least: int = 4, rows: int = 2) -> DataFrame:
    """Data cells by class, of rows with ``least`` classes, in tables with ``rows`` such rows."""
    data = cells.join(layout.select(*table, "depth", "col", "class"), [*table, "col"]).where(F.col("row") > F.col("depth"))
    first = data.groupBy(*table, "row", "class").agg(F.min_by("text", "col").alias("text"))
    full = first.groupBy(*table, "row").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    enough = full.groupBy(*table).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= rows)
    return first.join(full.drop("n"), [*table, "row"]).join(enough.drop("n_rows"), table, "left_semi")


def pair_tag(c: Column) -> Column:
    """Spellings of a pair of pumps to one tag: ``P-1001 A/B``, ``P-1001A, B``, ``P1001A & P1001B``."""
    u = F.upper(text.fold_ascii_space(c))
    p = r"(P-?)\s?([0-9]{3,8})\s?([A-D])\s?(?:/|,|&|AND)\s?(?:P-?\s?[0-9]{3,8}\s?)?([A-D])(?![A-Z0-9])"
    head = F.regexp_extract(u, p, 2)
    return F.when(head != "", F.concat(F.lit("P-"), head, F.regexp_extract(u, p, 3), F.lit("/"), F.regexp_extract(u, p, 4)))


def group_tag(c: Column) -> Column:
    """``0-P-000ABC`` stands for ``0-P-000A/B/C``."""
    u = F.upper(F.trim(c))
    p = r"^([0-9]+-P-[0-9]+)([A-Z]{1,4})$"
    suffix = F.regexp_extract(u, p, 2)
    return F.when(suffix != "", F.concat(F.regexp_extract(u, p, 1), F.array_join(F.filter(F.split(suffix, ""), lambda x: x != ""), "/"))).otherwise(u)


def is_datasheet(file_name: Column, c: Column) -> Column:
    """A data sheet by title, and not a list of vendors."""
    head = F.lower(F.concat_ws(" ", file_name, F.substring(c, 1, 500)))
    return F.lower(c).rlike(r"data ?sheet|api 67[45]") & ~head.rlike(r"vendor list|list of vendors")


MATERIAL_ROWS = ("casing", "plunger", "packing", "diaphragm", "liquid end", "valve body", "valve seat", "valve", "gasket", "contour plate", "shaft", "impeller", "sleeve", "bolts")


def materials(c: Column) -> Column:
    """Map of material row labels to what stands after them, up to the next label."""
    stop = "|".join(sorted(MATERIAL_ROWS, key=len, reverse=True))
    one = lambda name: F.struct(F.lit(name).alias("k"), text.clean_value(F.regexp_extract(c, rf"(?is)(?:^|[\n|;])\s*{name}\s*[:|=]\s*(.{{1,80}}?)(?=[\n|;]|\s(?:{stop})\s*[:|=]|$)", 1)).alias("v"))
    return F.map_from_entries(F.filter(F.array(*map(one, MATERIAL_ROWS)), lambda e: e["v"] != ""))


def first_branch(branches: list[DataFrame]) -> DataFrame:
    """The first branch with rows wins for the whole package; results are never mixed."""
    for b in branches[:-1]:
        if not b.isEmpty():
            return b
    return branches[-1]


def last_wins(cells: DataFrame, table: list[str], order: str) -> DataFrame:
    """One cell per place: the last by ``order``."""
    w = Window.partitionBy(*table, "row", "col").orderBy(F.desc(order))
    return cells.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
