"""Flat review tables: parameters, sources, issues, overview, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text

# fixed values: the actions a reviewer may choose
REVIEW_ACTIONS = ("confirm", "correct", "reject", "ask_supplier", "defer")


def review_reasons(confidence: Column, has_source: Column, status: Column, pending: str, least: float = 0.6) -> Column:
    """Reasons for a review, joined; empty if there are none."""
    reasons = F.array(F.when(confidence < least, "low_confidence"), F.when(~has_source, "no_source"), F.when(status == pending, "pending"))
    return F.array_join(F.array_compact(reasons), ";")


def parameters(card_fields: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """A row for each value of a card's field, or one empty row for a field
    without values, with what a reviewer has to look at in ``issue``. The values
    are those that the fields carry (``given``), or a table of their own, met in
    one equi-join on card and field; the tag itself needs no value."""
    own = F.col("field") == "tag_no"
    if values is None:
        rows = card_fields.select("card", "tag", "field", "status", F.explode_outer("given").alias("g")).select("card", "tag", "field", "status", "g.*", F.when(F.col("g").isNotNull(), True).alias("given"))
    else:
        v = values.select("card", "field", "value", "unit", "n_sources", "has_ref", "verified", "confidence", F.lit(True).alias("given"))
        rows = card_fields.select("card", "tag", "field", "status").join(v, ["card", "field"], "left")
    issue = F.when(F.col("given").isNull() & ~own, "f_field_without_values").when(~F.col("has_ref"), "f_parameter_without_source")
    return rows.select(
        "card", "tag", "field", "status",
        F.coalesce("value", F.when(own, F.col("tag")), F.lit("")).alias("value"),
        F.coalesce("unit", F.lit("")).alias("unit"),
        F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"),
        F.when(F.col("verified"), "yes").when(~F.col("verified"), "no").otherwise("").alias("evidence_verified"),
        "confidence",
        issue.alias("issue"),
    )


def issue_rows(found: DataFrame, params: DataFrame) -> DataFrame:
    """The cards' findings and those of the parameter rows, each with the action that a reviewer begins with."""
    derived = params.where("issue is not null").select("card", F.col("field").alias("field_name"), F.col("issue").alias("code"), F.lit("warning").alias("severity")).distinct()
    derived = derived.withColumn("issue_id", ids.keyed("f_", 12, F.col("code"), F.col("card"), F.col("field_name")))
    return found.unionByName(derived).withColumn("review_action", F.lit(REVIEW_ACTIONS[0]))


def cell_text(c: Column, kind: str = "string") -> Column:
    """What a workbook cell shows: nested values as JSON, null as empty."""
    return F.coalesce(F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string"), F.lit(""))


def column_widths(df: DataFrame, least: int = 11, most: int = 48) -> DataFrame:
    """(column, width): the longest content and two, within bounds."""
    longest = df.agg(*(F.max(F.length(F.col(c).cast("string"))).alias(c) for c in df.columns))
    rows = longest.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(len(c))).alias("n")) for c in df.columns))).alias("x"))
    return rows.select("x.column", F.least(F.greatest(F.col("x.n") + 2, F.lit(least)), F.lit(most)).alias("width"))


def grouped_report(df: DataFrame, first: str, second: str, order: Sequence[str], line: Column) -> DataFrame:
    """Report text of each ``first``: its ``second`` groups in order with their lines."""
    part = df.select(first, second, *order, line.alias("_line")).groupBy(first, second).agg(F.array_sort(F.collect_list(F.struct(*order, "_line"))).alias("l"))
    body = F.concat(F.lit("["), F.col(second).cast("string"), F.lit("] "), F.array_join(F.transform("l", lambda x: x["_line"]), " | "))
    return part.groupBy(first).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(second, body.alias("b")))), lambda x: x["b"]), "\n").alias("report"))


def overview(metrics: dict[str, DataFrame]) -> DataFrame:
    """Key and value rows of one-row, one-column frames."""
    out = None
    for name, df in metrics.items():
        row = df.select(F.lit(name).alias("metric"), F.col(df.columns[0]).cast("string").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def table_location(location: str) -> Column:
    """Where in a table a source stands: the parts of the struct column that are given, by slashes."""
    part = lambda c: F.nullif(F.trim(F.col(f"{location}.{c}").cast("string")), F.lit(""))
    return F.array_join(F.array_compact(F.array(F.concat(F.lit("table "), part("table_index")), part("row_label"), part("column_label"), part("cell"))), " / ")


def source_rows(refs: DataFrame, supporting: DataFrame, on: Sequence[str], most_chars: int = 700) -> DataFrame:
    """A row for each reference and source that supports it, with the columns
    that a reviewer fills in. A source says for itself how sure it is and
    whether it was verified, or its reference does. Texts are cut to what a
    cell shows."""
    own = refs.select(*on, F.col("source_short"), F.col("confidence").alias("_confidence"), F.col("verified").alias("_verified"))
    shown = lambda c: text.truncated(F.trim(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))), most_chars)
    texts = {"original": shown("original"), "translated": shown("translated"), "table_location": table_location("location"), "page": F.coalesce(F.col("location.page").cast("string"), F.lit(""))}
    # the texts are cut before they travel
    rows = supporting.withColumns(texts).drop("location").join(own, list(on)).withColumn("confidence", F.coalesce("confidence", "_confidence"))
    yes = F.coalesce("verified", "_verified", F.lit(False))
    return rows.withColumn("evidence_verified", F.when(yes, "yes").otherwise("no")).withColumns({"confirmed_source": F.lit(""), "remark": F.lit("")}).drop("_confidence", "_verified", "verified")
