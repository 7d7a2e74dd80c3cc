"""Candidates to cards.

Candidates are long rows (tag, name, value, unit, ord, ref, verified). They are
normalised by field, grouped by tag without case and by value, and every card
gets every field: missing ones too, conflicting ones with all their values.
The first candidate by ``ord`` represents its group; nothing depends on the
order in which rows arrive. Equal candidates of a tag are counted first, by
partial aggregations over numbers, so that a hot tag costs one row a task and
value; what is left is dealt by card once, and values and fields follow there
without a further shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims, ids, text, units
from ..runtime import written
from .order import rank_by_range

UNTAGGED = "无位号泵"


def repeated(candidates: DataFrame) -> DataFrame:
    """Equal candidates of a tag as one row: the first ``ord``, ``n_sources``,
    and of the rest what :func:`values` asks of all of them. Only numbers are
    aggregated, which needs no sort."""
    return candidates.groupBy("card", "tag", "name", "value", "unit").agg(
        F.min("ord").alias("ord"),
        F.count("*").alias("n_sources"),
        F.min("confidence").alias("confidence"),
        F.max(F.col("ref").isNotNull()).alias("has_ref"),
        F.min(F.coalesce("verified", F.lit(False))).alias("verified"),
    )


def normalised(candidates: DataFrame, numbers_of: DataFrame | None = None) -> DataFrame:
    """Adds field, norm_value, norm_unit and note.

    Numbers with units repeat a lot: each distinct (kind, value, unit) is
    converted once, written, and joined back; Spark broadcasts the table where
    its size is small enough, and then the candidates are not shuffled.
    ``numbers_of`` are rows with the same names, values and units that are
    cheaper to read."""
    name = F.col("name")
    field = F.when(name == "material", "wetted_parts_material").when(name.isin(*dims.CARD_FIELDS), name).otherwise("others")
    kind = F.when(F.col("field").isin(*dims.FLOW_FIELDS), "flow").when(F.col("field").isin(*dims.PRESSURE_FIELDS), "pressure")
    clean = lambda d: d.withColumn("field", field).withColumn("_kind", kind).withColumn("_unit", F.trim(F.coalesce("unit", F.lit("")))).withColumn("_clean", text.clean_value(F.col("value"))).where("_clean <> ''")
    # the raw texts first: what repeats is cleaned once
    few = (candidates if numbers_of is None else numbers_of).select("name", "value", "unit").distinct()
    numbers = clean(few).where(F.col("_kind").isNotNull()).select("_kind", "value", "_unit").distinct()
    flow = numbers.where("_kind = 'flow'").withColumn("n", units.normalize_flow(F.col("value"), F.col("_unit")))
    pressure = numbers.where("_kind = 'pressure'").withColumn("n", units.normalize_pressure(F.col("value"), F.col("_unit")))
    done = flow.unionByName(pressure).select("_kind", "value", "_unit", "n.value", "n.unit", "n.note_en").toDF("_kind", "value", "_unit", "_v", "_u", "_n")
    out = clean(candidates).join(written(done, "numbers"), ["_kind", "value", "_unit"], "left")
    return out.select(*candidates.columns, "field", F.coalesce("_v", "_clean").alias("norm_value"), F.coalesce("_u", "_unit").alias("norm_unit"), F.coalesce("_n", F.lit("")).alias("note"))


def card_key(candidates: DataFrame) -> DataFrame:
    """Adds ``card``: the tag without case; an untagged source row is a card of its own."""
    tagged = F.trim(F.coalesce("tag", F.lit("")))
    return candidates.withColumn("card", F.when(tagged != "", F.lower(tagged)).otherwise(F.concat(F.lit(UNTAGGED + "-"), F.col("source_row").cast("string"))))


def values(normal: DataFrame, dealt: bool = False) -> DataFrame:
    """One row per card, field and distinct value, of the first candidate, from
    normalised candidates or normalised :func:`repeated` ones, which are dealt
    by card here unless they already are."""
    other = F.when(F.col("field") == "others", F.col("name")).otherwise("")
    if "n_sources" in normal.columns:
        rows, n, has_ref = normal if dealt else normal.repartition("card"), F.sum("n_sources"), F.col("has_ref")
    else:
        rows, n, has_ref = normal, F.count("*"), F.col("ref").isNotNull()
    g = rows.withColumn("other_name", other).groupBy("card", "field", F.lower("norm_value").alias("value_key"), F.lower("norm_unit").alias("unit_key"), "other_name")
    return g.agg(
        F.min("ord").alias("first_ord"),
        F.min_by("tag", "ord").alias("tag"),
        F.min_by("norm_value", "ord").alias("value"),
        F.min_by("norm_unit", "ord").alias("unit"),
        F.min_by("note", "ord").alias("note"),
        n.alias("n_sources"),
        F.coalesce(F.min("confidence"), F.lit(0.0)).alias("confidence"),
        F.max(has_ref).alias("has_ref"),
        F.min(F.coalesce("verified", F.lit(False))).alias("verified"),
        F.max(F.col("note") == units.REVIEW[1]).alias("review"),
    )


#: what a field's row carries of each of its values
GIVEN = ("value", "unit", "n_sources", "has_ref", "verified", "confidence")


def fields(vals: DataFrame, keep: bool = False) -> DataFrame:
    """One row per card and field, missing fields included: status, display,
    n_values, whether a value was not converted (``review``); with ``keep`` also
    ``given``, its values. Nothing is joined: a card's row holds what each field
    says, and the 13 fields are looked up there."""
    shown = F.when(F.col("other_name") != "", F.concat_ws("", "other_name", F.lit(": "), "value", F.lit(" "), "unit")).otherwise(F.concat_ws(" ", "value", F.nullif("unit", F.lit(""))))
    each = F.struct("first_ord", F.trim(shown).alias("shown"), *(GIVEN if keep else ()))
    per = vals.groupBy("card", "field").agg(
        F.min("first_ord").alias("ord"),
        F.min_by("tag", "first_ord").alias("tag"),
        F.array_sort(F.collect_list(each)).alias("given"),
        F.max(~F.col("verified") & ~F.col("has_ref")).alias("low"),
        F.max("review").alias("review"),
    )
    said = per.groupBy("card").agg(F.min_by("tag", "ord").alias("tag"), F.collect_list(F.struct("field", "given", "low", "review")).alias("said"))
    dim = F.array(*(F.struct(F.lit(i).alias("field_ord"), F.lit(f).alias("field")) for i, f in enumerate(dims.CARD_FIELDS)))
    every = said.select("card", "tag", "said", F.explode(dim).alias("d"))  # 13 rows a card
    full = every.select("card", "tag", "d.*", F.get(F.filter("said", lambda x: x["field"] == F.col("d.field")), F.lit(0)).alias("p"))
    own = F.col("field") == "tag_no"
    n = F.coalesce(F.size("p.given"), F.when(own & (F.trim(F.coalesce("tag", F.lit(""))) != ""), 1).otherwise(0))
    display = F.array_join(F.transform("p.given", lambda x: x["shown"]), "；")
    status = F.when(n == 0, dims.MISSING).when((n > 1) & (F.col("field") != "others"), dims.CONFLICT).when(F.col("p.low"), dims.LOW_CONFIDENCE).otherwise(dims.EXTRACTED)
    given = [F.transform("p.given", lambda x: F.struct(*(x[c].alias(c) for c in GIVEN))).alias("given")] if keep else []
    return full.select("card", "tag", "field_ord", "field", n.cast("long").alias("n_values"), F.coalesce(display, F.when(own, F.col("tag")), F.lit("")).alias("display"), status.alias("status"), F.coalesce("p.review", F.lit(False)).alias("review"), *given)


def overview(card_fields: DataFrame) -> DataFrame:
    """One row per card: its fields side by side and counts of their states."""
    return card_fields.groupBy("card").agg(
        F.first("tag").alias("tag"),
        *(F.max(F.when(F.col("field") == f, F.col("display"))).alias(f) for f in dims.CARD_FIELDS if f != "tag_no"),
        F.count(F.when(F.col("status") == dims.CONFLICT, 1)).alias("n_conflict"),
        F.count(F.when(F.col("status") == dims.MISSING, 1)).alias("n_missing"),
        F.count(F.when(F.col("status") == dims.LOW_CONFIDENCE, 1)).alias("n_low"),
    )


def issues(card_fields: DataFrame, candidates: DataFrame) -> DataFrame:
    """Findings for review: missing, conflicting and weak fields; merged tags;
    values that could not be converted. ``candidates`` (card, source_row) tell
    which tags stand on several source rows: those whose rows' hashes, two of
    64 bits, are not all the same."""
    code = F.when(F.col("status") == dims.MISSING, "source_field_missing").when(F.col("status") == dims.CONFLICT, "field_value_conflict").when(F.col("status") == dims.LOW_CONFIDENCE, "source_evidence_low_confidence")
    severity = F.when(F.col("status") == dims.CONFLICT, "high_risk").otherwise("warning")
    finding = lambda code, severity: F.struct(code.alias("code"), severity.alias("severity"))
    both = F.array_compact(F.array(F.when(code.isNotNull(), finding(code, severity)), F.when(F.col("review"), finding(F.lit("pressure_value_or_unit_unrecognized"), F.lit("high_risk")))))
    state = card_fields.select("card", F.col("field").alias("field_name"), F.explode(both).alias("x")).select("card", "field_name", "x.*")
    hashed = [F.xxhash64("source_row"), F.xxhash64("source_row", F.lit(1))]
    rows = candidates.where("source_row is not null").groupBy("card").agg(*(f(h).alias(f"{n}{k}") for k, h in enumerate(hashed) for n, f in (("low", F.min), ("high", F.max))))
    merged = rows.where("low0 <> high0 or low1 <> high1").select("card", F.lit("tag_no").alias("field_name"), F.lit("duplicate_tag_merged").alias("code"), F.lit("information").alias("severity"))
    return state.unionByName(merged).withColumn("issue_id", ids.keyed("issue_", 12, F.col("code"), F.col("card"), F.col("field_name")))


def statistics(card_fields: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counters."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    a = card_fields.agg(F.countDistinct("card").alias("n_cards"), F.countDistinct(F.when(F.col("card").startswith(UNTAGGED), F.col("card"))).alias("n_untagged"), count(dims.CONFLICT).alias("n_conflicts"), count(dims.MISSING).alias("n_missing"), count(dims.LOW_CONFIDENCE).alias("n_low"), F.coalesce(F.sum("n_values"), F.lit(0)).alias("n_values"))
    b = found.agg(F.count("*").alias("n_issues"), F.count(F.when(F.col("code") == "duplicate_tag_merged", 1)).alias("n_merged"))
    return a.crossJoin(b)  # one row each


def duplicate_tags(candidates: DataFrame) -> DataFrame:
    """Tags that stand on several source rows, with how many."""
    return candidates.groupBy(F.lower(F.trim("tag")).alias("card")).agg(F.countDistinct("source_row").alias("n_rows"), F.count("*").alias("n_candidates")).where("n_rows > 1")


def in_natural_order(cards: DataFrame) -> DataFrame:
    """Tagged first, then digits by value; ``place`` from 1. Ranks by range
    partitions and their counts, so no task holds the whole table."""
    keyed = cards.withColumn("untagged", F.col("card").startswith(UNTAGGED).cast("int")).withColumn("key", text.natural_key(F.col("card")))
    return rank_by_range(keyed, ["untagged", "key", "card"], "place")
