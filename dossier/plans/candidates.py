"""Candidate parameters from the driver tables, for the card queries.

Parts play equipment: the tag is ``P-<partkey>``, every order line is a source
row with a density, a capacity and a suction pressure in rotating units.
:func:`dealt` gives the same rows by card: order lines are moved, not the three
candidates that each becomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards
from ..runtime import table, written

FLOW_UNITS = ("m3/h", "L/min", "L/h", "gpm")
PRESSURE_UNITS = ("bar abs", "bar g", "kPa", "MPa", "kg/cm2 g", "psi")
#: the lines of a card that go to one task; of cards with more, equal candidates are counted before they are moved
HOT = 1_000_000


def _rotate(names: tuple[str, ...]):
    return F.element_at(F.array(*map(F.lit, names)), F.col("l_linenumber") % len(names) + 1)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")


def _line_tag() -> Column:
    return F.concat(F.lit("P-"), F.col("l_partkey").cast("string"))


def _line_row() -> Column:
    return F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))


def _of_line() -> Column:
    """The candidates of an order line."""
    told = (
        ("density", (F.col("l_partkey") % 3 + 980).cast("string"), F.lit("kg/m3")),
        ("process_capacity", F.col("l_quantity").cast("long").cast("string"), _rotate(FLOW_UNITS)),
        ("suction_pressure", F.round(F.col("l_discount") * 100).cast("long").cast("string"), _rotate(PRESSURE_UNITS)),
    )
    return F.array(
        *(
            F.struct(
                _line_tag().alias("tag"),
                F.lit(name).alias("name"),
                value.alias("value"),
                unit.alias("unit"),
                ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10 + F.lit(k)).alias("ord"),
                _line_row().alias("source_row"),
                F.when(F.col("l_tax") < 0.07, _line_row()).alias("ref"),
                (F.col("l_tax") < 0.05).alias("verified"),
                (F.lit(1.0) - F.col("l_tax")).alias("confidence"),
            )
            for k, (name, value, unit) in enumerate(told)
        )
    )


def line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(F.explode(_of_line()).alias("p")).select("p.*")


def part_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    row = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    return parts.select(
        F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("tag"),
        F.lit("pump_type").alias("name"),
        F.col("p_type").alias("value"),
        F.lit("").alias("unit"),
        F.col("p_partkey").alias("ord"),
        row.alias("source_row"),
        row.alias("ref"),
        F.lit(True).alias("verified"),
        F.lit(0.98).cast("double").alias("confidence"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_candidates(spark, sf_dir).unionByName(part_candidates(spark, sf_dir))


def dealt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame | None]:
    """:func:`candidates` with their card, by card, so that what is grouped by
    card is moved no further; and, not dealt, those of cards with over ``HOT``
    lines, if there are any."""
    lines = _lines(spark, sf_dir)
    hot = written(lines.where("l_partkey is not null").groupBy("l_partkey").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("l_partkey"), "hot")
    apart = None
    if not hot.isEmpty():
        apart = cards.card_key(lines.join(hot, "l_partkey", "left_semi").select(F.explode(_of_line()).alias("p")).select("p.*"))
        lines = lines.join(hot, "l_partkey", "left_anti")
    lines = cards.card_key(lines.withColumns({"tag": _line_tag(), "source_row": _line_row()})).drop("tag", "source_row")
    parts = part_candidates(spark, sf_dir)
    parts = cards.card_key(parts).select("card", F.array(F.struct(*parts.columns)).alias("part"))
    both = lines.unionByName(parts, allowMissingColumns=True).repartition("card")
    return both.select("card", F.explode(F.when(F.col("part").isNotNull(), F.col("part")).otherwise(_of_line())).alias("p")).select("p.*", "card"), apart
