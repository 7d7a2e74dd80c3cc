"""Numbers with units: exact decimals inside, strings outside.

Absolute pressure never becomes gauge pressure; a pressure without a basis is
scaled to MPa and noted. A range gives two numbers joined by ``-``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NUMBER

DECIMAL = "decimal(38,10)"
# fixed values: what a reviewer is told
REVIEW = ("无法可靠换算，待复核", "conversion requires review")
ABSOLUTE = ("绝压，待确认表压", "absolute; gauge pressure to be confirmed")
NO_BASIS = ("压力基准未说明，待确认", "pressure reference not stated; confirmation required")
NOTHING = ("", "")
# fixed values: unit spellings without case and blanks -> factor to L/h
FLOW = {"1000": ("m3/h", "m3/hr", "m3h"), "60": ("l/min", "lpm"), "1": ("l/h", "l/hr", "lph")}
# fixed values: unit spellings without case, blanks, dots, dashes -> factor, unit, note, whether cut to two places
PRESSURE = (
    (("barabs", "bara", "bar(a)", "barabsolute"), "0.1", "MPa", ABSOLUTE, False),
    (("mpaa", "mpa(a)", "mpaabs", "mpaabsolute"), "1", "MPa", ABSOLUTE, False),
    (("barg", "bar(g)", "bargauge"), "1", "bar.g", NOTHING, False),
    (("mpag", "mpa(g)", "mpagauge"), "1", "MPa", NOTHING, False),
    (("kg/cm2g", "(kg/cm2)g", "kg/cm^2g", "(kg/cm^2)g", "kgcm2g"), "0.980665", "bar.g", NOTHING, True),
    (("kg/cm2a", "(kg/cm2)a", "kg/cm^2a", "(kg/cm^2)a", "kgcm2a"), "0.0980665", "MPa", ABSOLUTE, True),
    (("kpa", "kpag", "kpa(g)"), "0.001", "MPa", NO_BASIS, False),
    (("bar", "bara?"), "0.1", "MPa", NO_BASIS, False),
    (("mpa",), "1", "MPa", NO_BASIS, False),
)


def number_text(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), ",", "")


_RANGE = rf"(?i)^(?:.*?)({NUMBER})\s*(?:[-–—]|to)\s*({NUMBER})"


def first_and_last(value: Column) -> tuple[Column, Column]:
    """The numbers of a value as text: both of a range ``a-b`` or ``a to b``, else the first one; null where there is none."""
    t = number_text(value)
    last = F.nullif(F.regexp_extract(t, _RANGE, 2), F.lit(""))
    return F.when(last.isNotNull(), F.regexp_extract(t, _RANGE, 1)).otherwise(F.nullif(F.regexp_extract(t, f"({NUMBER})", 1), F.lit(""))), last


def decimals(value: Column) -> Column:
    """The same as an array of none, one or two decimals."""
    return F.transform(F.array_compact(F.array(*first_and_last(value))), lambda x: x.try_cast("decimal(28,10)"))


def plain(d: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(d.cast(DECIMAL).cast("string"), r"\.?0+$", "")


def _times(number: Column, by: Column, step: Column | None) -> Column:
    y = (number.try_cast("decimal(28,10)") * by).cast(DECIMAL)
    return plain(y if step is None else y - y % step)


def scaled(value: Column, factor: Column | str, cut: Column | None = None) -> Column:
    """The numbers of a value times a factor, joined; where ``cut``, without what lies beyond two places."""
    by = (F.lit(factor) if isinstance(factor, str) else factor).cast("decimal(14,7)")
    step = None if cut is None else F.when(cut, "0.01").otherwise("0.0000000001").cast("decimal(11,10)")
    return F.concat_ws("-", *(_times(x, by, step) for x in first_and_last(value)))


def _pick(key: Column, rows, default) -> Column:
    out = default
    for names, value in reversed(rows):
        out = F.when(key.isin(*names), value).otherwise(out)
    return out


def _normalized(value: Column, raw: Column, factor: Column, unit: Column, notes: tuple[Column, Column], cut: Column | None) -> Column:
    """One conversion whatever the unit: only factor, unit and notes depend on it."""
    some = F.regexp_extract(number_text(value), f"({NUMBER})", 1) != ""
    return F.struct(
        F.when(some, scaled(value, factor, cut)).otherwise(F.trim(value)).alias("value"),
        F.when(some, unit).otherwise(raw).alias("unit"),
        F.when(some, notes[0]).otherwise(REVIEW[0]).alias("note_cn"),
        F.when(some, notes[1]).otherwise(REVIEW[1]).alias("note_en"),
    )


def normalize_flow(value: Column, unit: Column) -> Column:
    """Struct (value, unit, note_cn, note_en) in L/h."""
    raw = F.trim(F.coalesce(unit, F.lit("")))
    key = F.regexp_replace(F.regexp_replace(F.lower(raw), "³", "3"), " ", "")
    rows = [(names, factor) for factor, names in FLOW.items()]
    known = key.isin(*(x for names, _ in rows for x in names))
    notes = tuple(F.when(known, "").otherwise(REVIEW[i]) for i in (0, 1))
    return _normalized(value, raw, _pick(key, [(n, F.lit(f)) for n, f in rows], F.lit("1")), F.when(known, "L/h").otherwise(raw), notes, None)


def normalize_pressure(value: Column, unit: Column) -> Column:
    """Struct (value, unit, note_cn, note_en) in MPa or bar.g."""
    raw = F.trim(F.coalesce(unit, F.lit("")))
    key = F.regexp_replace(F.lower(raw), r"[ \t._-]+", "")
    pick = lambda i, default: _pick(key, [(r[0], F.lit(r[i])) for r in PRESSURE], default)
    notes = tuple(_pick(key, [(r[0], F.lit(r[3][i])) for r in PRESSURE], F.lit(REVIEW[i])) for i in (0, 1))
    return _normalized(value, raw, pick(1, F.lit("1")), pick(2, raw), notes, pick(4, F.lit(False)))
