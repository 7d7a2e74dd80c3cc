"""Text functions as Catalyst expressions.

Character classes are written out, so that Java and other regular-expression
dialects agree; only :func:`fold_space` takes in Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[一-鿿]"
LATIN = "[A-Za-z]"
CYRILLIC = r"[Ѐ-ӿ]"
# a part ends where no letter or digit follows, so nothing taken is ever given back
TAG = r"(?<![A-Z0-9])([A-Z0-9]{1,6}+(?:[-/][A-Z0-9]{1,8}+){1,4}+)(?![A-Z0-9/-])"
NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?"

#: line ends of a text scan
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def fold_space(c: Column) -> Column:
    """Runs of any white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold_ascii_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))


def join_cjk(c: Column) -> Column:
    """Also without blanks between Chinese characters."""
    return F.regexp_replace(fold_space(c), f"(?<={CJK}) (?={CJK})", "")


def evidence_text(c: Column) -> Column:
    return F.lower(fold_ascii_space(F.coalesce(c, F.lit(""))))


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def script_counts(c: Column) -> dict[str, Column]:
    """Characters and those of three scripts, and the shares of two of them."""
    n = F.length(c)
    count = lambda p: F.regexp_count(c, F.lit(p))
    share = lambda p: F.round(count(p) / F.greatest(n, F.lit(1)), 4)
    return {"chars": n, "cjk": count(CJK), "latin": count(LATIN), "cyrillic": count(CYRILLIC), "latin_ratio": share(LATIN), "cjk_ratio": share(CJK)}


def display_width(c: Column) -> Column:
    """Columns of a terminal: a character beyond ASCII takes two."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))


def wrapped_lines(c: Column, width: int) -> Column:
    """Lines after wrapping each line at ``width`` columns; an empty line is one."""
    lines = F.split(c, "\n", -1)
    return F.aggregate(lines, F.lit(0), lambda t, x: t + F.greatest(F.lit(1), F.ceil(display_width(x) / width).cast("int")))


def natural_key(c: Column, digits: int = 20) -> Column:
    """A string that sorts tags naturally: runs of digits by value, letters without case."""
    parts = F.regexp_extract_all(F.lower(F.trim(c)), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, digits, "0")).otherwise(p)), "")


def is_placeholder(c: Column) -> Column:
    """Tags that stand for nothing yet."""
    t = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return (t == "") | t.rlike(r"(^|[-/ ])X{2,}($|[-/ ])") | t.rlike(r"^(TBD|TBA|TBC|TBN|NA|NONE|LATER|HOLD|VTS|N/A|-+)$") | t.contains("*") | t.contains("?")


def is_pump_tag(c: Column) -> Column:
    return ~is_placeholder(c) & (F.upper(c).startswith("P-") | F.exists(F.split(F.upper(c), "[-/]"), lambda x: x == "P"))


def tags(c: Column) -> Column:
    """Distinct pump tags of a text, in order."""
    # of what :data:`TAG` finds, placeholders with a part P are those with a part of X alone
    part = lambda x, of: x.rlike(f"(?:^|[-/]){of}(?:$|[-/])")
    pump = lambda x: (x.startswith("P-") | (x.contains("P") & part(x, "P"))) & ~(x.contains("XX") & part(x, "X{2,}"))
    return F.array_distinct(F.filter(F.regexp_extract_all(F.upper(c), F.lit(TAG), 1), pump))


def clean_value(c: Column) -> Column:
    return F.regexp_replace(fold_ascii_space(c), r"^[ :;,]+|[ :;,]+$", "")


def value_in_text(value: Column, text: Column) -> Column:
    """Containment but for white space and case; a list by ``;`` if all its parts are."""
    v, t = evidence_text(value), evidence_text(text)
    parts = F.filter(F.transform(F.split(v, ";"), F.trim), lambda x: x != "")
    return (v != "") & (t.contains(v) | ((F.size(parts) > 1) & F.forall(parts, lambda x: t.contains(x))))


def truncated(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"\.[^.]+$", "")


def file_key(c: Column) -> Column:
    """Paths alike on all systems: slashes, no case, none at the end."""
    return F.regexp_replace(F.lower(F.translate(F.trim(c), "\\", "/")), "/+$", "")


def file_type(c: Column) -> Column:
    s = F.lower(F.regexp_extract(c, r"\.([^./\\]+)$", 1))
    return F.when(s.isin("xlsx", "xlsm"), "xlsx").when(s.isin("docx", "doc", "xls", "pdf", "txt", "csv"), s).otherwise("other")


def column_number(c: Column) -> Column:
    """Of a cell reference: A1 is 1, AA7 is 27; null if there are no letters."""
    letters = F.regexp_extract(F.upper(F.regexp_replace(c, r"\$", "")), "^([A-Z]+)", 1)
    return F.when(letters != "", F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda n, x: F.when(x == "", n).otherwise(n * 26 + F.ascii(x) - 64)))


def column_letters(c: Column) -> Column:
    """1 is A, 27 is AA, 703 is AAA, and so on; as many letters as it takes."""
    n = c.cast("long")
    # how many references have at most k letters: 26 + 26^2 + ...; a long takes 13
    before = [sum(26**i for i in range(1, k)) for k in range(1, 14)]
    return F.concat(*(F.when(n > before[k], F.char((F.pmod(F.call_function("div", n - 1 - before[k], F.lit(26**k)), F.lit(26)) + 65).cast("int"))).otherwise("") for k in reversed(range(13))))


def page_list(spec: Column, pages: Column) -> Column:
    """``1-3,7,9-`` as sorted distinct pages within 1 and ``pages``."""

    def expand(part):
        a, b = F.regexp_extract(part, r"^([0-9]*)", 1), F.regexp_extract(part, r"-([0-9]*)$", 1)
        first = F.when(a == "", F.lit(1)).otherwise(F.try_to_number(a, F.lit("99999999")).cast("int"))
        last = F.when(~part.contains("-"), first).when(b == "", pages).otherwise(F.try_to_number(b, F.lit("99999999")).cast("int"))
        last = F.least(last, pages)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    parts = F.filter(F.split(F.regexp_replace(spec, " ", ""), ","), lambda x: x.rlike("[0-9]"))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(parts, expand)), lambda x: x >= 1)))


#: codes, numbers with units, standards, addresses
PROTECTED = (
    r"([A-Z]+[0-9]*(?:-[A-Z0-9]+)+)",
    r"([0-9]+(?:\.[0-9]+)? ?(?:mm|cm|m3/h|L/h|bar|MPa|kPa|kW|rpm|Hz|V))",
    r"((?:API|ISO|ASTM|ASME|DIN|EN|GB) ?[0-9]+)",
    r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})",
    r"(https?://[^ \t\r\n]+)",
)


def protected_tokens(c: Column) -> Column:
    """Distinct tokens that a translation must keep."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(p), 1) for p in PROTECTED))))


def needs_translation(c: Column) -> Column:
    """Latin text of more than two characters, neither Chinese nor a code."""
    t = F.trim(c)
    return t.rlike(LATIN) & ~has_cjk(t) & (F.length(t) > 2) & ~t.rlike(r"^[A-Z0-9][A-Z0-9 ./_-]*$")


def is_clause(c: Column) -> Column:
    return (F.regexp_count(c, F.lit(r"[A-Za-z]+")) >= 7) | F.lower(c).rlike(r"(^|[^a-z])(shall|must|should|will|is|are|be|provide|include)([^a-z]|$)")


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits. A character is counted by
    what its removal takes away, not by a pass over an array of all."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.length(c)
    p = lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda t, x: t - p(x) * F.log2(p(x)))


def label_value(c: Column, labels: str, stops: str, most: int) -> Column:
    """What stands after a label up to the nearest stop label, within ``most`` characters."""
    cut = F.regexp_extract(c, rf"(?is)(?:{labels})\s*[:=]?\s*(.{{0,{most}}})", 1)
    return clean_value(F.regexp_replace(cut, rf"(?is)(?:{stops}).*$", ""))
