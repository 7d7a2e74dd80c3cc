"""Rule scan of texts: patterns, fields with values, long tokens of high entropy.

Findings carry a fingerprint, never the value itself.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: (rule, severity, pattern with one group)
RULES = (
    ("email", "warning", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"),
    ("ipv4", "warning", r"(?:^|[^0-9.])([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?:$|[^0-9.])"),
    ("url", "information", r"(https?://[^ \t\r\n\"'<>]+)"),
    ("phone", "warning", r"(?:^|[^0-9])(\+?[0-9]{2,3}[- ][0-9]{3,4}[- ][0-9]{4,8})(?:$|[^0-9])"),
    ("secret_field", "high_risk", r"(?:api_key|apikey|secret|token|password)[ ]*[:=][ ]*[\"']?([A-Za-z0-9_/+-]{8,})"),
    ("windows_path", "information", r"([A-Za-z]:\\[A-Za-z0-9_\\. -]+)"),
)
#: characters of a token that may be a key
TOKEN = r"([A-Za-z0-9_+/=-]{24,})"


def fingerprint(value: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(value)), 256), 1, 16)


def line_of(body: Column, before: Column) -> Column:
    """Line of an offset: line feeds before it, and one."""
    return F.regexp_count(F.substring(body, F.lit(1), before), F.lit("\n")) + 1


def scan(docs: DataFrame, key: str, body: str, rules: Sequence[tuple[str, str, str]] = RULES, bits: float = 4.15) -> DataFrame:
    """(key, rule, severity, fingerprint, n, first_line), by distinct value.

    The rules are folded into one expression: one pass over the text and no join."""
    hits = F.flatten(
        F.array(
            *(_hits(body, *rule) for rule in rules),
            F.filter(_hits(body, "high_entropy_token", "high_risk", TOKEN), lambda h: text.entropy(h["value"]) >= bits),
        )
    )
    rows = docs.select(key, F.col(body).alias("_t"), F.explode(hits).alias("h"))
    at = F.instr(F.col("_t"), F.col("h.value"))
    found = rows.select(key, "h.rule", "h.severity", fingerprint(F.col("h.value")).alias("fingerprint"), line_of(F.col("_t"), at).alias("line"))
    return found.groupBy(key, "rule", "severity", "fingerprint").agg(F.count("*").alias("n"), F.min("line").cast("long").alias("first_line"))


#: what every match of a rule of :data:`RULES` holds: a text with none of these is not searched
HELD = {"email": ("@",), "url": ("://",), "secret_field": ("api_key", "apikey", "secret", "token", "password"), "windows_path": (":\\",)}
_HELD = {pattern: HELD[rule] for rule, _, pattern in RULES if rule in HELD}


def _hits(body: str, rule: str, severity: str, pattern: str) -> Column:
    found = F.regexp_extract_all(F.col(body), F.lit(pattern), 1)
    if pattern in _HELD:
        found = F.when(functools.reduce(lambda a, b: a | b, (F.contains(F.col(body), F.lit(x)) for x in _HELD[pattern])), found).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda x: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), x.alias("value")))


def words(c: Column) -> Column:
    """Runs of ASCII letters and digits, small."""
    return F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != "")


def word_runs(docs: DataFrame, words: str, n: int) -> DataFrame:
    """A row for each ``n`` adjacent words of each row's list: (size, mark,
    digest) beside the other columns. The digest is the SHA-256 of the run, the
    mark a quick 64-bit hash; both are never null, so no join asks that of a
    digest before it is needed."""
    others = [c for c in docs.columns if c != words]
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n))
    rows = docs.select(*others, words, F.explode(at).alias("_i"))
    mark = F.xxhash64(*(F.get(words, F.col("_i") + k) for k in range(n)))
    digest = F.coalesce(F.sha2(F.array_join(F.slice(words, F.col("_i") + 1, n), " "), 256), F.lit(""))
    return rows.select(*others, F.lit(n).alias("size"), mark.alias("mark"), digest.alias("digest"))


def denied(docs: DataFrame, key: str, body: str, denylist: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Word runs whose (size, digest) is on a list of hashes; equi-joined.

    If the list has marks too, as :func:`word_runs` makes them, only runs whose
    mark is on it are digested; the digest decides."""
    listed = docs.select(key, words(F.col(body)).alias("_w"))
    rows = functools.reduce(DataFrame.unionByName, (word_runs(listed, "_w", n) for n in sizes))
    if "mark" in denylist.columns:
        rows = rows.join(denylist.select("size", "mark").distinct(), ["size", "mark"], "left_semi")
    return rows.join(denylist.select("size", "digest"), ["size", "digest"], "left_semi").groupBy(key).agg(F.count("*").alias("n_denied"))
