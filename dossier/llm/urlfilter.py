"""URL rules with redirect equivalence, in DataFrame operations only.

Pages that redirect to, or name as canonical, one another are aliases. The
rules judge each url by itself; connected components over redirect and
canonical edges then carry the decisions to the aliases that no rule fits: a
class with an explicitly allowed member is allowed, else one with a blocked
member is blocked, else the page is allowed. A rule that fits a url itself
always stands. Relative targets are resolved against the page's url.

Edge cases: a null url, or one without ``://``, has an empty host and path, is
no alias of anything and is allowed unless a rule fits; equal rows get equal
results, one row out for each row in; null html has no links; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import stored

#: (verdict, host, start of the path); a host stands for itself and its subdomains
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: longer lists are joined, not folded into an expression
MOST_FOLDED = 256


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What edges join on: the url with a lower-case host and without its fragment."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    scheme = _lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), rest))


def resolved(src: Column, dst: Column) -> Column:
    """The target ``dst`` of a link in the page ``src`` as a whole url (RFC 3986; ``<base>`` is not read)."""
    scheme = F.regexp_extract(src, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(src, r"(?s)^.*?://([^/?#]*)", 1))
    path, rest = F.regexp_extract(dst, r"(?s)^([^?#]*)", 1), F.regexp_extract(dst, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path_of(src), r"(?s)^(.*/)", 1)
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    parts = F.split(F.substr(full, F.lit(2)), "/")
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    query = F.when(rest.startswith("?"), rest).otherwise(F.concat(F.regexp_extract(src, r"(?s)^[^?#]*(\?[^#]*)", 1), rest))
    return (
        F.when(dst.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), dst)
        .when(F.instr(src, "://") == 0, F.lit(None).cast("string"))
        .when(dst.startswith("//"), F.concat(scheme, F.lit(":"), dst))
        .when(path == "", F.concat(site, path_of(src), query))
        .otherwise(F.concat(site, F.lit("/"), F.array_join(walked, "/"), rest))
    )


def _ordered(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Longest first; of equal length an allowing one first, then by name."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))


def apply_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` to rows with ``host`` and ``path``."""
    if len(rules) <= MOST_FOLDED:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for v, h, p in reversed(_ordered(rules)):
            fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
            rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
        return urls.withColumns({"rule": rule, "rule_verdict": verdict})
    spark = urls.sparkSession
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(_ordered(rules))], "rank int, v string, h string, p string")
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = places.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("end"))
    best = ends.join(given, (F.col("end") == F.col("h")) & F.col("path").startswith(F.col("p"))).groupBy("host", "path").agg(F.min(F.struct("rank", F.concat("h", "p").alias("rule"), "v")).alias("x"))
    return urls.join(best, ["host", "path"], "left").withColumns({"rule": F.col("x.rule"), "rule_verdict": F.col("x.v")}).drop("x")


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, quoted or not; empty if it has none."""
    at = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*(F.regexp_extract(tag, at, k) for k in (1, 2, 3)))


def decoded(text: Column) -> Column:
    """Character references of the characters that urls are made of: numbers of
    ASCII characters, and the five names."""
    code = lambda x: F.coalesce(F.regexp_extract(x, r"^#([0-9]{1,4});", 1).try_cast("int"), F.conv(F.regexp_extract(x, r"^#[xX]([0-9a-fA-F]{1,4});", 1), 16, 10).try_cast("int"))
    part = lambda x: F.when(code(x).between(32, 126), F.concat(F.char(code(x)), F.regexp_replace(x, r"^#[0-9a-zA-Z]+;", ""))).otherwise(F.concat(F.lit("&"), x))
    pieces = F.split(text, "&(?=#)")
    out = F.when(F.size(pieces) > 1, F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(part(x))), "")).otherwise(text)
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(c))
    return out


def canonical_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) urls of each ``<link>`` whose ``rel`` has the word canonical
    and each ``<meta http-equiv=refresh>`` with a url in the html."""
    low = F.lower("html")
    tagged = pages.where(low.contains("canonical") | low.contains("refresh"))
    tags = tagged.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>"), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    link = F.lower(tag).startswith("<link") & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    meta = F.lower(tag).startswith("<meta") & (F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh")
    refresh = F.regexp_extract(_attribute(tag, "content"), r"(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"']*)", 1)
    target = F.when(link, _attribute(tag, "href")).when(meta, refresh)
    return tags.select("src", F.trim(decoded(target)).alias("dst")).where("dst <> ''")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, by_alias."""
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = canonical_edges(urls)
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst"))
    edges = edges.select("src", resolved(F.col("src"), F.col("dst")).alias("dst"))
    edges = stored(edges.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")).where("a <> b").distinct(), "aliases")
    seen = urls.select("page_id", node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = apply_rules(seen, rules)
    if edges.isEmpty():
        told = ruled.withColumn("class_verdict", F.lit(None).cast("string"))
    else:
        comp = stored(connected_components(edges), "classes")
        # a member that is only the target of an edge counts by its url like a page
        members = comp.select(F.col("node").alias("url"), "component").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "component")
        judged = apply_rules(members, rules).groupBy("component").agg(F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
        whole = judged.select(F.col("component").alias("c"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("class_verdict"))
        named = comp.join(whole, F.col("component") == F.col("c")).where("class_verdict is not null").select(F.col("node").alias("n"), "class_verdict")
        told = ruled.join(named, F.col("node") == F.col("n"), "left")
    return told.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", "class_verdict", F.lit("allow")).alias("verdict"),
        (F.col("rule_verdict").isNull() & F.col("class_verdict").isNotNull()).alias("by_alias"),
    )
