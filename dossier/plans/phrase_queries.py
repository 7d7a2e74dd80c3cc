"""Phrase queries: collapsed words, dictionary replacement, masked tokens, lines by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phrases
from ..runtime import table


def _dictionary(spark, d):
    """Words of parts and short words of benchmark items."""
    p = table(spark, d, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("w"))
    b = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("w"))
    return p.union(b.where("w rlike '^[a-z]{2,6}$'")).select(F.upper("w").alias("word")).where("word rlike '^[A-Z]+$'").distinct()


def word_segment(spark, d):
    """Names of parts and heads of turns without their blanks, taken apart again."""
    p = table(spark, d, "part").select(F.upper(F.replace(F.concat("p_name", "p_type"), F.lit(" "), F.lit(""))).alias("token"))
    c = table(spark, d, "conversations").select(F.upper(F.array_join(F.slice(F.split("text", " "), 2, 4), "")).alias("token"))
    found = phrases.compounds(p.union(c).where("token rlike '^[A-Z]{8,}$'"), _dictionary(spark, d))
    return found.select("token", F.array_join("parts", " ").alias("parts"))


def ocr_spacing(spark, d):
    """Labels of parts with collapsed words, standards and codes."""
    p = table(spark, d, "part")
    label = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.upper("p_type"), F.lit("-"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.lit("  API"), (F.col("p_size") + 600).cast("string"), F.upper("p_type"), F.lit(" p-"), F.col("p_partkey").cast("string"))
    rows = p.select("p_partkey", label.alias("label"))
    return phrases.spaced(rows, "p_partkey", "label", _dictionary(spark, d)).select("p_partkey", "spaced")


def _terms(spark, d):
    """Runs of one to three words of benchmark items, with their item for a translation."""
    b = table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    runs = b.select("item_id", F.explode(F.array(*(F.array_join(F.slice("w", k, n), " ") for k, n in ((1, 1), (2, 2), (3, 3), (5, 2), (7, 1))))).alias("source"))
    return runs.where("source rlike '[A-Za-z]{6}|[A-Za-z] [A-Za-z]'").select("source", F.concat(F.lit("〔"), F.col("item_id").cast("string"), F.lit("〕")).alias("target"))


def _turns(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def dict_replace(spark, d):
    return phrases.replaced(_turns(spark, d), "id", "text", _terms(spark, d)).select("id", "replaced")


def term_protect(spark, d):
    """Texts of documents and quantities of order lines with their tokens masked and put back."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    li = table(spark, d, "lineitem").select(
        F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.concat_ws(" ", F.lit("pump"), F.concat(F.lit("P-"), "l_partkey", F.lit("/"), "l_suppkey"), F.lit("to API"), F.col("l_suppkey"), F.lit("at"), F.concat(F.col("l_quantity").cast("long").cast("string"), F.element_at(F.array(*map(F.lit, (" bar", "mm", " kg", "V"))), F.col("l_linenumber") % 4 + 1)), F.lit("of 50 Hz")).alias("text"),
    )
    t = docs.union(li).select("id", F.coalesce("text", F.lit("")).alias("text"), phrases.masked(F.coalesce("text", F.lit(""))).alias("m"))
    plain = F.when(F.octet_length("m.masked") == F.length("m.masked"), F.col("m.masked")).otherwise(F.regexp_replace("m.masked", r"[^\x00-\x7F]", "z"))
    return t.select("id", F.md5(plain.cast("binary")).alias("masked_md5"), F.size("m.tokens").cast("long").alias("n_tokens"), F.array_join("m.tokens", "\n").alias("tokens"), (F.lower(phrases.unmasked(F.lower("m.masked"), F.col("m.tokens"))) == F.lower("text")).alias("whole"))


QUERIES = {f.__name__: f for f in (word_segment, ocr_spacing, dict_replace, term_protect)}

_DICT = """dict AS (SELECT DISTINCT upper(w) AS w FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part
      UNION ALL SELECT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE regexp_full_match(w, '[a-z]{2,6}')) WHERE regexp_full_match(upper(w), '[A-Z]{2,}'))"""
# ways from each place on to the end, the nearest place first
_WAYS = """tok AS (SELECT token AS t, length(token) AS n FROM raw WHERE length(token) >= 8 AND token NOT IN (SELECT w FROM dict)),
    lens AS (SELECT t, s, list(k ORDER BY k) AS ls FROM tok, unnest(range(n)) AS a(s), unnest(range(2, n + 1)) AS b(k) WHERE s + k <= n AND t[s + 1:s + k] IN (SELECT w FROM dict) GROUP BY t, s),
    dp AS (SELECT t, n AS s, [{'score': 0::BIGINT, 'neg': 0::BIGINT, 'parts': ''}] AS ways FROM tok
      UNION ALL SELECT dp.t, dp.s - 1, list_prepend(CASE WHEN ls IS NULL THEN NULL ELSE list_sort([{'score': (k * k + ways[k].score)::BIGINT, 'neg': (-k)::BIGINT, 'parts': trim(dp.t[dp.s:dp.s + k - 1] || ' ' || ways[k].parts)} for k in ls if ways[k].score IS NOT NULL], 'DESC')[1] END, ways)
      FROM dp LEFT JOIN lens ON lens.t = dp.t AND lens.s = dp.s - 1 WHERE dp.s > 0),
    seg AS (SELECT t AS token, ways[1].parts AS parts FROM dp WHERE s = 0 AND contains(ways[1].parts, ' '))"""

_SPACE = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"

_DICT_REPLACE = rf"""
    WITH RECURSIVE term AS (SELECT upper(source) AS gram, min('〔' || item_id || '〕') AS target FROM (SELECT item_id, {_SPACE.format("array_to_string(w[k:k + n - 1], ' ')")} AS source
        FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), (VALUES (1, 1), (2, 2), (3, 3), (5, 2), (7, 1)) AS x(k, n)) WHERE regexp_matches(source, '[A-Za-z]{{6}}|[A-Za-z] [A-Za-z]') GROUP BY 1),
    sized AS (SELECT *, len(regexp_extract_all(gram, '[A-Za-z0-9]+|[^A-Za-z0-9]')) AS n FROM term),
    tok AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all({_SPACE.format("text")}, '[A-Za-z0-9]+|[^A-Za-z0-9]') AS tk FROM conversations),
    met AS (SELECT id, i AS a, n, target, row_number() OVER (PARTITION BY id ORDER BY length(gram) DESC, gram, i) AS k FROM (SELECT id, n, i, upper(array_to_string(tk[i:i + n - 1], '')) AS g FROM tok, (SELECT DISTINCT n FROM sized), unnest(range(1, len(tk) - n + 2)) AS u(i)) JOIN (SELECT gram, target FROM sized) s ON g = gram),
    take AS (SELECT id, 0::BIGINT AS k, []::STRUCT(a BIGINT, n BIGINT, target VARCHAR)[] AS kept FROM tok
      UNION ALL SELECT take.id, met.k, CASE WHEN len(list_filter(kept, lambda x: x.a < met.a + met.n AND met.a < x.a + x.n)) > 0 THEN kept ELSE list_append(kept, {{'a': met.a, 'n': met.n, 'target': met.target}}) END FROM take JOIN met ON met.id = take.id AND met.k = take.k + 1),
    best AS (SELECT id, max_by(kept, k) AS kept FROM take GROUP BY id),
    piece AS (SELECT id, i, CASE WHEN h.a IS NULL THEN tk[i] WHEN h.a = i THEN h.target ELSE '' END AS p
      FROM (SELECT tok.id, tk, i, list_filter(kept, lambda x: i BETWEEN x.a AND x.a + x.n - 1)[1] AS h FROM tok JOIN best USING (id), unnest(range(1, len(tk) + 1)) AS u(i))),
    whole AS (SELECT id, string_agg(p, '' ORDER BY i) AS t FROM piece GROUP BY id)
    SELECT tok.id, coalesce(t, '') AS replaced FROM tok LEFT JOIN whole USING (id)"""

_KEPT_SQL = "|".join(phrases.KEPT).replace("'", "''")
_TERM_PROTECT = rf"""
    WITH t AS (SELECT 'd' || doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT concat_ws('-', 'l', l_orderkey, l_linenumber, l_partkey, l_suppkey),
        concat_ws(' ', 'pump', 'P-' || l_partkey || '/' || l_suppkey, 'to API', l_suppkey, 'at', l_quantity::BIGINT || [' bar', 'mm', ' kg', 'V'][l_linenumber % 4 + 1], 'of 50 Hz') FROM lineitem),
    -- word boundaries know ASCII letters only here
    z AS (SELECT id, regexp_replace(text, '[^\x00-\x7F]', 'z', 'g') AS text FROM t),
    m AS (SELECT id, text, regexp_extract_all(text, '{_KEPT_SQL}') AS tk, regexp_split_to_array(text, '{_KEPT_SQL}') AS gap FROM z)
    SELECT id, md5(array_to_string([gap[i] || CASE WHEN i <= len(tk) THEN printf('TKN%04dX', i - 1) ELSE '' END for i in range(1, len(gap) + 1)], '')) AS masked_md5, len(tk)::BIGINT AS n_tokens, array_to_string(tk, chr(10)) AS tokens,
      lower(array_to_string([gap[i] || CASE WHEN i <= len(tk) THEN tk[i] ELSE '' END for i in range(1, len(gap) + 1)], '')) = lower(text) AS whole FROM m"""

ORACLE_SQL = {
    "word_segment": f"""
    WITH RECURSIVE {_DICT},
    raw AS (SELECT DISTINCT token FROM (SELECT upper(replace(p_name || p_type, ' ', '')) AS token FROM part UNION ALL SELECT upper(array_to_string(string_split(text, ' ')[2:5], '')) FROM conversations) WHERE regexp_full_match(token, '[A-Z]{{8,}}')),
    {_WAYS}
    SELECT * FROM seg""",
    "ocr_spacing": rf"""
    WITH RECURSIVE {_DICT},
    lab AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(x || upper(p_type) || '-' || x || '  API' || (p_size + 600) || upper(p_type) || ' p-' || p_partkey, '\s+', ' ', 'g'), '\bWITHE-', 'WITH E-', 'g'), '\b(API|ISO|IEC|ASME|ASTM|DIN|EN)(\d+)', '\1 \2 ', 'g')) AS t
      FROM (SELECT *, upper(replace(p_name, ' ', '')) AS x FROM part)),
    piece AS (SELECT p_partkey, k, regexp_extract_all(t, '[A-Z]+|[^A-Z]+')[k] AS p FROM lab, unnest(range(1, len(regexp_extract_all(t, '[A-Z]+|[^A-Z]+')) + 1)) AS u(k)),
    raw AS (SELECT DISTINCT p AS token FROM piece WHERE regexp_full_match(p, '[A-Z]+')),
    {_WAYS}
    SELECT p_partkey, trim(regexp_replace(string_agg(coalesce(parts, p), '' ORDER BY k), '\s+', ' ', 'g')) AS spaced FROM piece LEFT JOIN seg ON p = token GROUP BY p_partkey""",
    "dict_replace": _DICT_REPLACE,
    "term_protect": _TERM_PROTECT,
}
