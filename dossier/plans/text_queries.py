"""Document queries: blocks, status, identities, text functions, rules, evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import blocks as B
from ..operators import evidence, rules
from ..runtime import table


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"), F.concat("source", F.lit("/Doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))


def document_ids(spark, d):
    return _docs(spark, d).select("doc_id", ids.document_id(F.col("path")).alias("document_id"), text.stem(F.col("path")).alias("stem"), text.file_key(F.col("path")).alias("file_key"), text.file_type(F.col("path")).alias("file_type"))


def blocks(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return B.blocks(docs).select("block_id", "document_id", F.col("text_order").cast("long").alias("text_order"), F.col("line").cast("long").alias("line"), F.md5(F.col("original_text").cast("binary")).alias("text_md5"), F.length("original_text").cast("long").alias("n_chars"))


def _documents(spark, d):
    n = F.size(F.filter(F.split("text", text.LINE_ENDS), lambda x: text.fold_ascii_space(x) != ""))
    return _docs(spark, d).select("doc_id", "path", n.alias("n_blocks"), B.parse_status(n, F.when(F.length("text") < 20, F.lit("short")), F.col("doc_id") % 50 != 0).alias("parse_status"))


def doc_status(spark, d):
    return _documents(spark, d).select("doc_id", F.col("n_blocks").cast("long").alias("n_blocks"), "parse_status")


def status_counts(spark, d):
    return B.status_summary(_documents(spark, d), "path")


def script_metrics(spark, d):
    m = text.script_counts(F.col("text"))
    return _docs(spark, d).select("doc_id", *(c.cast("double" if k.endswith("ratio") else "long").alias(k) for k, c in m.items()), text.display_width(F.col("text")).cast("long").alias("width"))


def doc_language(spark, d):
    m = text.script_counts(F.col("text"))
    return _docs(spark, d).select("doc_id", B.language_of(m["latin"], m["cyrillic"]).alias("language"))


def wrapped_lines(spark, d):
    return _docs(spark, d).select("doc_id", text.wrapped_lines(F.col("text"), 60).cast("long").alias("n_lines"))


def reject_reasons(spark, d):
    """The first rule that keeps a text out of a card."""
    t = text.fold_ascii_space(F.col("text"))
    reason = (
        F.when(t == "", "empty")
        .when(F.length(t) > 2000, "length_limit")
        .when(F.regexp_count(t, F.lit("[0-9]+")) >= 8, "serial_number_sequence")
        .when(F.regexp_count(t, F.lit(":")) >= 4, "concatenated_labels")
        .when(F.size(F.split(t, " ")) > 150, "service_phrase_too_long")
        .when(~t.rlike("[0-9]"), "numeric_value_expected")
        .otherwise("")
    )
    return _docs(spark, d).select("doc_id", reason.alias("reason"))


def truncated_previews(spark, d):
    return _docs(spark, d).select("doc_id", text.truncated(text.fold_ascii_space(F.col("text")), 120).alias("preview"))


def placeholder_tags(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ("P-", "11-P-XXXX-", "TBD", "A/P-", "N/A", "p?", "V-"))), (F.col("p_partkey") % 7 + 1).cast("int")).alias("head"))
    tag = F.when(F.col("head").isin("TBD", "N/A"), F.col("head")).otherwise(F.concat("head", F.col("p_partkey").cast("string")))
    t = p.select("p_partkey", tag.alias("tag"))
    return t.select("p_partkey", "tag", text.is_placeholder(F.col("tag")).alias("placeholder"), text.is_pump_tag(F.col("tag")).alias("pump"))


def tag_tokens(spark, d):
    """Tags found in running text, in order of first sight."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" ", F.lit("pump"), F.concat(F.lit("P-"), F.col("l_partkey").cast("string")), F.lit("spare of"), F.concat(F.lit("a/p-"), F.col("l_suppkey").cast("string")), F.lit("see V-12, P-XX-1 and"), F.concat(F.lit("P-"), F.col("l_partkey").cast("string"))).alias("t"))
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.array_join(text.tags(F.col("t")), ",").alias("tags"))


def page_specs(spark, d):
    """Range lists to pages."""
    li = table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.concat(F.lit("2-"), (F.col("l_orderkey") % 6).cast("string"), F.lit(", 9,"), (F.col("l_orderkey") % 11 + 3).cast("string"), F.lit("-,-1")).alias("spec"))
    return li.select("l_orderkey", "spec", F.array_join(F.transform(text.page_list(F.col("spec"), F.lit(12)), lambda x: x.cast("string")), ",").alias("pages"))


def column_refs(spark, d):
    p = table(spark, d, "part").where("p_partkey >= 1").select("p_partkey", text.column_letters(F.col("p_partkey")).alias("letters"))
    return p.select("p_partkey", "letters", text.column_number(F.concat(F.lit("$"), "letters", F.lit("$7"))).cast("long").alias("number"))


def rule_scan(spark, d):
    return rules.scan(_docs(spark, d), "doc_id", "text")


def page_rule_scan(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("html").alias("body"))
    return rules.scan(p, "page_id", "body", rules=[r for r in rules.RULES if r[0] in ("email", "ipv4", "phone")], bits=99.0).groupBy("rule", "severity").agg(F.count("*").alias("n_findings"), F.countDistinct("page_id").alias("n_pages"))


def denylist_scan(spark, d):
    """All five-word runs of benchmark items, as a list of digests, found in documents."""
    b = rules.word_runs(table(spark, d, "benchmark").select(rules.words(F.col("text")).alias("w")), "w", 5).distinct()
    return rules.denied(_docs(spark, d), "doc_id", "text", b, [5])


def token_entropy(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.col("c_acctbal").cast("long").cast("string")).alias("token"))
    return t.select("c_custkey", F.round(text.entropy(F.col("token")), 6).alias("bits"))


def evidence_verify(spark, d):
    """Three words of the document with the next even number below, or its own,
    as a value of each document: bound by the document, one row each. Of some
    sources only the head is known, some are translations, some have no block."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    values = docs.select(F.col("doc_id").alias("of"), F.array_join(F.slice(F.split("text", " "), 3, 3), " ").alias("value"))
    k = F.col("doc_id")
    met = docs.join(values, F.col("of") == k - k % 2)
    original, translated = F.when(k % 3 == 0, F.substring("text", 1, 12)).otherwise(F.col("text")), F.when(k % 5 == 0, F.col("text"))
    method, block = F.when(k % 4 < 2, "translation_segment").otherwise("text"), F.when(k % 7 > 0, F.col("text"))
    return met.select("doc_id", F.md5(F.col("value").cast("binary")).alias("value_md5"), evidence.verified(F.col("value"), original, translated, method, block, F.lit("")).alias("verified"))


def best_translation(spark, d):
    """For each benchmark item the conversation turn of its remainder with the
    best score. The score hangs on the lengths alone, so both sides are reduced
    to one row per remainder and length; running minima over longer turns then
    give the first turn of each score, and no pairs arise."""
    k = lambda c: (F.col(c) % 20).alias("k")
    b = table(spark, d, "benchmark").select("item_id", k("item_id"), F.length("text").alias("n")).where("k is not null and n is not null")
    c = table(spark, d, "conversations").select(k("conv_id"), F.length("text").alias("n"), F.struct("conv_id", "turn").alias("t")).where("k is not null and n is not null")
    lengths = c.unionByName(b.select("k", "n"), allowMissingColumns=True).groupBy("k", "n").agg(F.min("t").alias("t"))
    same = Window.partitionBy("k", F.col("n") % 7)
    longer = lambda w: w.orderBy(F.desc("n")).rangeBetween(Window.unboundedPreceding, -1)
    scored = lengths.select("k", "n", *(F.min("t").over(w).alias(f"s{x}") for x, w in ((12, longer(same)), (8, same), (6, longer(Window.partitionBy("k"))))))
    best = F.coalesce(*(F.when(F.col(f"s{x}").isNotNull(), F.struct(F.lit(x).cast("long").alias("score"), f"s{x}.conv_id", f"s{x}.turn")) for x in (12, 8, 6)))
    found = scored.select("k", "n", best.alias("b")).where("b is not null")
    return b.join(found, ["k", "n"]).select("item_id", "b.score", "b.conv_id", "b.turn")


def first_match(spark, d):
    """Labelled documents with the first document of the same source and length
    class: the smallest id there, or for that document the second smallest."""
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") % 40).alias("k"))
    lab = table(spark, d, "labels").where("toxic = 1").join(docs, "doc_id").select("doc_id", "source", "k")
    least = docs.groupBy("source", "k").agg(F.min("doc_id").alias("low"))
    rest = docs.join(least.withColumnRenamed("low", "doc_id"), ["source", "k", "doc_id"], "left_anti")
    second = rest.groupBy("source", "k").agg(F.min("doc_id").alias("second"))
    met = lab.join(least.join(second, ["source", "k"], "left"), ["source", "k"], "left")
    other = F.when(F.col("low") != F.col("doc_id"), F.col("low")).otherwise(F.col("second"))
    return met.groupBy("doc_id").agg(F.min(other).alias("other_id"))


def orphan_segments(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id")
    seg = table(spark, d, "labels").select("doc_id", "quality")
    return evidence.with_orphans(docs, seg, "doc_id")


def adjacent_page_join(spark, d):
    """A page takes the material of its item, else that of the page after it."""
    p = table(spark, d, "pages").select("page_id", (F.col("page_id") % 10).alias("file"), F.floor(F.col("page_id") / 10).alias("page"), (F.col("page_id") % 37).alias("item"), F.length("html").alias("n"))
    found = p.where("page_id % 37 < 12 and page_id % 2 = 1").select("file", "page", "item", F.col("n").alias("material"))
    return evidence.keyed_or_next(p.select("page_id", "file", "page", "item"), found, "item", "file", "page", "material").select("page_id", F.col("material").cast("long").alias("material"), "matched_by")


def asof_events(spark, d):
    """For each purchase the last view of the same user at or before it."""
    e = table(spark, d, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    left = e.where(F.col("event_type") == kinds[0]).select("user_id", "event_id", F.col("ts").alias("t"))
    right = e.where(F.col("event_type") == kinds[1]).select("user_id", "ts", F.col("event_id").alias("before_id"))
    right = right.groupBy("user_id", "ts").agg(F.max("before_id").alias("before_id"))
    return evidence.closest_before(left, right, ["user_id"], "t", "ts", ["before_id"]).select("event_id", "user_id", "before_id")


def protected_terms(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(F.array_sort(text.protected_tokens(F.col("text"))), "\n").alias("tokens"))


def translation_routing(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.col("text"))
    return t.select("conv_id", "turn", text.needs_translation(F.col("text")).alias("needs_translation"), text.is_clause(F.col("text")).alias("clause"))


def labelled_values(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.concat(F.lit("PUMP TYPE: "), "p_type", F.lit(" ; RATED CAPACITY = "), F.col("p_size").cast("string"), F.lit(" m3/h MATERIAL: "), "p_brand").alias("t"))
    return t.select("p_partkey", text.label_value(F.col("t"), "PUMP TYPE", "RATED|MATERIAL", 80).alias("pump_type"), text.label_value(F.col("t"), "RATED CAPACITY", "MATERIAL", 40).alias("capacity"))


QUERIES = {
    f.__name__: f
    for f in (
        document_ids, blocks, doc_status, status_counts, script_metrics, doc_language, wrapped_lines, reject_reasons, truncated_previews, placeholder_tags, tag_tokens, page_specs, column_refs,
        rule_scan, page_rule_scan, denylist_scan, token_entropy, evidence_verify, best_translation, first_match, orphan_segments, adjacent_page_join, asof_events, protected_terms, translation_routing, labelled_values,
    )
}

_PATH = "source || '/Doc_' || doc_id || '.txt'"
_FOLD = "trim(regexp_replace({0}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"
_LINES = "regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E]|\\x{85}|\\x{2028}|\\x{2029}')"
_DOCST = f"ds AS (SELECT doc_id, {_PATH} AS path, len([x for x in {_LINES} if {_FOLD.format('x')} <> '']) AS n_blocks, text FROM documents), st AS (SELECT doc_id, path, n_blocks::BIGINT AS n_blocks, CASE WHEN length(text) < 20 THEN 'failed' WHEN doc_id % 50 = 0 THEN 'skipped' WHEN n_blocks = 0 THEN 'low_quality' ELSE 'success' END AS parse_status FROM ds)"
_TAGSQL = "CASE WHEN head IN ('TBD', 'N/A') THEN head ELSE head || p_partkey END"
_PLACE = "(upper(tag) = '' OR regexp_matches(upper(tag), '(^|[-/ ])X{2,}($|[-/ ])') OR upper(tag) IN ('TBD', 'TBA', 'TBC', 'TBN', 'NA', 'NONE', 'LATER', 'HOLD', 'VTS', 'N/A') OR regexp_matches(upper(tag), '^-+$') OR contains(tag, '*') OR contains(tag, '?'))"
_ENT = "list_sum([-(len(list_filter(string_split({0}, ''), lambda y: y = x)) / length({0})) * log2(len(list_filter(string_split({0}, ''), lambda y: y = x)) / length({0})) for x in list_distinct(string_split({0}, ''))])"


def _scan_sql(tab: str, key: str, body: str, names, entropy: bool) -> str:
    parts = [f"SELECT {key}, '{n}' AS rule, '{s}' AS severity, unnest(regexp_extract_all({body}, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS value, {body} AS t FROM {tab}" for n, s, p in rules.RULES if n in names]
    if entropy:
        parts.append(f"SELECT {key}, 'high_entropy_token', 'high_risk', value, t FROM (SELECT {key}, unnest(regexp_extract_all({body}, '{rules.TOKEN}', 1)) AS value, {body} AS t FROM {tab}) WHERE {_ENT.format('value')} >= 4.15")
    return f"hits AS ({' UNION ALL '.join(parts)}), found AS (SELECT {key}, rule, severity, substr(sha256(lower(trim(value))), 1, 16) AS fingerprint, count(*) AS n, min(length(substr(t, 1, instr(t, value))) - length(replace(substr(t, 1, instr(t, value)), chr(10), '')) + 1)::BIGINT AS first_line FROM hits GROUP BY ALL)"


ORACLE_SQL = {
    "document_ids": f"SELECT doc_id, 'doc_' || substr(sha1(lower({_PATH})), 1, 12) AS document_id, 'Doc_' || doc_id AS stem, lower({_PATH}) AS file_key, 'txt' AS file_type FROM documents",
    "blocks": f"""WITH l AS (SELECT doc_id, unnest(list_zip({_LINES}, range(1, len({_LINES}) + 1))) AS z FROM documents), k AS (SELECT doc_id, z[2] AS line, {_FOLD.format('z[1]')} AS x FROM l WHERE {_FOLD.format('z[1]')} <> ''),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS text_order FROM k)
        SELECT doc_id || '_b' || lpad(text_order::VARCHAR, 5, '0') AS block_id, doc_id::VARCHAR AS document_id, text_order, line::BIGINT AS line, md5(x) AS text_md5, length(x)::BIGINT AS n_chars FROM o""",
    "doc_status": f"WITH {_DOCST} SELECT doc_id, n_blocks, parse_status FROM st",
    "status_counts": f"WITH {_DOCST}, r AS (SELECT *, row_number() OVER (PARTITION BY parse_status ORDER BY path) AS k FROM st) SELECT parse_status, count(*) AS n_documents, string_agg(path, ',' ORDER BY path) FILTER (k <= 5) AS first_names FROM r GROUP BY parse_status",
    "script_metrics": """WITH m AS (SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) AS cjk, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^\\x{400}-\\x{4ff}]', '', 'g')) AS cyrillic, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS wide FROM documents)
        SELECT doc_id, chars, cjk, latin, cyrillic, round(latin / greatest(chars, 1), 4) AS latin_ratio, round(cjk / greatest(chars, 1), 4) AS cjk_ratio, chars + wide AS width FROM m""",
    "doc_language": """WITH m AS (SELECT doc_id, regexp_matches(text, '[A-Za-z]') AS l, regexp_matches(text, '[\\x{400}-\\x{4ff}]') AS c FROM documents)
        SELECT doc_id, CASE WHEN l AND c THEN 'mixed' WHEN c THEN 'ru' WHEN l THEN 'en' ELSE 'unknown' END AS language FROM m""",
    "wrapped_lines": "SELECT doc_id, list_sum([greatest(1, ceil((length(x) + length(regexp_replace(x, '[\\x00-\\x7F]', '', 'g'))) / 60.0)) for x in string_split(text, chr(10))])::BIGINT AS n_lines FROM documents",
    "reject_reasons": f"""WITH t AS (SELECT doc_id, {_FOLD.format('text')} AS t FROM documents)
        SELECT doc_id, CASE WHEN t = '' THEN 'empty' WHEN length(t) > 2000 THEN 'length_limit' WHEN len(regexp_extract_all(t, '[0-9]+')) >= 8 THEN 'serial_number_sequence' WHEN len(regexp_extract_all(t, ':')) >= 4 THEN 'concatenated_labels' WHEN len(string_split(t, ' ')) > 150 THEN 'service_phrase_too_long' WHEN NOT regexp_matches(t, '[0-9]') THEN 'numeric_value_expected' ELSE '' END AS reason FROM t""",
    "truncated_previews": f"WITH t AS (SELECT doc_id, {_FOLD.format('text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 119) || '…' ELSE t END AS preview FROM t",
    "placeholder_tags": f"""WITH h AS (SELECT p_partkey, ['P-', '11-P-XXXX-', 'TBD', 'A/P-', 'N/A', 'p?', 'V-'][p_partkey % 7 + 1] AS head FROM part), t AS (SELECT p_partkey, {_TAGSQL} AS tag FROM h)
        SELECT p_partkey, tag, {_PLACE} AS placeholder, NOT {_PLACE} AND (starts_with(upper(tag), 'P-') OR list_contains(regexp_split_to_array(upper(tag), '[-/]'), 'P')) AS pump FROM t""",
    "tag_tokens": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, 'P-' || l_partkey || ',A/P-' || l_suppkey AS tags FROM lineitem",
    "page_specs": """WITH s AS (SELECT l_orderkey, '2-' || l_orderkey % 6 || ', 9,' || l_orderkey % 11 + 3 || '-,-1' AS spec, l_orderkey % 6 AS b, l_orderkey % 11 + 3 AS c FROM lineitem WHERE l_linenumber = 1)
        SELECT l_orderkey, spec, array_to_string([x for x in range(1, 13) if (x >= 2 AND x <= b) OR x = 9 OR x >= c OR x = 1], ',') AS pages FROM s""",
    "column_refs": """SELECT p_partkey, CASE WHEN p_partkey > 702 THEN chr(65 + ((p_partkey - 703) // 676)::INT) ELSE '' END || CASE WHEN p_partkey > 26 THEN chr(65 + (((p_partkey - 27) // 26) % 26)::INT) ELSE '' END || chr(65 + ((p_partkey - 1) % 26)::INT) AS letters, p_partkey AS number FROM part WHERE p_partkey >= 1""",
    "rule_scan": f"WITH {_scan_sql('documents', 'doc_id', 'text', [r[0] for r in rules.RULES], True)} SELECT doc_id, rule, severity, fingerprint, n, first_line FROM found",
    "page_rule_scan": f"WITH {_scan_sql('pages', 'page_id', 'html', ('email', 'ipv4', 'phone'), False)} SELECT rule, severity, count(*) AS n_findings, count(DISTINCT page_id) AS n_pages FROM found GROUP BY ALL",
    "denylist_scan": """WITH w AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(text), '[^a-z0-9]+') if x <> ''] AS w FROM documents), b AS (SELECT DISTINCT array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT [x for x in regexp_split_to_array(lower(text), '[^a-z0-9]+') if x <> ''] AS w FROM benchmark), unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5),
        r AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5) SELECT doc_id, count(*) AS n_denied FROM r WHERE g IN (SELECT g FROM b) GROUP BY doc_id""",
    "token_entropy": f"WITH t AS (SELECT c_custkey, c_name || trunc(c_acctbal)::BIGINT AS token FROM customer) SELECT c_custkey, round({_ENT.format('token')}, 6) AS bits FROM t",
    "evidence_verify": f"""WITH v AS (SELECT doc_id AS o, coalesce(array_to_string(string_split(text, ' ')[3:5], ' '), '') AS value FROM documents),
        e AS (SELECT doc_id AS k, value, lower({_FOLD.format('value')}) AS v, lower({_FOLD.format('text')}) AS t, lower({_FOLD.format('text[1:12]')}) AS h FROM documents JOIN v ON o = doc_id - doc_id % 2),
        p AS (SELECT *, list_filter(list_transform(string_split(v, ';'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM e),
        i AS (SELECT *, v <> '' AND (contains(t, v) OR len(parts) > 1 AND len(list_filter(parts, lambda x: NOT contains(t, x))) = 0) AS whole, v <> '' AND (contains(h, v) OR len(parts) > 1 AND len(list_filter(parts, lambda x: NOT contains(h, x))) = 0) AS head FROM p)
        SELECT k AS doc_id, md5(value) AS value_md5, (CASE WHEN k % 3 = 0 THEN head ELSE whole END OR k % 4 < 2 AND k % 5 = 0 AND whole) AND (k % 4 < 2 OR k % 7 = 0 OR whole) AS verified FROM i""",
    "best_translation": """WITH m AS (SELECT item_id, conv_id, turn, 2 + CASE WHEN length(c.text) % 7 = length(b.text) % 7 THEN 6 ELSE 0 END + CASE WHEN length(c.text) > length(b.text) THEN 4 ELSE 0 END AS score FROM benchmark b JOIN conversations c ON item_id % 20 = conv_id % 20)
        SELECT item_id, score::BIGINT AS score, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, conv_id, turn) AS k FROM m WHERE score >= 6) WHERE k = 1""",
    "first_match": "SELECT l.doc_id, min(o.doc_id) AS other_id FROM labels l JOIN documents d USING (doc_id) LEFT JOIN documents o ON o.source = d.source AND o.n_chars % 40 = d.n_chars % 40 AND o.doc_id <> l.doc_id WHERE toxic = 1 GROUP BY l.doc_id",
    "orphan_segments": """WITH d AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0), s AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_segments, false AS synthetic FROM d LEFT JOIN s USING (doc_id) UNION ALL SELECT doc_id, n, true FROM s WHERE doc_id NOT IN (SELECT doc_id FROM d)""",
    "adjacent_page_join": """WITH p AS (SELECT page_id, page_id % 10 AS file, page_id // 10 AS page, page_id % 37 AS item, length(html) AS n FROM pages), f AS (SELECT * FROM p WHERE item < 12 AND page_id % 2 = 1), i AS (SELECT item, arg_min(n, page) AS n FROM f GROUP BY item)
        SELECT p.page_id, coalesce(i.n, f.n)::BIGINT AS material, CASE WHEN i.n IS NOT NULL THEN 'item' WHEN f.n IS NOT NULL THEN 'next_page' ELSE 'none' END AS matched_by FROM p LEFT JOIN i ON i.item = p.item LEFT JOIN f ON f.file = p.file AND f.page = p.page + 1""",
    "asof_events": """WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)), l AS (SELECT e.* FROM events e JOIN k ON k.event_type = e.event_type AND i = 1), r AS (SELECT user_id, ts, max(event_id) AS before_id FROM events e JOIN k ON k.event_type = e.event_type AND i = 2 GROUP BY user_id, ts)
        SELECT l.event_id, l.user_id, r.before_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
    "protected_terms": "SELECT doc_id, array_to_string(list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(text, '{p}', 1)" for p in text.PROTECTED) + "]))), chr(10)) AS tokens FROM documents",
    "translation_routing": """SELECT conv_id, turn, regexp_matches(trim(text), '[A-Za-z]') AND NOT regexp_matches(trim(text), '[\\x{4e00}-\\x{9fff}]') AND length(trim(text)) > 2 AND NOT regexp_matches(trim(text), '^[A-Z0-9][A-Z0-9 ./_-]*$') AS needs_translation,
        len(regexp_extract_all(text, '[A-Za-z]+')) >= 7 OR regexp_matches(lower(text), '(^|[^a-z])(shall|must|should|will|is|are|be|provide|include)([^a-z]|$)') AS clause FROM conversations""",
    "labelled_values": "SELECT p_partkey, trim(p_type) AS pump_type, p_size || ' m3/h' AS capacity FROM part",
}
