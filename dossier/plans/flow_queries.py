"""Layout, comparison, state and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, export, layout, order, state
from ..runtime import table


def _events(spark, d):
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


def gap_chunks(spark, d):
    """Words of a line: a gap of over 16 between the end of one and the next begins a chunk."""
    e = _events(spark, d).withColumn("x0", F.col("event_id") % 1000).withColumn("x1", F.col("event_id") % 1000 + 5)
    g = layout.gap_groups(e, ["user_id"], ["x0", "event_id"], F.col("x0"), F.col("x1"), 16)
    return g.groupBy("user_id", "chunk").agg(F.count("*").alias("n_words"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def event_sessions(spark, d):
    """Events of a user less than half an hour apart."""
    t = F.unix_seconds("ts")
    g = layout.gap_groups(_events(spark, d), ["user_id"], ["ts", "event_id"], t, t, 1800, "session")
    return g.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first_event"))


def anchored_lines(spark, d):
    """Lines by the first word's height."""
    e = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 2 + F.col("l_partkey") % 2).alias("top"))
    g = layout.anchored_groups(e, ["l_orderkey"], F.col("top"), 3.0)
    return g.select("l_orderkey", F.array_join(F.transform("groups", lambda x: F.concat_ws(":", x["head"].cast("long").cast("string"), x["n"].cast("string"))), ",").alias("lines"))


def paragraphs(spark, d):
    """Lines of a text to paragraphs: a new one at a heading or an item."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where("trim(line) <> ''")
    breaks = F.col("line").rlike(r"^([0-9]+[.)]|[-*#]|[A-Z0-9 ]+:$)") | (F.length("line") < 40)
    g = layout.flagged_groups(t, ["doc_id"], ["at"], breaks, "paragraph")
    return g.groupBy("doc_id", "paragraph").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def page_pairs(spark, d):
    """Cards of a source to pages: long ones alone, short ones by two."""
    t = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return layout.page_pairs(t, ["source"], ["doc_id"], F.col("n_chars") > 2500).groupBy("source", "page").agg(F.count("*").alias("n_cards"), F.min("doc_id").alias("first_doc"), F.sum("n_chars").alias("n_chars"))


def page_ranges(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 60).alias("page"))
    return layout.page_ranges(li, ["l_suppkey"], "page")


def bounding_boxes(spark, d):
    b = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("x0"), F.col("l_suppkey").alias("top"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("x1"), (F.col("l_suppkey") + 10).alias("bottom"))
    box = layout.bounding_box(b, ["l_orderkey"])
    return box.select("l_orderkey", "x0", "top", "x1", "bottom", layout.alignment(F.col("x0"), F.col("x1"), F.lit(2500)).alias("alignment"))


def queue_positions(spark, d):
    """Places of open orders in one queue, by date then key."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    return order.rank_by_range(o, ["at", "o_orderkey"], "place").select("o_orderkey", "place")


def running_balance(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return order.running_total(o, ["o_orderkey"], "price", "total").select("o_orderkey", F.col("total").cast("string").alias("total"))


def greedy_batches(spark, d):
    """Texts of a source in id order to batches of 16 and 6,000 characters."""
    t = table(spark, d, "documents").groupBy("source", F.floor(F.col("doc_id") / 1000).alias("shelf")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))).alias("l"))
    b = t.select("source", "shelf", "l", layout.bounded_batches(F.transform("l", lambda x: x["n_chars"]), 16, 6000).alias("b"))
    rows = b.select("source", F.col("shelf").cast("long").alias("shelf"), F.explode(F.arrays_zip("l", "b")).alias("z")).select("source", "shelf", F.col("z.b").cast("long").alias("batch"), "z.l.doc_id", "z.l.n_chars")
    return rows.groupBy("source", "shelf", "batch").agg(F.count("*").alias("n_texts"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first_doc"))


def page_route(spark, d):
    p = table(spark, d, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).alias("chars"), (F.col("page_id") % 10 / 10.0).alias("quality"), (F.col("page_id") % 7 / 10.0).alias("images"), (F.col("page_id") % 5 / 1000.0).alias("ink"))
    return p.select("page_id", layout.route_of_page(F.col("chars") % 30, F.col("quality"), F.col("images"), F.col("ink")).alias("route"))


def three_way_diff(spark, d):
    docs = table(spark, d, "documents")
    e = docs.where("doc_id % 10 <> 3").select("doc_id", F.col("n_chars").alias("v"))
    a = docs.where("doc_id % 10 <> 4").select("doc_id", F.when(F.col("doc_id") % 10 == 5, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("v"))
    return compare.three_way(e, a, "doc_id", "v")


def upsert_merge(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.lit("old").alias("origin"), F.col("n_chars").alias("v"))
    new = table(spark, d, "labels").select("doc_id", F.lit("new").alias("origin"), F.col("quality").cast("long").alias("v"))
    return compare.upsert(old, new, ["doc_id"])


def dedupe_keep_first(spark, d):
    t = table(spark, d, "documents").select("source", F.md5(F.col("text").cast("binary")).alias("md5"), "doc_id", "lang")
    return compare.keep_first(t, ["md5"], ["doc_id"]).select("md5", "doc_id", "source", "lang")


def cache_misses(spark, d):
    c = table(spark, d, "conversations")
    cache = c.where("turn % 2 = 0").select("text", F.when(F.col("conv_id") % 3 == 0, F.col("text")).when(F.col("conv_id") % 3 == 1, "").otherwise("译文").alias("translation"))
    return compare.cache_misses(c, cache).select(F.md5(F.col("text").cast("binary")).alias("md5"))


def selection_scope(spark, d):
    s = table(spark, d, "labels").select("doc_id").distinct()
    p = table(spark, d, "documents").where("doc_id % 4 <> 1").select("doc_id")
    return compare.selection_issues(s, p, "doc_id")


def name_conflicts(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("stem"), F.lit("txt").alias("suffix"))
    return compare.numbered_names(t, "stem", "suffix", ["doc_id"]).select("doc_id", "output_name")


def superseded_outputs(spark, d):
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("output"), F.col("l_suppkey").alias("source"))
    return compare.owned_only_here(o, o.where("output % 3 = 0"), "output", "source")


def resume_stages(spark, d):
    """Orders of a customer as stages of a run, with signatures of which some changed."""
    o = table(spark, d, "orders")
    s = o.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("stage"), F.col("o_orderpriority").alias("signature"))
    p = o.select(F.col("o_orderkey").alias("stage"), F.when(F.col("o_orderkey") % 5 == 0, "?").otherwise(F.col("o_orderpriority")).alias("signature"), (F.col("o_orderkey") % 7 > 0).alias("outputs_exist"))
    return compare.reusable(s, p, "stage").select("stage", "reusable")


def change_events(spark, d):
    return state.changes(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type")).select("event_id", "user_id", "event_type")


def stalled_users(spark, d):
    e = _events(spark, d)
    end = F.lit(e.agg(F.max("ts")).first()[0])
    return state.stalls(e, "user_id", "ts", 6 * 3600, end).groupBy("user_id").agg(F.count("*").alias("n_stalls"), F.max("seconds").alias("longest"))


def status_rollup(spark, d):
    s = _events(spark, d).select("user_id", F.element_at(F.array(*map(F.lit, ("success", "success", "success", "partial_success", "success", "blocked", "failed"))), (F.col("event_id") % 7 + 1).cast("int")).alias("status"), (F.col("event_id") % 300).alias("run"))
    return state.roll_up(s, ["run", "user_id"], "status")


def latest_events(spark, d):
    return state.latest(_events(spark, d).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def issue_counts(spark, d):
    return _events(spark, d).groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg("value"), 6).alias("mean"))


def props_json(spark, d):
    """Fields of the JSON payload, by path."""
    e = _events(spark, d)
    keys = F.json_object_keys("props")
    return e.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def source_report(spark, d):
    c = table(spark, d, "conversations")
    return export.grouped_report(c, "conv_id", "role", ["turn"], F.concat_ws("=", F.col("turn").cast("string"), F.length("text").cast("string"))).select("conv_id", "report")


def column_widths(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return export.column_widths(c).select("column", F.col("width").cast("long").alias("width"))


def export_review(spark, d):
    """Values with the reasons for a review."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_discount", "l_tax", "l_returnflag")
    return li.select("l_orderkey", "l_linenumber", export.review_reasons(F.col("l_discount") * 10, F.col("l_tax") < 0.07, F.col("l_returnflag"), "R").alias("reasons"))


def project_overview(spark, d):
    t = lambda n: table(spark, d, n)
    return export.overview({"documents": t("documents").agg(F.count("*")), "languages": t("documents").agg(F.countDistinct("lang")), "labels": t("labels").agg(F.count("*")), "toxic": t("labels").agg(F.sum("toxic")), "pages": t("pages").agg(F.count("*"))})


def order_totals_rollup(spark, d):
    """Report totals by status and priority, with subtotals."""
    o = table(spark, d, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        gap_chunks, event_sessions, anchored_lines, paragraphs, page_pairs, page_ranges, bounding_boxes, queue_positions, running_balance, greedy_batches, page_route, three_way_diff, upsert_merge, dedupe_keep_first,
        cache_misses, selection_scope, name_conflicts, superseded_outputs, resume_stages, change_events, stalled_users, status_rollup, latest_events, issue_counts, props_json, source_report, column_widths, export_review, project_overview, order_totals_rollup,
    )
}

ORACLE_SQL = {
    "gap_chunks": """WITH e AS (SELECT *, event_id % 1000 AS x0, event_id % 1000 + 5 AS x1 FROM events), b AS (SELECT *, CASE WHEN lag(x1) OVER w IS NULL OR x0 - lag(x1) OVER w > 16 THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY x0, event_id)),
        g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY x0, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS chunk FROM b) SELECT user_id, chunk, count(*) AS n_words, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY user_id, chunk""",
    "event_sessions": """WITH b AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) > 1800 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM b) SELECT user_id, session, count(*) AS n_events, round(sum(value), 4) AS total, min(event_id) AS first_event FROM g GROUP BY user_id, session""",
    "anchored_lines": """WITH RECURSIVE w AS (SELECT l_orderkey, l_linenumber * 2 + l_partkey % 2 AS top, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 2 + l_partkey % 2) AS k FROM lineitem),
        f AS (SELECT l_orderkey, k, top AS head, 1 AS grp FROM w WHERE k = 1 UNION ALL SELECT w.l_orderkey, w.k, CASE WHEN w.top - f.head > 3 THEN w.top ELSE f.head END, CASE WHEN w.top - f.head > 3 THEN f.grp + 1 ELSE f.grp END FROM f JOIN w ON w.l_orderkey = f.l_orderkey AND w.k = f.k + 1)
        SELECT l_orderkey, string_agg(head || ':' || n, ',' ORDER BY grp) AS lines FROM (SELECT l_orderkey, grp, min(head)::BIGINT AS head, count(*) AS n FROM f GROUP BY l_orderkey, grp) GROUP BY l_orderkey""",
    "paragraphs": """WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), l AS (SELECT * FROM t WHERE trim(line) <> ''),
        g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^([0-9]+[.)]|[-*#]|[A-Z0-9 ]+:$)') OR length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS paragraph FROM l)
        SELECT doc_id, paragraph, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM g GROUP BY doc_id, paragraph""",
    "page_pairs": """WITH l AS (SELECT source, doc_id, n_chars, CASE WHEN n_chars > 2500 THEN 1 ELSE 0 END AS lg FROM documents), r AS (SELECT *, sum(lg) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
        n AS (SELECT *, CASE WHEN lg = 1 THEN 1 ELSE row_number() OVER (PARTITION BY source, run, lg ORDER BY doc_id) % 2 END AS new FROM r), p AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS page FROM n)
        SELECT source, page, count(*) AS n_cards, min(doc_id) AS first_doc, sum(n_chars)::BIGINT AS n_chars FROM p GROUP BY source, page""",
    "page_ranges": """WITH p AS (SELECT DISTINCT l_suppkey, l_partkey % 60 AS page FROM lineitem), i AS (SELECT l_suppkey, page, page - row_number() OVER (PARTITION BY l_suppkey ORDER BY page) AS i FROM p), g AS (SELECT l_suppkey, i, min(page) AS a, max(page) AS b FROM i GROUP BY l_suppkey, i)
        SELECT l_suppkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS pages FROM g GROUP BY l_suppkey""",
    "bounding_boxes": """WITH b AS (SELECT l_orderkey, min(l_partkey) AS x0, min(l_suppkey) AS top, max(l_partkey + l_quantity::BIGINT) AS x1, max(l_suppkey + 10) AS bottom FROM lineitem GROUP BY l_orderkey)
        SELECT *, CASE WHEN abs(x0 - (2500 - x1)) <= 200 AND x0 > 375 THEN 'center' WHEN 2500 - x1 < 300 AND x0 > 1125 THEN 'right' ELSE 'left' END AS alignment FROM b""",
    "queue_positions": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O'",
    "running_balance": "SELECT o_orderkey, (sum(o_totalprice::DECIMAL(18,2)) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))::VARCHAR AS total FROM orders",
    "greedy_batches": """WITH RECURSIVE t AS (SELECT source, doc_id // 1000 AS shelf, doc_id, n_chars, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS k FROM documents),
        f AS (SELECT source, shelf, doc_id, n_chars, k, 1::BIGINT AS batch, 1 AS n, n_chars AS s FROM t WHERE k = 1 UNION ALL
          SELECT t.source, t.shelf, t.doc_id, t.n_chars, t.k, CASE WHEN f.n >= 16 OR f.s + t.n_chars > 6000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n >= 16 OR f.s + t.n_chars > 6000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 16 OR f.s + t.n_chars > 6000 THEN t.n_chars ELSE f.s + t.n_chars END
          FROM f JOIN t ON t.source = f.source AND t.shelf = f.shelf AND t.k = f.k + 1)
        SELECT source, shelf, batch, count(*) AS n_texts, sum(n_chars)::BIGINT AS n_chars, min(doc_id) AS first_doc FROM f GROUP BY source, shelf, batch""",
    "page_route": """WITH p AS (SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) % 30 AS c, page_id % 10 / 10.0 AS q, page_id % 7 / 10.0 AS i, page_id % 5 / 1000.0 AS k FROM pages)
        SELECT page_id, CASE WHEN c >= 12 AND q >= 0.55 AND i < 0.35 THEN 'text' WHEN c >= 12 AND q >= 0.55 THEN 'mixed' WHEN i >= 0.45 OR k >= 0.002 THEN 'scan' ELSE 'blank' END AS route FROM p""",
    "three_way_diff": "SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN 'extra' WHEN 4 THEN 'missing' WHEN 5 THEN 'changed' ELSE 'same' END AS state FROM documents",
    "upsert_merge": "SELECT doc_id, 'old' AS origin, n_chars AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'new', quality::BIGINT FROM labels",
    "dedupe_keep_first": "SELECT md5(text) AS md5, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1",
    "cache_misses": """WITH c AS (SELECT text, CASE conv_id % 3 WHEN 0 THEN text WHEN 1 THEN '' ELSE '译文' END AS tr FROM conversations WHERE turn % 2 = 0), g AS (SELECT text FROM c WHERE trim(tr) <> '' AND trim(tr) <> trim(text) AND length(regexp_replace(tr, '[^A-Za-z]', '', 'g')) <= greatest(24, 1.8 * length(regexp_replace(tr, '[^\\x{4e00}-\\x{9fff}]', '', 'g'))))
        SELECT DISTINCT md5(text) AS md5 FROM conversations WHERE trim(text) <> '' AND text NOT IN (SELECT text FROM g)""",
    "selection_scope": "WITH p AS (SELECT doc_id FROM documents WHERE doc_id % 4 <> 1) SELECT DISTINCT doc_id, 'selected_file_missing' AS code FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM p) UNION ALL SELECT doc_id, 'file_not_selected' FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "name_conflicts": "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS stem, row_number() OVER (PARTITION BY lower(source) ORDER BY doc_id) AS k FROM documents) SELECT doc_id, stem || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.txt' AS output_name FROM t",
    "superseded_outputs": "SELECT l_orderkey AS output, min(l_suppkey) AS source FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0) GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1",
    "resume_stages": "SELECT o_orderkey AS stage, bool_and(o_orderkey % 5 <> 0 AND o_orderkey % 7 > 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS reusable FROM orders",
    "change_events": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type",
    "stalled_users": """WITH t AS (SELECT DISTINCT user_id, ts FROM events), g AS (SELECT user_id, ts, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), (SELECT max(ts) FROM events)) AS u FROM t), s AS (SELECT user_id, (floor(epoch(u)) - floor(epoch(ts)))::BIGINT AS seconds FROM g)
        SELECT user_id, count(*) AS n_stalls, max(seconds) AS longest FROM s WHERE seconds > 21600 GROUP BY user_id""",
    "status_rollup": """WITH s AS (SELECT event_id % 300 AS run, user_id, [1, 1, 1, 2, 1, 3, 4][event_id % 7 + 1] AS r FROM events), m AS (SELECT run, user_id, max(r) AS r FROM s GROUP BY run, user_id)
        SELECT run, user_id, ['success', 'partial_success', 'blocked', 'failed'][r] AS status, count(*) AS n_stages FROM s JOIN m USING (run, user_id, r) GROUP BY run, user_id, r""",
    "latest_events": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "issue_counts": "SELECT event_type AS code, count(*) AS n_events, count(DISTINCT user_id) AS n_users, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "props_json": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    "source_report": """WITH p AS (SELECT conv_id, role, '[' || role || '] ' || string_agg(turn || '=' || length(text), ' | ' ORDER BY turn, turn || '=' || length(text)) AS b FROM conversations GROUP BY conv_id, role) SELECT conv_id, string_agg(b, chr(10) ORDER BY role) AS report FROM p GROUP BY conv_id""",
    "column_widths": "SELECT \"column\", least(greatest(greatest(n, length(\"column\")) + 2, 11), 48)::BIGINT AS width FROM (SELECT 'c_custkey' AS \"column\", max(length(c_custkey::VARCHAR)) AS n FROM customer UNION ALL SELECT 'c_name', max(length(c_name)) FROM customer UNION ALL SELECT 'c_mktsegment', max(length(c_mktsegment)) FROM customer)",
    "export_review": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, concat_ws(';', CASE WHEN l_discount * 10 < 0.6 THEN 'low_confidence' END, CASE WHEN NOT l_tax < 0.07 THEN 'no_source' END, CASE WHEN l_returnflag = 'R' THEN 'pending' END) AS reasons FROM lineitem",
    "project_overview": "SELECT 'documents' AS metric, count(*)::VARCHAR AS value FROM documents UNION ALL SELECT 'languages', count(DISTINCT lang)::VARCHAR FROM documents UNION ALL SELECT 'labels', count(*)::VARCHAR FROM labels UNION ALL SELECT 'toxic', sum(toxic)::VARCHAR FROM labels UNION ALL SELECT 'pages', count(*)::VARCHAR FROM pages",
    "order_totals_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
}
