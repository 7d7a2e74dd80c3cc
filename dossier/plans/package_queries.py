"""Package, progress and view queries; the stream form of change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import package
from ..runtime import shared_path, table
from ..streaming import progress


def _files(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "source")


def file_inventory(spark, d):
    return _files(spark, d).select("path", F.col("size").cast("long").alias("size"), "sha256")


def inventory_integrity(spark, d):
    """Stored against current files of which some changed, went or came."""
    f = _files(spark, d)
    stored = f.where("doc_id % 11 <> 1")
    current = f.where("doc_id % 11 <> 2").withColumn("size", F.when(F.col("doc_id") % 11 == 3, F.col("size") + 1).otherwise(F.col("size"))).withColumn("sha256", F.when(F.col("doc_id") % 11 == 4, "?").otherwise(F.col("sha256")))
    return package.integrity(stored, current)


def repeated_contents(spark, d):
    return _files(spark, d).groupBy("sha256").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path")).where("n_files > 1")


def scope_files(spark, d):
    """Selected paths in other spellings."""
    sel = _files(spark, d).where("doc_id % 5 = 0").select(F.upper(F.translate("path", "/", "\\")).alias("path"))
    return package.in_scope(_files(spark, d), sel).select("path")


def stage_states(spark, d):
    """Orders as stages whose lines are files."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("good"))
    return li.select("l_orderkey", package.stage_status(F.col("good"), F.col("n"), F.col("l_orderkey") % 17 == 0).alias("status"))


def translation_progress(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", package.file_status(F.element_at(F.array(*map(F.lit, ("OK", "partial", "error ", "blocked", "?", "cached"))), (F.col("l_partkey") % 6 + 1).cast("int")), F.col("l_quantity") > 45).alias("status"))
    return package.progress(li, ["l_suppkey"])


def unit_lists(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", F.when(F.col("l_linenumber") < 5, F.col("l_returnflag")).otherwise("").alias("unit"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return package.field_units(li, ["l_partkey"], "unit", "ord", F.lit("-"))


def artifact_names(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit(" a/"), "source", F.lit("?"), F.when(F.col("doc_id") % 2 == 0, ".TXT").otherwise(".txt")).alias("name"))
    return package.artifact_names(t, "name", ["doc_id"]).select("doc_id", "artifact")


def search_all(spark, d):
    c, s, p = (table(spark, d, t) for t in ("customer", "supplier", "part"))
    return package.searched([("customer", c, ("c_name", "c_mktsegment"), "c_custkey"), ("supplier", s, ("s_name",), "s_suppkey"), ("part", p, ("p_name", "p_type"), "p_partkey")], "B").groupBy("ord", "kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).withColumn("ord", F.col("ord").cast("long"))


def upload_limits(spark, d):
    return package.within_limits(table(spark, d, "orders").select("o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 15, 300_000, 1_500_000)


def safe_paths(spark, d):
    u = table(spark, d, "pages").select("page_id", F.regexp_replace(F.substring("url", 8, 60), r"example", "..").alias("p"))
    v = u.select("page_id", F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("C:"), "p")).when(F.col("page_id") % 6 == 1, F.concat(F.lit("a/../"), "p")).when(F.col("page_id") % 6 == 2, F.concat("p", F.lit("/nul.txt"))).otherwise(F.regexp_replace("p", "^/+", "")).alias("p"))
    return v.select("page_id", package.safe_path(F.col("p")).alias("safe"))


def failure_lines(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("start\nTraceback (most recent call last)\n  File \"x\"\nValueError: order "), F.col("o_orderkey").cast("string"), F.lit(" in /tmp/a/b.txt is bad\n\n")).alias("log"))
    return t.select("o_orderkey", package.failure_summary(F.col("log")).alias("message"))


def log_metrics(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.concat_ws("\n", F.lit("progress: 10 time: 1.5s"), F.concat(F.lit("progress = "), (F.col("o_orderkey") % 100).cast("string")), F.lit("FAILED x time=0.25 s"), F.lit("error")).alias("log"))
    m = package.log_metrics(F.col("log"))
    return t.select("o_orderkey", m.alias("m")).select("o_orderkey", F.col("m.progress").cast("long").alias("progress"), F.col("m.n_failures").cast("long").alias("n_failures"), "m.seconds", "m.longest")


def file_types(spark, d):
    u = table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.element_at(F.array(*map(F.lit, ("", ".XLSX", ".xlsm", ".docx", ".pdf"))), (F.col("page_id") % 5 + 1).cast("int"))).alias("f"))
    return u.groupBy(text.file_type(F.col("f")).alias("file_type")).agg(F.count("*").alias("n_files"))


def stream_change_events(spark, d):
    """Change detection as a stream over the events table, written as it goes."""
    given = spark.read.parquet(f"{d}/events.parquet")
    reader = spark.readStream.schema(given.schema)
    if given.inputFiles()[0].endswith("/events.parquet"):  # a single file: a stream reads its folder
        reader = reader.option("pathGlobFilter", "events.parquet")
        events = reader.parquet(d)
    else:
        events = reader.parquet(f"{d}/events.parquet")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = shared_path(spark, "changes")
    q = progress.changes(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(out)


QUERIES = {f.__name__: f for f in (file_inventory, inventory_integrity, repeated_contents, scope_files, stage_states, translation_progress, unit_lists, artifact_names, search_all, upload_limits, safe_paths, failure_lines, log_metrics, file_types, stream_change_events)}

_F = "f AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size, sha256(text) AS sha256 FROM documents)"
ORACLE_SQL = {
    "file_inventory": f"WITH {_F} SELECT path, size, sha256 FROM f",
    "inventory_integrity": f"WITH {_F} SELECT path, CASE doc_id % 11 WHEN 1 THEN 'new' WHEN 2 THEN 'missing' WHEN 3 THEN 'size_changed' WHEN 4 THEN 'content_changed' ELSE 'ok' END AS state FROM f",
    "repeated_contents": f"WITH {_F} SELECT sha256, count(*) AS n_files, min(path) AS first_path FROM f GROUP BY sha256 HAVING count(*) > 1",
    "scope_files": f"WITH {_F} SELECT path FROM f WHERE doc_id % 5 = 0",
    "stage_states": "SELECT l_orderkey, CASE WHEN l_orderkey % 17 = 0 THEN 'blocked' WHEN count(*) FILTER (l_linestatus = 'F') = count(*) THEN 'success' WHEN count(*) FILTER (l_linestatus = 'F') > 0 THEN 'partial_success' ELSE 'failed' END AS status FROM lineitem GROUP BY l_orderkey",
    "translation_progress": """WITH s AS (SELECT l_suppkey, CASE WHEN l_quantity > 45 THEN 'skipped' ELSE ['translated', 'partial', 'failed', 'blocked', 'pending', 'skipped'][l_partkey % 6 + 1] END AS s FROM lineitem),
        g AS (SELECT l_suppkey, count(*) AS n_files, count(*) FILTER (s = 'translated') AS n_translated, count(*) FILTER (s = 'partial') AS n_partial, count(*) FILTER (s = 'skipped') AS n_skipped, count(*) FILTER (s = 'failed') AS n_failed, count(*) FILTER (s = 'blocked') AS n_blocked, count(*) FILTER (s = 'pending') AS n_pending FROM s GROUP BY l_suppkey)
        SELECT *, round((n_files - n_pending) / n_files, 4) AS done_ratio, CASE WHEN n_pending > 0 THEN 'running' WHEN n_failed + n_blocked = n_files THEN 'failed' WHEN n_failed + n_blocked + n_partial > 0 THEN 'partial_success' ELSE 'success' END AS label FROM g""",
    "unit_lists": "WITH u AS (SELECT l_partkey, l_returnflag AS u, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem WHERE l_linenumber < 5 GROUP BY ALL), j AS (SELECT l_partkey, string_agg(u, '/' ORDER BY o, u) AS units FROM u GROUP BY l_partkey) SELECT p.l_partkey, coalesce(units, '-') AS units FROM (SELECT DISTINCT l_partkey FROM lineitem) p LEFT JOIN j USING (l_partkey)",
    "artifact_names": "WITH n AS (SELECT doc_id, 'a_' || source || '_' AS h, CASE WHEN doc_id % 2 = 0 THEN '.TXT' ELSE '.txt' END AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT doc_id, h || CASE WHEN k > 1 THEN '-' || k ELSE '' END || t AS artifact FROM n",
    "search_all": "SELECT 0::BIGINT AS ord, 'customer' AS kind, count(*) AS n, min(c_custkey::VARCHAR) AS first_id FROM customer WHERE contains(lower(c_name), 'b') OR contains(lower(c_mktsegment), 'b') HAVING count(*) > 0 UNION ALL SELECT 1, 'supplier', count(*), min(s_suppkey::VARCHAR) FROM supplier WHERE contains(lower(s_name), 'b') HAVING count(*) > 0 UNION ALL SELECT 2, 'part', count(*), min(p_partkey::VARCHAR) FROM part WHERE contains(lower(p_name), 'b') OR contains(lower(p_type), 'b') HAVING count(*) > 0",
    "upload_limits": "SELECT o_custkey, CASE WHEN count(*) > 15 THEN 'too_many_files' WHEN max(o_totalprice) > 300000 THEN 'file_too_large' WHEN sum(o_totalprice) > 1500000 THEN 'upload_too_large' ELSE '' END AS broken FROM orders GROUP BY o_custkey",
    "safe_paths": r"""WITH u AS (SELECT page_id, regexp_replace(substr(url, 8, 60), 'example', '..', 'g') AS p FROM pages), v AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'C:' || p WHEN 1 THEN 'a/../' || p WHEN 2 THEN p || '/nul.txt' ELSE regexp_replace(p, '^/+', '') END AS p FROM u)
        SELECT page_id, p <> '' AND NOT starts_with(p, '/') AND NOT regexp_matches(p, '^[A-Za-z]:') AND NOT list_contains(string_split(p, '/'), '..') AND len([x for x in string_split(p, '/') if regexp_matches(x, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$')]) = 0 AS safe FROM v""",
    "failure_lines": "SELECT o_orderkey, 'ValueError: order ' || o_orderkey || ' in <path> is bad' AS message FROM orders",
    "log_metrics": "SELECT o_orderkey, o_orderkey % 100 AS progress, 2::BIGINT AS n_failures, 1.75::DOUBLE AS seconds, 1.5::DOUBLE AS longest FROM orders",
    "file_types": "WITH u AS (SELECT lower(regexp_extract(regexp_replace(url, '[?#].*$', '') || ['', '.XLSX', '.xlsm', '.docx', '.pdf'][page_id % 5 + 1], '\\.([^./\\\\]+)$', 1)) AS s FROM pages) SELECT CASE WHEN s IN ('xlsx', 'xlsm') THEN 'xlsx' WHEN s IN ('docx', 'doc', 'xls', 'pdf', 'txt', 'csv') THEN s ELSE 'other' END AS file_type, count(*) AS n_files FROM u GROUP BY 1",
    "stream_change_events": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type",
}
