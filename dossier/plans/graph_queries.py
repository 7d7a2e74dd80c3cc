"""Graph and tree queries: stage reuse over what stages read, literal pairs of nested JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reuse, rules, trees
from ..runtime import table


def stage_reuse(spark, d):
    """Parts play stages that read those of a third and of half their number, and their size below."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    now = p.select(F.col("p_partkey").alias("stage"), F.concat("p_brand", F.when(F.col("p_partkey") % 89 == 7, "+").otherwise("")).alias("signature"))
    before = p.where("p_partkey % 211 <> 5").select(F.col("p_partkey").alias("stage"), F.col("p_brand").alias("signature"), (F.col("p_partkey") % 149 != 11).alias("outputs_exist"), F.when(F.col("p_partkey") % 97 == 13, "failed").otherwise("success").alias("status"))
    half = p.where("p_partkey > 40").select(F.floor(F.col("p_partkey") / 2).cast("long").alias("source"), F.col("p_partkey").alias("target"))
    third = p.where("p_partkey > 40 and p_size % 2 = 0").select(F.floor(F.col("p_partkey") / 3).cast("long").alias("source"), F.col("p_partkey").alias("target"))
    found = reuse.stage_reuse(now, half.union(third), before)
    return found.select("stage", "reusable", "reason", F.col("distance").cast("long").alias("distance"), "root")


def long_pairs(spark, d):
    """Turns as nested JSON: sentences as names of what follows them, among other members."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.split("text", "\n").alias("lines"))
    inner = F.transform("lines", lambda x, i: F.create_map(x, F.concat("role", F.lit(" "), i.cast("string"))))
    doc = F.to_json(F.struct("role", F.struct(inner.alias("pairs"), F.array(F.array(F.struct(F.col("text").alias("deep")))).alias("lists")).alias("body"), F.col("turn").alias("n")))
    pairs = trees.literal_pairs(c.select("conv_id", "turn", doc.alias("doc")), ["conv_id", "turn"], "doc")
    return pairs.select("conv_id", "turn", "path", F.md5(F.col("name").cast("binary")).alias("name_md5"), rules.fingerprint(F.col("value")).alias("fingerprint"), trees.is_long_text(F.col("name")).alias("long"))


QUERIES = {f.__name__: f for f in (stage_reuse, long_pairs)}

ORACLE_SQL = {
    "stage_reuse": """
    WITH RECURSIVE now AS (SELECT p_partkey AS stage, p_size, CASE WHEN p_partkey % 211 = 5 THEN 'never_ran' WHEN p_partkey % 89 = 7 THEN 'signature_changed' WHEN p_partkey % 97 = 13 THEN 'not_successful' WHEN p_partkey % 149 = 11 THEN 'outputs_missing' END AS own FROM part),
    e AS (SELECT stage // 2 AS source, stage AS target FROM now WHERE stage > 40 UNION SELECT stage // 3, stage FROM now WHERE stage > 40 AND p_size % 2 = 0),
    s AS (SELECT stage, 0::BIGINT AS distance, stage AS root FROM now WHERE own IS NOT NULL UNION SELECT target, distance + 1, root FROM s JOIN e ON s.stage = e.source),
    near AS (SELECT stage, min(ROW(distance, root)) AS b FROM s GROUP BY stage)
    SELECT stage, b IS NULL AS reusable, coalesce(own, CASE WHEN b IS NOT NULL THEN 'upstream_stale' END, '') AS reason, b[1] AS distance, b[2] AS root FROM now LEFT JOIN near USING (stage)""",
    "long_pairs": """
    WITH c AS (SELECT conv_id, turn, role, text, string_split(text, chr(10)) AS lines FROM conversations),
    j AS (SELECT conv_id, turn, json_object('role', role, 'body', json_object('pairs', list_transform(lines, lambda x, i: json_object(x, role || ' ' || (i - 1))), 'lists', [[json_object('deep', text)]]), 'n', turn) AS doc FROM c),
    t AS (SELECT conv_id, turn, x.key AS name, json_extract_string(x.atom, '$') AS value, x.path AS p FROM j, json_tree(doc) AS x WHERE x.type = 'VARCHAR')
    SELECT conv_id, turn, replace(replace(replace(replace(p, '$', ''), '[', '/'), ']', ''), '.', '/') AS path, md5(name) AS name_md5, sha256(lower(trim(value)))[1:16] AS fingerprint,
      length(trim(name)) >= 45 OR len(regexp_extract_all(name, '[A-Za-z]{2,}')) >= 7 AS long FROM t WHERE name IS NOT NULL""",
}
