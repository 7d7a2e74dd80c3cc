"""The thin queries over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from . import decontam, langid, lm, merkle, packing, pii, quality, repair, simhash, suffix, tokenfile, urlfilter, warc


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "languages", "other_share")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, base, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = tokenfile.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2)
    return tokenfile.read(spark, base)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "by_alias")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_lm_scoring, op4_simhash, op5_decontamination, op6_suffix_dedup, op7_packing, op8_warc, op9_token_file, op10_url_filters, op11_merkle_manifest, op12_personal_data, op13_conversation_repair, pipeline)}

# a word: no blank, tab, line feed, vertical tab, form feed or carriage return
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"


def _op1_sql() -> str:
    import math

    value = "(CASE measure " + " ".join(f"WHEN '{k}' THEN {v}" for k, (v, _) in quality.MEASURES.items()) + " END)"
    low = ", ".join(f"'{k}'" for k, (_, low) in quality.MEASURES.items() if low)
    quart = lambda by: f"""SELECT {by}measure, max(size) AS size, min(CASE WHEN upto > floor(0.25 * (size - 1)) THEN bucket END) AS q1, min(CASE WHEN upto > floor(0.75 * (size - 1)) THEN bucket END) AS q3
      FROM (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}measure) AS size
            FROM (SELECT {by}measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL"""  # noqa: E731
    leant = lambda q, size, wider: f"(({size} * {q} + {quality.LEAN} * {wider}) / ({size} + {quality.LEAN}))"
    quartile = lambda q: f"floor({leant('own.' + q, 'own.size', leant('b.' + q, 'b.size', 'e.' + q))} + 0.5::DOUBLE)::INT AS {q}"
    return f"""
    WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS.format("text")} AS w FROM documents),
    win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3),
    often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, range(3) AS r(k) GROUP BY doc_id),
    ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
           WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
    m AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
          FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
    long AS (SELECT m.doc_id, lang, source, measure, ({quality.BASE_FAILED}) AS failed, CASE WHEN {value} <= 0 THEN {quality.ZERO} ELSE ceil(ln({value}) / {math.log(quality.GAMMA)!r}::DOUBLE)::INT END AS bucket
             FROM m, (VALUES {", ".join(f"('{k}')" for k in quality.MEASURES)}) AS k(measure)),
    sketch AS (SELECT lang, source, measure, bucket, count(*) AS n FROM long WHERE NOT failed GROUP BY ALL),
    own AS ({quart("lang, source, ")}), bylang AS ({quart("lang, ")}), every AS ({quart("")}),
    q AS (SELECT own.lang, own.source, own.measure, {quartile("q1")}, {quartile("q3")}
          FROM own JOIN bylang b ON own.lang IS NOT DISTINCT FROM b.lang AND own.measure = b.measure JOIN every e ON own.measure = e.measure),
    fits AS (SELECT doc_id, bool_and(coalesce(bucket <= q3 + {quality.FACTOR} * (q3 - q1 + 1) AND (l.measure NOT IN ({low}) OR bucket >= q1 - {quality.FACTOR} * (q3 - q1 + 1)), true)) AS fits
             FROM long l LEFT JOIN q ON l.lang IS NOT DISTINCT FROM q.lang AND l.source IS NOT DISTINCT FROM q.source AND l.measure = q.measure GROUP BY doc_id)
    SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({quality.BASE_FAILED}) AS base_failed, (NOT ({quality.BASE_FAILED}) AND fits) AS kept, n_lines
    FROM m JOIN fits USING (doc_id)"""


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


# DuckDB has no crc32: the table of its bytes' remainders is built by a recursive step over 8 bits
_CRC_TABLE = """tab AS (SELECT b, b AS c, 0 AS k FROM range(256) AS t(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
    crc AS (SELECT list(c ORDER BY b) AS t FROM tab WHERE k = 8)"""
# of an ASCII string, beside the row of crc
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split({0}, '') if x <> '']), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"


def _op3_sql() -> str:
    k1, k2 = (f"{k!r}::DOUBLE" for k in lm.K)
    return f"""
    WITH RECURSIVE {_CRC_TABLE},
    ids AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS s FROM (SELECT DISTINCT doc_id FROM documents)),
    held AS (SELECT doc_id, {_CRC.format('s')} % 7 = 2 AS held_out FROM ids CROSS JOIN crc),
    tok AS (SELECT doc_id, held_out, list_append({_WORDS.format(_LOWER.format("text"))}, chr(0)) AS w FROM documents JOIN held USING (doc_id)),
    flat AS (SELECT doc_id, held_out, w[i] AS t, CASE WHEN i = 1 THEN chr(1) ELSE w[i - 1] END AS h, CASE WHEN i = 2 THEN chr(1) WHEN i > 2 THEN w[i - 2] END AS g FROM tok, unnest(range(1, len(w) + 1)) AS u(i)),
    uni AS (SELECT t, count(*) AS c FROM flat WHERE NOT held_out GROUP BY t),
    bi AS (SELECT h, t, count(*) AS c2 FROM flat WHERE NOT held_out GROUP BY h, t),
    tri AS (SELECT g, h, t, count(*) AS c3 FROM flat WHERE NOT held_out AND g IS NOT NULL GROUP BY g, h, t),
    tot AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM uni),
    p AS (SELECT doc_id, held_out, coalesce(u.c, 0) AS c, (coalesce(u.c, 0) + 1)::DOUBLE / (n + v + 1) AS base, coalesce(bi.c2, 0) AS c2, coalesce(s.c, 0) AS ch, coalesce(c3, 0) AS c3, coalesce(gh.c2, 0) AS cgh, n
          FROM flat f CROSS JOIN tot LEFT JOIN uni u ON u.t = f.t LEFT JOIN uni s ON s.t = CASE WHEN f.h = chr(1) THEN chr(0) ELSE f.h END LEFT JOIN bi ON bi.h = f.h AND bi.t = f.t
          LEFT JOIN tri ON tri.g = f.g AND tri.h = f.h AND tri.t = f.t LEFT JOIN bi gh ON gh.h = f.g AND gh.t = f.h)
    SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, max(n) AS train_tokens, round(fsum(log10(base)), 6) AS base_score,
      round(fsum(log10((c3 + {k2} * (c2 + {k1} * base) / (ch + {k1})) / (cgh + {k2}))), 6) AS score
    FROM p GROUP BY doc_id, held_out"""


def _op5_sql() -> str:
    words = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT size FROM win),
    run AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(i) WHERE len(w) >= size),
    hit AS (SELECT doc_id, run.size, i, run.g FROM run WHERE (size, g) IN (SELECT (size, g) FROM win)),
    cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(size)) AS u(k) GROUP BY doc_id),
    its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit JOIN win USING (size, g) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""


_OP8_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
    o AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
      list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((strpos('0123456789abcdef', substr(x, (5 * i) // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(x, (5 * i) // 4 + 2, 1)) - 1) >> (3 - (5 * i) % 4)) & 31)::INT + 1, 1) for i in range(32)], 'string_agg', '') AS payload_digest,
      CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
    FROM o"""


def _op10_sql() -> str:
    # the driver's pages have no canonical or refresh links, so no class carries a verdict there
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = urlfilter._ordered(urlfilter.RULES)
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    return rf"""
    WITH u AS (SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict, false AS by_alias FROM u"""


def _op11_sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    # levels of a tree: every three nodes become one while several remain
    up = lambda name, first: f"""{name} AS ({first} UNION ALL
      SELECT g, depth + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, depth, i // 3, n)"""  # noqa: E731
    beside = lambda name: f"""(SELECT g, depth, i, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1 WINDOW run AS (PARTITION BY g, depth, i // 3 ORDER BY i))"""  # noqa: E731
    return f"""
    WITH RECURSIVE {_CRC_TABLE},
    d AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {leaf("text")} AS leaf, CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 2 = 0 AND text IS NOT NULL THEN {leaf("replace(text, chr(10), '')")} END AS changed FROM documents CROSS JOIN crc),
    own AS (SELECT *, row_number() OVER () AS u, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
    {up("node", "SELECT g, 0 AS depth, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM own")},
    sub AS (SELECT g, depth AS levels, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM node WHERE n = 1),
    {up("above", "SELECT '' AS g, 0 AS depth, i, subroot AS h, count(*) OVER () AS n FROM sub")},
    step AS (SELECT u, depth AS k, l, r FROM own JOIN {beside("node")} b ON own.g = b.g AND b.i = own.i // (3 ** depth)::BIGINT
      UNION ALL SELECT u, levels + depth, l, r FROM own JOIN sub USING (g) JOIN {beside("above")} b ON b.i = sub.i // (3 ** depth)::BIGINT),
    proof AS (SELECT u, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM step GROUP BY u),
    fold AS (SELECT u, 0 AS k, coalesce(changed, leaf) AS h FROM own UNION ALL SELECT u, k + 1, sha256(l || h || r) FROM fold JOIN step USING (u, k)),
    folded AS (SELECT u, max_by(h, k) AS folded_root FROM fold GROUP BY u)
    SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM own JOIN sub USING (g) JOIN folded USING (u) LEFT JOIN proof USING (u) CROSS JOIN (SELECT h AS root FROM above WHERE n = 1)"""


def _op13_sql() -> str:
    blanks = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    # states: 1 nothing yet, 2 after system, 3 after user, 4 after assistant; costs from a turn on, inserts included
    stays, made = "CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 ELSE (fault = 'truncated')::BIGINT END", "CASE s WHEN 3 THEN 4 ELSE 3 END"
    kept = lambda s: f"CASE WHEN x = 's' AND {s} = 1 THEN 2 WHEN x = 'u' AND {s} <> 3 THEN 3 WHEN x = 'a' AND {s} = 3 THEN 4 END"
    least = lambda s: f"least(3 + c[{s}], coalesce(c[{kept(s)}] + e, 1000000000), 2 + e + c[{4 if s == 3 else 3}])"
    return f"""
    WITH RECURSIVE {_CRC_TABLE},
    r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS f FROM conversations CROSS JOIN crc),
    d AS (SELECT coalesce('=' || conv_id, '') AS g, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM r, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE f <> 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY g) AS m, left(role, 1) AS x, rtrim(text, {blanks}) AS body FROM d),
    t AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
      lag(x) OVER (PARTITION BY g ORDER BY i) || x NOT IN ('su', 'ua', 'au') AS illegal FROM n),
    e AS (SELECT *, {stays} AS e FROM t),
    v AS (SELECT g, i + 1 AS i, [0, 4, 2, 0]::BIGINT[] AS c FROM e WHERE i = m
      UNION ALL SELECT g, i, [least(b1, 2 + b3, 4 + b4), least(b2, 2 + b3, 4 + b4), least(b3, 2 + b4), least(b4, 2 + b3)]
      FROM (SELECT g, e.i, {least(1)} AS b1, {least(2)} AS b2, {least(3)} AS b3, {least(4)} AS b4 FROM v JOIN e USING (g) WHERE e.i = v.i - 1)),
    w AS (SELECT g, 1::BIGINT AS i, 1 AS s, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT g FROM e)
      UNION ALL SELECT g, i + (letter <> 'I')::BIGINT, CASE letter WHEN 'D' THEN s WHEN 'K' THEN {kept("s")} ELSE {made} END, audit || letter,
        CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END || CASE letter WHEN 'R' THEN text ELSE '' END) END
      FROM (SELECT w.*, x, role, text, CASE WHEN e.i IS NULL THEN CASE WHEN h.c[s] > 0 THEN 'I' END WHEN 3 + a.c[s] = h.c[s] THEN 'D' WHEN 2 + h.c[{made}] = h.c[s] THEN 'I' WHEN e + a.c[{kept("s")}] = h.c[s] THEN 'K' ELSE 'R' END AS letter
        FROM w JOIN v h ON h.g = w.g AND h.i = w.i LEFT JOIN v a ON a.g = w.g AND a.i = w.i + 1 LEFT JOIN e ON e.g = w.g AND e.i = w.i) WHERE letter IS NOT NULL),
    best AS (SELECT g, max_by(audit, length(audit)) AS audit, max_by(lines, length(audit)) AS lines FROM w GROUP BY g),
    cnt AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM t GROUP BY g)
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.c[1], 0) AS cost,
      coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS g FROM conversations) LEFT JOIN cnt USING (g) LEFT JOIN best USING (g) LEFT JOIN v ON v.g = cnt.g AND v.i = 1"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op3_lm_scoring": _op3_sql(), "op5_decontamination": _op5_sql(), "op8_warc": _OP8_SQL, "op10_url_filters": _op10_sql(), "op11_merkle_manifest": _op11_sql(), "op13_conversation_repair": _op13_sql()}
