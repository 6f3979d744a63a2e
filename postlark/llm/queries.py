"""The thin queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as dec
from . import collocations, filter_audit, langid, neighbours, ngram_join, packing, quality, sharding, substring_dedup, toolcalls, url_filter, warc
from .shared import table, tokenizer


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, profiles, keep={"doc_id": F.col("doc_id"), "held_out": langid.held_out()})


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dec.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = dec.n_hit()
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n > 0).alias("contaminated"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pack(table(spark, sf_dir, "documents"), tokenizer())
    return cut.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.from_conversations(table(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, toolcalls.TURN_SCHEMAS).withColumn("errors", F.array_join("errors", "; "))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratios = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.resample(docs, ratios, keep={"doc_id": F.col("doc_id")})


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.Tree.even(40)
    out = sharding.layout(table(spark, sf_dir, "documents"), tree, [tree.growth()])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", F.col("grown0").alias("grown_shard"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_decontamination, op3_best_fit_packing, op4_chat_formatting, op5_url_filters, op6_quality_classifier, op7_ngram_jaccard_join,
        op8_nearest_neighbours, op9_warc, op10_substring_dedup, op11_phrase_collocations, op12_filter_audit, op13_sharding,
    )
}

#: DuckDB SQL for the queries that SQL can express on whole tables.
SQL: dict[str, str] = {
    "op4_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, conv_id || ':' || turn AS call_id, turn, role AS name, text FROM conversations WHERE role IS DISTINCT FROM 'assistant'),
cg AS (
  SELECT conv_id, call_id, turn, count(*) AS n_calls, min(name) AS name, min(text) AS text, count(DISTINCT name || chr(0) || coalesce(text, chr(0))) > 1 AS cd FROM c GROUP BY ALL),
r AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, turn, text AS content FROM conversations WHERE role = 'assistant'),
g AS (
  SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM c)),
i AS (
  SELECT conv_id, turn, count(*) FILTER (before IS NULL OR turn - before > 2) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM g),
lv AS (
  SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) - 1)::INT AS level FROM i),
rg AS (
  SELECT conv_id, call_id, min(turn) AS rturn, count(*) AS n_results, min(content) AS content, count(DISTINCT content) > 1 AS rd FROM r GROUP BY ALL)
SELECT coalesce(cg.conv_id, rg.conv_id) AS conv_id, coalesce(cg.call_id, rg.call_id) AS call_id, coalesce(turn, rturn) AS turn, name, coalesce(level, 0) AS level,
       coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
       CASE WHEN n_calls IS NULL THEN 'orphan' WHEN coalesce(cd, false) OR coalesce(rd, false) THEN 'ambiguous'
            WHEN text IS NULL OR name NOT IN ('user', 'system') THEN 'invalid' WHEN n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       CASE WHEN n_calls IS NULL THEN '' WHEN name NOT IN ('user', 'system') THEN 'unknown tool' WHEN text IS NULL THEN 'missing text' ELSE '' END AS errors,
       CASE WHEN n_calls IS NOT NULL THEN '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"text":' || to_json(text) || ',' END || '"turn":' || turn || '},"id":"' || cg.call_id || '","name":' || to_json(name)
         || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content) END || '}' END AS json
FROM (SELECT cg.*, level FROM cg LEFT JOIN lv USING (conv_id, turn)) cg FULL JOIN rg ON cg.conv_id = rg.conv_id AND cg.call_id = rg.call_id
""",
    "op5_url_filters": r"""
WITH u AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM u),
rules(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (
  SELECT page_id, arg_max(action, length(rhost || rpath)) AS action, arg_max(rhost || rpath, length(rhost || rpath)) AS rule
  FROM p JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id),
hits AS (
  SELECT page_id,
    list_aggregate(list_transform(['adult','casino','escort','porn','viagra','xxx'], lambda t: regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')::INT), 'sum')::INT AS n_strict,
    list_aggregate(list_transform(['ads','bet','bets','cheap','farm','free','pills','spam','track','win'], lambda t: regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')::INT), 'sum')::INT AS n_soft
  FROM p)
SELECT p.page_id, host, path, rule, coalesce(action, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM p LEFT JOIN fit USING (page_id) JOIN hits USING (page_id)
""",
    "op9_warc": r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM k
""",
    "op11_phrase_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE f >= 30),
cut AS (
  SELECT lang, phrase, f AS a, ws, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM often WHERE k > 1)),
s AS (
  SELECT cut.lang, cut.phrase, a, ws, j, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f + r.f))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp JOIN f r ON r.lang = cut.lang AND r.phrase = rp),
c AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
gone AS (
  SELECT DISTINCT c.lang, c.phrase FROM c JOIN (SELECT lang, f, unnest(list_transform(range(1, k + 1), lambda i: list_transform(range(i, k + 1), lambda e: array_to_string(ws[i:e], ' ')))) AS subs, phrase AS longer FROM often WHERE k > 2) q
    ON q.lang = c.lang AND list_contains(subs, c.phrase) AND longer <> c.phrase AND 100::HUGEINT * q.f >= 80::HUGEINT * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM c ANTI JOIN gone USING (lang, phrase) JOIN n USING (lang) QUALIFY rank <= 2000
""",
    "op12_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS lead FROM d),
lab AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(lead < doc_id, false)] AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN lab USING (doc_id)),
k AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
x AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
st AS (
  SELECT o, unnest(range(1, 6))::INT AS step FROM o),
e AS (
  SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, step, n, good, toxic, fails[o[step]] AS here, list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i])) IS TRUE AS before,
         len(list_filter(fails, lambda f: f)) AS many FROM k, st),
r AS (
  SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT here AND NOT before), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT before), 0) AS removed, coalesce(sum(n) FILTER (here AND before), 0) AS redundant,
         coalesce(sum(n) FILTER (here AND many = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (here AND NOT before), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT before), 0) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley FROM r
""",
    "op13_sharding": r"""
WITH RECURSIVE t AS (
  SELECT list(x ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM (SELECT unnest(range(256)) AS i))),
d AS (
  SELECT doc_id, coalesce(text, '') AS s, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
b AS (
  SELECT doc_id, size, list_transform(range(0, 2 * size, 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT) AS b FROM (SELECT doc_id, size, hex(encode(s)) AS h FROM d)),
c AS (
  SELECT doc_id, size + 16 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, z: xor(c >> 8, t[1 + (xor(c, z) & 255)])), 4294967295) AS text_crc32 FROM b, t),
tree AS (
  SELECT unnest(range(2)) AS child, 0 AS level, 0 AS node, 20.0 AS weight UNION ALL SELECT 2, 0, 0, 1.0
  UNION ALL SELECT unnest(range(8)), 1, unnest(range(8)) // 4, 5.0 UNION ALL SELECT unnest(range(40)), 2, unnest(range(40)) // 5, 1.0),
dr AS (
  SELECT doc_id, level, node, child, -ln((('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), level, child)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / weight::DOUBLE AS draw FROM (SELECT DISTINCT doc_id FROM documents), tree),
won AS (
  SELECT doc_id, level, node, arg_min(child, draw) FILTER (level > 0 OR child < 2) AS child, arg_min(child, draw) AS with_one_more FROM dr GROUP BY ALL),
sh AS (
  SELECT r.doc_id, s.child AS shard, CASE WHEN r.with_one_more = 2 THEN 40 ELSE s.child END AS grown_shard
  FROM won r JOIN won k ON k.doc_id IS NOT DISTINCT FROM r.doc_id AND k.level = 1 AND k.node = r.child JOIN won s ON s.doc_id IS NOT DISTINCT FROM r.doc_id AND s.level = 2 AND s.node = k.child WHERE r.level = 0)
SELECT c.doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', coalesce(c.doc_id::VARCHAR, ''), size, text_crc32, 0)), c.doc_id, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM c JOIN sh ON sh.doc_id IS NOT DISTINCT FROM c.doc_id
""",
}
