"""The queries over the archive, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlark.functions import text as T
from postlark.functions.embed import hash_embed
from postlark.operators import archive, maintain, search, semantic, sync
from postlark.plans import corpus
from postlark.plans.corpus import TOK, C, M
from postlark.sources import envelopes, provider
from postlark.sources.mail_files import html_to_text, read_mail, write_mailboxes
from postlark.streaming import changes as stream_changes
from postlark.streaming.ingest import Snapshots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
POLICY = ("spam", "promotions")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {M} SELECT doc_id, message_id, thread_id FROM m")
def ids_make_id(spark, d):
    return corpus.messages(spark, d).select("doc_id", "message_id", "thread_id")


_R = r"""one AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY ALL),
r AS (SELECT a.conv_id, a.turn, a.role, coalesce(a.text || chr(10) || chr(10) || 'On Tue, x wrote:' || chr(10) || '> ' || b.text, a.text, '') AS body, b.text AS said, a.text AS own,
  CASE WHEN a.turn > 0 THEN 'Re: FW:  ' ELSE '' END || ' Talk ' || a.conv_id AS subject
  FROM one a LEFT JOIN one b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"""


@query(f"WITH {_R} SELECT conv_id, turn, 'talk ' || conv_id AS normalized FROM r")
def subject_normalize(spark, d):
    return corpus.replies(spark, d).select("conv_id", "turn", T.normalize_subject(F.col("subject")).alias("normalized"))


@query(rf"""WITH {_R} SELECT conv_id, turn, regexp_replace(coalesce(own, ''), '^\s+|\s+$', '', 'g') AS latest,
CASE WHEN own IS NULL OR said IS NULL THEN '' ELSE regexp_replace('On Tue, x wrote:' || chr(10) || '> ' || said, '\s+$', '') END AS quoted FROM r""")
def quoted_split(spark, d):
    latest, quoted = T.split_quoted(F.col("body"))
    return corpus.replies(spark, d).select("conv_id", "turn", latest.alias("latest"), quoted.alias("quoted"))


@query(f"WITH {M.replace("coalesce(text, '') AS latest_text", "replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS latest_text")}, {C} SELECT chunk_id, message_id, section, ordinal, content_hash FROM c")
def chunk_split(spark, d):
    m = corpus.messages(spark, d).withColumn("latest_text", F.replace("latest_text", F.lit("\n"), F.lit("\n\n")))
    return archive.chunks(m).select("chunk_id", "message_id", "section", "ordinal", "content_hash")


@query(r"""SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE substr(t, greatest(strpos(lower(t), 'the') - 60, 1), 240) END AS snippet
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def snippet(spark, d):
    return corpus.read(spark, d, "documents").select("doc_id", T.snippet(F.coalesce("text", F.lit("")), "the").alias("snippet"))


@query()
def redact_text(spark, d):
    return corpus.read(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


@query(f"WITH {M} SELECT doc_id, array_to_string(categories, ',') AS categories FROM m")
def categories(spark, d):
    return corpus.messages(spark, d).select("doc_id", F.array_join("categories", ",").alias("categories"))


@query(f"WITH {M} SELECT doc_id, message_id FROM m WHERE len(categories) = 0")
def exclusion_filter(spark, d):
    return corpus.messages(spark, d).where(~archive.excluded(F.col("categories"), POLICY)).select("doc_id", "message_id")


@query(f"WITH {M} SELECT reason, count(*) AS n FROM (SELECT unnest(categories) AS reason FROM m) GROUP BY reason")
def excluded_by_reason(spark, d):
    return archive.excluded_by_reason(corpus.messages(spark, d), POLICY)


def _two(spark, d):
    """An archive and a later sync that overlap: a sixth is new, a seventh changed."""
    m = corpus.messages(spark, d)
    old = m.where("doc_id % 6 != 0")
    new = m.where("doc_id % 5 != 0").withColumn("normalized_hash", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("latest_text", F.lit("!")), 256)).otherwise(F.col("normalized_hash")))
    return old, new


_CH = f"""{M}, n AS (SELECT *, CASE WHEN doc_id % 6 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM m WHERE doc_id % 5 <> 0)"""


@query(f"WITH {_CH} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'unchanged') AS unchanged FROM n")
def sync_added_updated_unchanged(spark, d):
    return archive.changes(archive.diff(*_two(spark, d)))


@query(f"WITH {_CH} SELECT count(DISTINCT thread_id) AS touched_threads FROM n WHERE change <> 'unchanged'")
def touched_threads(spark, d):
    return archive.diff(*_two(spark, d)).where("change != 'unchanged'").agg(F.countDistinct("thread_id").alias("touched_threads"))


@query(f"""WITH {M} SELECT message_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN sha256(latest_text || '!') ELSE normalized_hash END AS normalized_hash
FROM m WHERE doc_id % 6 <> 0 OR doc_id % 5 <> 0""")
def sync_merge_snapshot(spark, d):
    return archive.merge(*_two(spark, d), ["message_id"]).select("message_id", "normalized_hash")


@query(f"WITH {M}, {C} SELECT chunk_id FROM c WHERE message_id NOT IN (SELECT message_id FROM m WHERE doc_id % 6 <> 0)")
def sync_delete_cascade(spark, d):
    return archive.remove(corpus.chunks(spark, d), _two(spark, d)[0], ["message_id"]).select("chunk_id")


_FW = f"WITH {M} SELECT doc_id, mailbox, normalized_hash FROM (SELECT *, min(doc_id) OVER (PARTITION BY mailbox, normalized_hash) AS lead FROM m) WHERE doc_id "


@query(_FW + "= lead")
def dedup_first_wins(spark, d):
    return archive.first_wins(corpus.messages(spark, d).select("doc_id", "mailbox", "normalized_hash"), ["mailbox", "normalized_hash"], ["doc_id"]).where("first").drop("first")


@query(_FW + "<> lead")
def duplicates_list(spark, d):
    return archive.first_wins(corpus.messages(spark, d).select("doc_id", "mailbox", "normalized_hash"), ["mailbox", "normalized_hash"], ["doc_id"]).where("NOT first").drop("first")


@query(f"""WITH {M}, l AS (SELECT mailbox || '/' || (doc_id % 50) AS rel_path, normalized_hash AS provider_key, doc_id FROM m),
g AS (SELECT DISTINCT rel_path FROM l WHERE rel_path NOT IN (SELECT rel_path FROM l WHERE doc_id % 50 < 30) AND NOT starts_with(rel_path, 'fr/'))
SELECT DISTINCT provider_key FROM l WHERE rel_path IN (FROM g) AND provider_key NOT IN (SELECT provider_key FROM l WHERE rel_path NOT IN (FROM g))""")
def reconcile_released(spark, d):
    links = corpus.messages(spark, d).select(F.concat_ws("/", "mailbox", (F.col("doc_id") % 50).cast("string")).alias("rel_path"), F.col("normalized_hash").alias("provider_key"), "doc_id")
    stored = links.select("rel_path").distinct()
    return archive.released(stored, links.where("doc_id % 50 < 30").select("rel_path"), ["fr"], links.select("rel_path", "provider_key"))


_LOOK = f"""{M}, l AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS root_key, mailbox || '/' || (doc_id % 50) AS rel_path, doc_id % 50 AS num, doc_id % 4 <> 0 OR doc_id % 50 % 6 = 4 AS still, 'k' || (doc_id % 300) AS provider_key FROM m)"""


def _look(spark, d):
    """Documents as links of fifty files a mailbox, in two roots, and one look at root a; a third of its files is complete, partial or unreadable."""
    doc, num = F.col("doc_id"), F.col("doc_id") % 50
    path = F.concat_ws("/", "mailbox", num.cast("string"))
    links = corpus.messages(spark, d).select(F.when(doc % 2 == 0, "a").otherwise("b").alias("root_key"), path.alias("rel_path"), num.alias("num"), ((doc % 4 != 0) | (num % 6 == 4)).alias("still"), F.concat(F.lit("k"), (doc % 300).cast("string")).alias("provider_key"))
    status = F.when(F.col("num") % 3 == 0, "complete").when(F.col("num") % 3 == 1, "partial").otherwise("unreadable")
    keys = F.collect_set(F.when(F.col("still") & (status != "unreadable"), F.col("provider_key")))
    files = links.where("root_key = 'a' AND num < 30").groupBy("root_key", "rel_path", "num").agg(keys.alias("keys")).withColumn("status", status)
    failed = F.when(F.col("status") == "complete", F.array().cast("array<string>")).otherwise(F.array("rel_path"))
    files = files.select("root_key", "rel_path", F.lit(1).cast("long").alias("size"), F.lit(1.0).alias("mtime_ms"), F.lit(True).alias("changed"), "status", failed.alias("failures"), failed.alias("failed_entries"), "keys")
    links = links.select("root_key", "rel_path", "provider_key").distinct()
    known = links.select("root_key", "rel_path").distinct().select("*", F.lit("me").alias("account_id"), F.lit(1).cast("long").alias("size"), F.lit(1.0).alias("mtime_ms"), F.lit("").alias("policy"), *(F.array().cast("array<string>").alias(c) for c in ("failures", "failed_entries")))
    roots = spark.createDataFrame([("a", "me"), ("b", "me")], "root_key string, account_id string")
    return sync.Held(links, known, roots), files


@query(f"""WITH {_LOOK}, gone AS (SELECT DISTINCT root_key, rel_path FROM l WHERE root_key = 'a' AND num >= 30 AND NOT starts_with(rel_path, 'fr/')),
cur AS (SELECT DISTINCT root_key, rel_path, provider_key FROM l WHERE root_key = 'a' AND num < 30 AND still AND num % 3 <> 2), held AS (SELECT DISTINCT root_key, rel_path, num, provider_key FROM l ANTI JOIN gone USING (root_key, rel_path)),
lacking AS (SELECT DISTINCT root_key, rel_path FROM held ANTI JOIN cur USING (root_key, rel_path, provider_key) WHERE root_key = 'a' AND num < 30 AND num % 3 = 1),
repl AS (SELECT DISTINCT root_key, rel_path FROM l WHERE root_key = 'a' AND num < 30 AND num % 3 <> 2 EXCEPT SELECT * FROM lacking),
after AS (SELECT root_key, rel_path, provider_key FROM held ANTI JOIN repl USING (root_key, rel_path) UNION SELECT * FROM cur),
lost AS (SELECT provider_key FROM l SEMI JOIN gone USING (root_key, rel_path) UNION SELECT provider_key FROM held SEMI JOIN repl USING (root_key, rel_path))
SELECT 'link' AS kind, root_key, rel_path, provider_key FROM after UNION ALL SELECT 'released', NULL, NULL, provider_key FROM lost ANTI JOIN after USING (provider_key)""")
def reconcile_look(spark, d):
    """Links and released keys after a look with partial and unreadable files and a folder that could not be listed."""
    held, files = _look(spark, d)
    after, released = sync.reconcile(held, sync.Scan("me", ["a"], files, spark.createDataFrame([("a", "fr")], "root_key string, rel_path string")), "")
    return after.links.select(F.lit("link").alias("kind"), "root_key", "rel_path", "provider_key").unionByName(released.select(F.lit("released").alias("kind"), *(F.lit(None).cast("string").alias(c) for c in ("root_key", "rel_path")), "provider_key"))


@query(f"""WITH {_LOOK}, after AS (SELECT DISTINCT rel_path, provider_key FROM l WHERE root_key = 'a' AND num < 30 AND still AND num % 3 = 0)
SELECT DISTINCT provider_key FROM l ANTI JOIN after USING (provider_key)""")
def reconcile_authoritative(spark, d):
    """What a look at one root releases that found complete files alone and counts for the whole account."""
    held, files = _look(spark, d)
    nothing = spark.createDataFrame([], "root_key string, rel_path string")
    return sync.reconcile(held, sync.Scan("me", ["a"], files.where("status = 'complete'"), nothing, authoritative=True), "")[1]


@query(f"""WITH {M}, b AS (SELECT normalized_hash AS provider_key, message_id FROM m)
SELECT 'duplicate provider_key' AS violation, provider_key AS value, count(*) AS n FROM b GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'duplicate message_id', message_id, count(*) FROM b GROUP BY 2 HAVING count(*) > 1""")
def identity_violations(spark, d):
    return archive.identity_violations(corpus.messages(spark, d).select(F.col("normalized_hash").alias("provider_key"), "message_id"))


@query(f"""WITH {M}, {C}, h AS (SELECT sha256(chunk_id || chr(0) || content_hash) AS h FROM c)
SELECT sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 15))::BIGINT)::HUGEINT || ':' || sum(('0x' || substr(h, 16, 15))::BIGINT)::HUGEINT || ':' || sum(('0x' || substr(h, 31, 15))::BIGINT)::HUGEINT || ':' || sum(('0x' || substr(h, 46, 15))::BIGINT)::HUGEINT) AS archive_revision FROM h""")
def archive_revision(spark, d):
    return archive.revision(corpus.chunks(spark, d))


@query(rf"""WITH {corpus.S} SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(t, '[\x{{ac00}}-\x{{d7a3}}]') THEN 'ko' END, CASE WHEN regexp_matches(t, '[\x{{3040}}-\x{{30ff}}]') THEN 'ja' END,
CASE WHEN regexp_matches(t, '[\x{{4e00}}-\x{{9fff}}]') THEN 'zh' END, CASE WHEN regexp_matches(t, '[\x{{0600}}-\x{{06ff}}]') THEN 'ar' END], lambda x: x IS NOT NULL), ',') AS langs FROM s""")
def lang_detect(spark, d):
    return corpus.scripted(spark, d).select("doc_id", F.array_join(T.languages(F.col("t")), ",").alias("langs"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+'), ' ') AS tokens FROM documents")
def tokenize_unicode(spark, d):
    return corpus.read(spark, d, "documents").select("doc_id", F.array_join(T.tokens(F.coalesce("text", F.lit(""))), " ").alias("tokens"))


@query(rf"""WITH {corpus.S} SELECT doc_id, array_to_string(list_filter(flatten([[w, regexp_replace(w, '^(?:وال|فال|بال|كال|ال|لل|و|ف|ب|ك|ل)', '')] FOR w IN regexp_extract_all(lower(t), '[\x{{0600}}-\x{{06ff}}]+')]), lambda x: x <> ''), ' ') AS tokens FROM s""")
def tokenize_arabic(spark, d):
    return corpus.scripted(spark, d).select("doc_id", F.array_join(T.tokens_arabic(F.col("t")), " ").alias("tokens"))


@query(f"WITH {M}, {C}, {TOK} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM tok GROUP BY term")
def postings_stats(spark, d):
    return corpus.index(spark, d).of_list("all").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {M}, {C}, {TOK} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark, d):
    return corpus.index(spark, d).stats.where("lang = 'all'").select("n", F.round("avgdl", 6).alias("avgdl"))


def _bm25(spark, d, text, k=10, filters=None):
    return corpus.index(spark, d).top("all", search.phrases(spark, text), k, filters)


def _bm25_sql(phrases: list[list[str]], k: int = 10, where: str = "true") -> str:
    """WITH parts up to best(chunk_id, score, rank)."""
    tfs = " UNION ALL ".join(
        f"SELECT {n} AS phrase, t0.chunk_id, t0.dl, count(*) AS tf FROM tok t0 " + " ".join(f"JOIN tok t{i} ON t{i}.chunk_id = t0.chunk_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(p) if i) + f" WHERE t0.term = '{p[0]}' GROUP BY 2, 3"
        for n, p in enumerate(phrases)
    )
    return f"""{M}, {C}, {TOK}, tfs AS ({tfs}),
dfs AS (SELECT phrase, count(*) AS df FROM tfs GROUP BY phrase),
sc AS (SELECT chunk_id, sum(CASE WHEN df < n / 2.0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tfs JOIN dfs USING (phrase), st GROUP BY chunk_id HAVING count(*) = {len(phrases)}),
best AS (SELECT chunk_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc JOIN c USING (chunk_id) JOIN m USING (message_id) WHERE {where} QUALIFY rank <= {k})"""


_BEST = " SELECT chunk_id, round(score, 6) AS score, rank FROM best"


def _bm25_query(name: str, text: str, phrases: list[list[str]], filters=None, where: str = "true") -> None:
    def f(spark, d):
        return _bm25(spark, d, text, 10, filters).select("chunk_id", F.round("score", 6).alias("score"), "rank")

    f.__name__ = name
    query("WITH " + _bm25_sql(phrases, 10, where) + _BEST)(f)


_bm25_query("bm25_single", "thon", [["thon"]])
_bm25_query("bm25_and", "thon ther", [["thon"], ["ther"]])
_bm25_query("bm25_phrase", "of-the", [["of", "the"]])
_bm25_query("bm25_floor", "a", [["a"]])
for _n, _f, _w in (
    ("account", search.Filters(account="src3"), "m.account_id = 'src3'"),
    ("mailbox", search.Filters(mailbox="en"), "m.mailbox = 'en'"),
    ("from", search.Filters(sender="EN@example.com"), "from_address = 'en@example.com'"),
    ("to", search.Filters(to="SRC3@example.com"), "list_contains(to_addresses, 'src3@example.com')"),
    ("dates", search.Filters(after="2024-01-01T01", before="2024-01-01T09"), "date >= '2024-01-01T01' AND date <= '2024-01-01T09'"),
):
    _bm25_query(f"bm25_filtered_{_n}", "thon", [["thon"]], _f, _w)


@query(
    "WITH "
    + _bm25_sql([["thon"], ["ther"]], 20)
    + r""" SELECT chunk_id, c.message_id, c.account_id, c.mailbox, subject, from_address, date,
CASE WHEN length(c.text) <= 240 THEN c.text ELSE substr(c.text, greatest(strpos(lower(c.text), 'thon ther') - 60, 1), 240) END AS snippet, round(1.0 / (60 + rank), 6) AS score, rank
FROM best JOIN c USING (chunk_id) JOIN m USING (message_id) WHERE rank <= 10"""
)
def search_bm25_rrf(spark, d):
    out = corpus.index(spark, d).search("thon ther", 10)
    return out.select("chunk_id", "message_id", "account_id", "mailbox", "subject", "from_address", "date", "snippet", F.round("score", 6).alias("score"), "rank")


_COS = "v AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings WHERE %s)"


def _cosine(spark, d, k, where="true"):
    e = corpus.read(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    return search.cosine_top(e.where(where), q[0] if q else [], k, "vec_id", "embedding")


_VTOP = " SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank FROM v QUALIFY rank <= 10"


@query("WITH " + _COS % "true" + _VTOP)
def vector_topk(spark, d):
    return _cosine(spark, d, 10).select("vec_id", F.round("score", 6).alias("score"), "rank")


@query("WITH " + _COS % "label < 5" + _VTOP)
def vector_topk_filtered(spark, d):
    return _cosine(spark, d, 10, "label < 5").select("vec_id", F.round("score", 6).alias("score"), "rank")


_V = f"{M}, {C}, vec AS (SELECT chunk_id, CASE WHEN ordinal % 3 = 0 THEN content_hash ELSE 'old' END AS content_hash FROM c WHERE mailbox <> 'fr' UNION ALL SELECT 'gone', 'x')"


def _vectors(c):
    held = c.where("mailbox != 'fr'").select("chunk_id", F.when(F.col("ordinal") % 3 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"))
    return held.unionByName(c.sparkSession.createDataFrame([("gone", "x")], "chunk_id string, content_hash string"))


@query(f"WITH {_V} SELECT chunk_id FROM c SEMI JOIN vec USING (chunk_id, content_hash)")
def embed_reuse_split(spark, d):
    c = corpus.chunks(spark, d)
    return archive.reused(c, _vectors(c)).select("chunk_id")


@query(f"WITH {_V} SELECT chunk_id FROM c ANTI JOIN vec USING (chunk_id, content_hash)")
def queue_backlog(spark, d):
    c = corpus.chunks(spark, d)
    return archive.to_embed(c, _vectors(c)).select("chunk_id")


@query(f"WITH {_V} SELECT chunk_id FROM vec ANTI JOIN c USING (chunk_id)")
def vector_orphans(spark, d):
    c = corpus.chunks(spark, d)
    return archive.orphans(_vectors(c), c).select("chunk_id")


_LONGEST = "(SELECT thread_id FROM m GROUP BY thread_id ORDER BY count(*) DESC, thread_id LIMIT 1)"


def _longest(m: DataFrame) -> str | None:
    row = m.groupBy("thread_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "thread_id").first()
    return row and row.thread_id


@query(f"WITH {corpus.TURNS} SELECT message_id, date FROM m WHERE thread_id = {_LONGEST}")
def thread_messages(spark, d):
    m = corpus.turns(spark, d)
    return archive.thread(m, _longest(m)).select("message_id", "date")


@query(f"""WITH {corpus.TURNS}, t AS (SELECT *, row_number() OVER (ORDER BY date, message_id) AS i FROM m WHERE thread_id = {_LONGEST})
SELECT message_id, CASE WHEN i < 2 THEN 'previous' WHEN i = 2 THEN 'current' ELSE 'next' END AS place FROM t""")
def thread_context(spark, d):
    """The longest conversation around its second message."""
    m = corpus.turns(spark, d)
    longest = _longest(m)
    second = archive.thread(m, longest).limit(2).agg(F.max(F.struct("date", "message_id"))["message_id"]).first()[0]
    return archive.thread_context(m, longest, second).select("message_id", "place")


@query(f"""WITH {M}, {C} SELECT chunk_id, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id FROM c
WINDOW w AS (PARTITION BY thread_id ORDER BY started_at, message_id, section, ordinal, chunk_id)""")
def chunk_context(spark, d):
    return archive.chunk_context(corpus.chunks(spark, d), corpus.folder(spark, "context")).select("chunk_id", "previous_id", "next_id")


@query(f"WITH {_V} SELECT (SELECT count(*) FROM m) AS messages, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM c ANTI JOIN vec USING (chunk_id, content_hash)) AS backlog")
def status_counts(spark, d):
    c = corpus.chunks(spark, d)
    counts = [corpus.messages(spark, d).agg(F.count("*").alias("messages")), c.agg(F.count("*").alias("chunks")), archive.to_embed(c, _vectors(c)).agg(F.count("*").alias("backlog"))]
    return counts[0].join(counts[1]).join(counts[2])  # one row each


@query(f"""WITH {_V} SELECT chunk_id, 'reuse' AS action FROM c SEMI JOIN vec USING (chunk_id, content_hash)
UNION ALL SELECT chunk_id, 'embed' FROM c ANTI JOIN vec USING (chunk_id, content_hash)""")
def semantic_index_plan(spark, d):
    """What an index of vectors takes over and what it embeds."""
    c = corpus.chunks(spark, d)
    kept, missing = maintain.to_index(c, _vectors(c))
    return kept.select("chunk_id", F.lit("reuse").alias("action")).unionByName(missing.select("chunk_id", F.lit("embed").alias("action")))


@query(f"""WITH {_V}, n AS (SELECT (SELECT count(*) FROM vec) AS stored, (SELECT count(*) FROM c SEMI JOIN vec USING (chunk_id, content_hash)) AS complete, (SELECT count(*) FROM c) AS chunks)
SELECT 'no identity' AS kind, 'rebuild-required' AS status, stored, complete, chunks - complete AS backlog FROM n
UNION ALL SELECT 'other embedder', 'rebuild-required', stored, complete, chunks - complete FROM n
UNION ALL SELECT 'some', CASE WHEN chunks > complete THEN 'interrupted' WHEN stored <> complete THEN 'corrupt' ELSE 'healthy' END, stored, complete, chunks - complete FROM n
UNION ALL SELECT 'all, and one more', 'corrupt', chunks + 1, chunks, 0 FROM n
UNION ALL SELECT 'all', 'healthy', chunks, chunks, 0 FROM n
UNION ALL SELECT 'all, older revision', 'stale', chunks, chunks, 0 FROM n""")
def semantic_health(spark, d):
    kept = Snapshots(spark, corpus.folder(spark, "health"))
    c = kept.staged(corpus.chunks(spark, d).select("chunk_id", "content_hash", "ordinal", "mailbox"))  # texts are cut once, not for each case
    some, every = _vectors(c), c.select("chunk_id", "content_hash")
    mine, other = semantic.Identity("mock", "hash", 128, "r1"), semantic.Identity("mock", "hash", 64)
    cases = {
        "no identity": (some, None, "r1"), "other embedder": (some, other, "r1"), "some": (some, mine, "r1"),
        "all, and one more": (every.unionByName(some.where("chunk_id = 'gone'")), mine, "r1"), "all": (every, mine, "r1"), "all, older revision": (every, mine, "r2"),
    }
    rows = [semantic.health(c, v, held, mine, revision).withColumn("kind", F.lit(kind)) for kind, (v, held, revision) in cases.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query(f"WITH {M}, {C} SELECT chunk_id, thread_id, len(content_hash) AS n FROM c WHERE ordinal % 2 = 0 AND mailbox <> 'fr'")
def import_vectors(spark, d):
    """Older vectors: those of odd ordinals are of other content, those of one mailbox are no JSON."""
    c = corpus.chunks(spark, d)
    older = c.select("chunk_id", F.when(F.col("ordinal") % 2 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"), F.when(F.col("mailbox") == "fr", "[1,").otherwise("[0.5, 1]").alias("vector"))
    return semantic.import_vectors(older, c).select("chunk_id", "thread_id", F.length("content_hash").alias("n"))


@query(rf"""WITH {corpus.S}, tok AS (
  SELECT 'all' AS l, doc_id, regexp_extract_all(strip_accents(lower(t)), '[\p{{L}}\p{{N}}]+') AS ts FROM s
  UNION ALL SELECT 'ko', doc_id, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') FROM s WHERE regexp_matches(t, '[\x{{ac00}}-\x{{d7a3}}]')),
st AS (SELECT l, count(*) AS n, avg(len(ts)) AS avgdl FROM tok GROUP BY l),
hit AS (SELECT l, doc_id, len(ts) AS dl, len(list_filter(ts, lambda x: x = '계약')) AS tf FROM tok WHERE list_contains(ts, '계약')),
df AS (SELECT l, count(*) AS df FROM hit GROUP BY l),
sc AS (SELECT l, 'doc-' || doc_id AS chunk_id, CASE WHEN df < n / 2.0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM hit JOIN st USING (l) JOIN df USING (l)),
lists AS (SELECT chunk_id, row_number() OVER (PARTITION BY l ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 20),
f AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM lists GROUP BY chunk_id)
SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10""")
def multilingual_rrf(spark, d):
    """Documents with words in other scripts: the list for all scripts and the Korean one, fused."""
    texts = corpus.scripted(spark, d).select(F.concat(F.lit("doc-"), "doc_id").alias("chunk_id"), F.col("t").alias("text"))
    held = texts.withColumns({c: F.lit("") for c in search.SHOWN if c != "to_addresses"} | {"to_addresses": F.array(F.lit("")), "content_hash": F.lit("")})
    path = corpus.folder(spark, "index")
    search.Index.write(held, path, ("text",))
    return search.Index.read(spark, path).keyword("계약", 10).select("chunk_id", F.round("score", 6).alias("score"), "rank")


#: A sentence in another script behind each text of a language, and how many tokens its analyzer makes of it.
SENTENCES = {"en": ("请确认合同更新条件", 8), "de": ("契約の更新を確認してください", 13), "es": ("تجديد العقد", 4)}


def _sentence_sql(word: str, langs: tuple[str, ...], within: tuple[str, ...]) -> str:
    """SQL of a search for one word of two characters or more in the lists of langs; documents in `within` hold it."""
    sentence = " ".join(f"WHEN '{k}' THEN '{v}'" for k, (v, _) in SENTENCES.items())
    tokens = " ".join(f"WHEN '{k}' THEN {n}" for k, (_, n) in SENTENCES.items())
    scripts = {"zh": ("en", "de"), "ja": ("de",), "ar": ("es",)}
    lists = " UNION ALL ".join(f"SELECT '{x}' AS l, doc_id, lang, {'n' if x == 'ar' else f'CASE WHEN lang IN {within!r} OR lang IN {scripts[x]!r} THEN words + n END'} AS dl FROM d WHERE lang IN {scripts[x] + ('-',)!r}" for x in langs)
    return rf"""WITH d AS (SELECT doc_id, lang, CASE lang {tokens} ELSE 0 END AS n, len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+')) AS words, CASE lang {sentence} ELSE '' END AS tail FROM documents),
tok AS ({lists}),
st AS (SELECT l, count(*) AS n, avg(dl) AS avgdl FROM tok GROUP BY l),
hit AS (SELECT * FROM tok WHERE lang IN {within + ('-',)!r}),
df AS (SELECT l, count(*) AS df FROM hit GROUP BY l),
sc AS (SELECT l, 'doc-' || doc_id AS chunk_id, CASE WHEN df < n / 2.0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM hit JOIN st USING (l) JOIN df USING (l)),
lists AS (SELECT chunk_id, row_number() OVER (PARTITION BY l ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 20),
f AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM lists GROUP BY chunk_id)
SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10"""


def _sentence_query(name: str, word: str, langs: tuple[str, ...], within: tuple[str, ...]) -> None:
    def f(spark, d):
        tail = F.coalesce(*(F.when(F.col("lang") == k, v) for k, (v, _) in SENTENCES.items()), F.lit(""))
        texts = corpus.read(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("chunk_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), tail).alias("text"))
        held = texts.withColumns({c: F.lit("") for c in search.SHOWN if c != "to_addresses"} | {"to_addresses": F.array(F.lit("")), "content_hash": F.lit("")})
        path = corpus.folder(spark, "index")
        search.Index.write(held, path, ("text",))
        return search.Index.read(spark, path).keyword(word, 10).select("chunk_id", F.round("score", 6).alias("score"), "rank")

    f.__name__ = name
    query(_sentence_sql(word, langs, within))(f)


_sentence_query("search_chinese", "合同", ("zh",), ("en",))
_sentence_query("search_arabic", "عقد", ("ar",), ("es",))
_sentence_query("search_japanese", "契約の更新", ("ja", "zh"), ("de",))


@query("WITH " + M + ", " + C + ", " + _COS % "true" + r""", near AS (SELECT chunk_id, round(v.score, 6) AS score, row_number() OVER (ORDER BY round(v.score, 9) DESC, chunk_id) AS rank
FROM v JOIN m ON m.doc_id = v.vec_id JOIN c USING (message_id) WHERE v.score IS NOT NULL AND m.mailbox = 'en' AND date >= '2024-01-01T01' QUALIFY rank <= 10) SELECT * FROM near""")
def semantic_filtered(spark, d):
    """Nearest chunks by the vector of their document, of one mailbox and from a date on."""
    e = corpus.read(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    index, m = corpus.index(spark, d), corpus.messages(spark, d).select("message_id", F.col("doc_id").alias("vec_id"))
    owners = index.entries.select("chunk_id", "content_hash", "message_id").join(m, "message_id").join(e, "vec_id").select("chunk_id", "content_hash", F.col("embedding").alias("vector"))
    return index.semantic(q[0] if q else [], owners, 10, search.Filters(mailbox="en", after="2024-01-01T01")).select("chunk_id", F.round("score", 6).alias("score"), "rank")


@query("""SELECT event_id, user_id::VARCHAR AS provider_key FROM events WHERE event_id % 3 <> 0""")
def envelopes_to_read(spark, d):
    """Events as a provider's envelopes; every third was read before, under the same policy."""
    e = corpus.read(spark, d, "events")
    listed = envelopes.messages(e.select("event_id", F.to_json(F.struct(F.col("user_id").alias("id"), "event_id")).alias("value")), "a", "INBOX")
    return envelopes.to_read(listed, listed.where("event_id % 3 = 0").withColumn("policy", F.lit("spam")), "spam").select("event_id", "provider_key")


@query("SELECT event_id, user_id::VARCHAR AS provider_key FROM events UNION ALL SELECT event_id, 'e' || event_id FROM events")
def envelope_pages(spark, d):
    """Each event as a page of two envelopes, in a list or below a name."""
    one = lambda v: F.struct(v.cast("string").alias("id"))
    pair = F.array(one(F.col("user_id")), one(F.concat(F.lit("e"), "event_id")))
    page = F.when(F.col("event_id") % 2 == 0, F.to_json(pair)).otherwise(F.to_json(F.struct(pair.alias("envelopes"))))
    pages = corpus.read(spark, d, "events").select("event_id", page.alias("value"))
    return envelopes.messages(envelopes.unpack(pages), "a", "INBOX").select("event_id", "provider_key")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def events_incremental(spark, d):
    e = corpus.read(spark, d, "events")
    return e.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@query()
def hash_embeddings(spark, d):
    return corpus.read(spark, d, "documents").select("doc_id", hash_embed("text").alias("vector"))


@query()
def html_pages_text(spark, d):
    return corpus.read(spark, d, "pages").select("page_id", html_to_text("html").alias("text"))


#: All chunks of a document stand for the embedding with the same id.
@query(
    "WITH "
    + _bm25_sql([["thon"]], 20)
    + ", "
    + _COS % "true"
    + r""", near AS (SELECT chunk_id, row_number() OVER (ORDER BY round(v.score, 9) DESC, chunk_id) AS rank FROM v JOIN m ON m.doc_id = v.vec_id JOIN c USING (message_id) WHERE v.score IS NOT NULL QUALIFY rank <= 20),
lists AS (SELECT chunk_id, rank FROM best UNION ALL SELECT chunk_id, rank FROM near),
f AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM lists GROUP BY chunk_id)
SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10"""
)
def hybrid_rrf(spark, d):
    e = corpus.read(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    index, m = corpus.index(spark, d), corpus.messages(spark, d).select("message_id", F.col("doc_id").alias("vec_id"))
    owners = index.entries.select("chunk_id", "content_hash", "message_id").join(m, "message_id").join(e, "vec_id")
    out = index.search("thon", 10, "hybrid", vectors=owners.select("chunk_id", "content_hash", F.col("embedding").alias("vector")), embed=lambda _: q[0] if q else [])
    return out.select("chunk_id", F.round("score", 6).alias("score"), "rank")


_LIST = "CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END"


@query(f"WITH {M} SELECT message_id || ':' || i AS attachment_id, message_id, 'file' || i AS name FROM m, LATERAL (SELECT unnest(range({_LIST})) AS i)")
def attachments_list(spark, d):
    m = corpus.messages(spark, d)
    files = F.transform(F.sequence(F.lit(0), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)), lambda i: F.struct(F.concat(F.lit("file"), i).alias("name"), *(F.lit(None).cast(t).alias(n) for n, t in (("mimeType", "string"), ("size", "long"), ("text", "string"), ("contentHash", "string")))))
    return sync.list_attachments(sync.attachments(m.withColumn("attachments", files))).select("attachment_id", "message_id", "name")


@query(f"""WITH {M}, ok AS (SELECT * FROM m WHERE len(categories) = 0), n AS (SELECT *, CASE WHEN doc_id % 6 = 0 THEN 'added' WHEN doc_id % 7 = 0 AND trim(latest_text, chr(9) || chr(10) || chr(13) || ' ') <> '' THEN 'updated' ELSE 'unchanged' END AS change FROM ok WHERE doc_id % 5 <> 0)
SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'unchanged') AS unchanged, 0 AS deleted, (SELECT count(*) FROM m WHERE len(categories) > 0 AND doc_id % 5 <> 0) AS excluded,
count(DISTINCT thread_id) FILTER (change <> 'unchanged') AS touched_threads, (SELECT count(*) FILTER (list_contains(categories, 'spam')) FROM m WHERE doc_id % 5 <> 0) AS spam FROM n""")
def sync_report(spark, d):
    """Two syncs of the documents as messages; the second one's counters."""
    out = _synced_twice(spark, d)[1]
    return out.select("added", "updated", "unchanged", "deleted", "excluded", "touched_threads", F.coalesce(F.col("excluded_by_reason")["spam"], F.lit(0)).alias("spam"))


_SYNCED: dict[tuple[str, ...], tuple[Snapshots, DataFrame, int]] = {}


def _synced_twice(spark, d):
    """The archive, the second report and the version of two syncs of documents as messages: a sixth comes new, a seventh changed, the second without a fifth."""
    m = corpus.messages(spark, d)
    key = corpus.state(spark, d, "documents", "labels")
    if key in _SYNCED:
        return _SYNCED[key]
    nothing = F.lit(None).cast("string")
    body = F.col("latest_text")
    mail = lambda rows, text: rows.select(F.col("account_id").alias("accountId"), "mailbox", F.col("provider_key").alias("providerKey"), *(nothing.alias(c) for c in ("messageId", "threadId", "inReplyTo", "html", "rawMime", "sourceHash")), "subject", F.col("from_address").alias("from"), F.col("to_addresses").alias("to"), "date", text.alias("text"), "classifications", *(F.lit(None).cast("array<string>").alias(c) for c in ("cc", "labels", "flags")), F.lit(None).cast(envelopes.ATTACHMENTS).alias("attachments"))
    into = Snapshots(spark, corpus.folder(spark, "sync"), buckets=8)
    sync.sync(into, mail(m.where("doc_id % 6 != 0"), body))
    changed = F.when((F.col("doc_id") % 7 == 0) & (T.trim(body) != ""), F.concat(body, F.lit("!\n\nrenewed thon"))).otherwise(body)
    report = sync.sync(into, mail(m.where("doc_id % 5 != 0"), changed))
    _SYNCED[key] = into, report, into.version()
    return _SYNCED[key]


_RENEWED = M.replace("coalesce(text, '') AS latest_text", "coalesce(text, '') || CASE WHEN d.doc_id % 5 <> 0 AND d.doc_id % 7 = 0 AND trim(coalesce(text, ''), chr(9) || chr(10) || chr(13) || ' ') <> '' THEN '!' || chr(10) || chr(10) || 'renewed thon' ELSE '' END AS latest_text").replace("FROM documents d LEFT JOIN lab ON lab.doc_id = d.doc_id", "FROM documents d LEFT JOIN lab ON lab.doc_id = d.doc_id WHERE (d.doc_id % 6 <> 0 OR d.doc_id % 5 <> 0) AND coalesce(toxic, 0) <> 1 AND coalesce(quality, 1) <> 0")
_FIVE = r"""
toks AS (
  SELECT chunk_id, list_filter(regexp_extract_all(strip_accents(lower(concat_ws(' ', subject, from_address, array_to_string(to_addresses, ' '), regexp_replace(subject, '^((re|fw|fwd)\s*:\s*)+', '', 'i'), text))), '[\p{L}\p{N}]+'), lambda x: x <> '') AS ts
  FROM c JOIN m USING (message_id)),
tok AS (
  SELECT chunk_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos, len(ts) AS dl FROM toks),
st AS (
  SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks)"""


def _renewed_sql(words: list[str]) -> str:
    full = _bm25_sql([[w] for w in words], 10)
    return "WITH " + _RENEWED + ", " + C + ", " + _FIVE + full[full.index(", tfs AS ("):] + _BEST


@query(_renewed_sql(["renewed"]))
def index_follows_sync(spark, d):
    """A word that only the second sync brought, in an index of five fields that each sync carried on."""
    into, _, version = _synced_twice(spark, d)
    index = search.Index.of(into, version)
    return index.top("all", [["renewed"]], 10).select("chunk_id", F.round("score", 6).alias("score"), "rank")


@query(_renewed_sql(["thon", "example"]))
def index_after_merge(spark, d):
    """Words of the text and of an address, after the segments of both syncs became one."""
    into = _synced_twice(spark, d)[0]
    search.merge_segments(into, 2)
    return search.Index.of(into).top("all", [["thon"], ["example"]], 10).select("chunk_id", F.round("score", 6).alias("score"), "rank")


@query("WITH " + _RENEWED + ", " + C + ", " + _FIVE + " SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf, (SELECT n FROM st) AS n, (SELECT round(avgdl, 6) FROM st) AS avgdl FROM tok GROUP BY term")
def index_stats_after_sync(spark, d):
    """Every term's counts and the statistics of the list, from both syncs' segments without what was deleted."""
    into, _, version = _synced_twice(spark, d)
    index = search.Index.of(into, version)
    stats = index.stats.where("lang = 'all'").select("n", F.round("avgdl", 6).alias("avgdl"))
    return index.of_list("all").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).join(F.broadcast(stats))  # one row


#: A mailbox with a quoted separator and a label list.
MBOX = b"From a@example.com Wed Aug 26 10:00:00 2026\nMessage-ID: <1@example.com>\nFrom: A <a@example.com>\nTo: b@example.com\nSubject: One\nX-Gmail-Labels: Inbox,Category updates\n\nHello\n>From here\n\nFrom b@example.com Wed Aug 26 11:00:00 2026\nSubject: Two\n\nBye\n"
_HEAD = "From a@example.com Wed Aug 26 10:00:00 2026\nMessage-ID: <", "@example.com>\nFrom: A <a@example.com>\nTo: b@example.com\nSubject: One\nX-Gmail-Labels: Inbox,Category updates\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"
_REST = "\n\nFrom b@example.com Wed Aug 26 11:00:00 2026\nSubject: Two\n\nBye\n"


@query("""WITH b AS (SELECT 'x/' || coalesce(conv_id::VARCHAR, '') || '.' || coalesce(turn::VARCHAR, '') AS p, coalesce(text, '') AS t FROM conversations)
SELECT p || '.mbox' AS path, p[3:] || '.mbox#1' AS label, 'message-id:<' || p[3:] || '@example.com>' AS provider_key, 'One' AS subject, 'a@example.com' AS sender, '2026-08-26T10:00:00.000Z' AS date, t || chr(10) AS body, 'Inbox,CATEGORY_UPDATES' AS labels FROM b
UNION ALL SELECT p || '.mbox', p[3:] || '.mbox#2', 'sha256:' || sha256('Subject: Two' || chr(10) || chr(10) || 'Bye' || chr(10)), 'Two', '', '2026-08-26T11:00:00.000Z', 'Bye' || chr(10), '' FROM b""")
def mbox_split(spark, d):
    """Turns of conversations, each as a mailbox of two messages whose text has its separators escaped."""
    name = F.concat_ws(".", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("conv_id", "turn")))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "(?md)^(>*From )", ">$1")
    content = F.encode(F.concat(F.lit(_HEAD[0]), name, F.lit(_HEAD[1]), text, F.lit(_REST)), "UTF-8")
    boxes = corpus.read(spark, d, "conversations").select(F.concat(F.lit("x/"), name, F.lit(".mbox")).alias("path"), content.alias("content"))
    return read_mail(boxes).select("path", "label", "provider_key", "subject", "sender", "date", "body", F.array_join("labels", ",").alias("labels"))


@query("""WITH k AS (SELECT doc_id // 16 AS k, count(*) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT 0 AS added, coalesce(sum(n) FILTER (k % 7 = 0 AND k % 5 <> 0), 0)::BIGINT AS updated, coalesce(sum(n) FILTER (k % 5 = 0), 0)::BIGINT AS deleted, coalesce(sum(n) FILTER (k % 7 = 0 AND k % 5 <> 0), 0)::BIGINT AS touched_threads,
count(*) FILTER (k % 5 <> 0) AS files, count(*) FILTER (k % 7 = 0 AND k % 5 <> 0) AS files_read, count(*) FILTER (k % 7 <> 0 AND k % 5 <> 0) AS files_unchanged, 0 AS failures FROM k""")
def folder_looks(spark, d):
    """Documents as mailboxes in a folder, looked at twice: between the looks one file of five goes and one of seven has other subjects."""
    docs = corpus.read(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", "text")
    folder = corpus.folder(spark, "mailboxes")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    uri = fs.resolvePath(path).toUri().toString()
    k = F.expr("doc_id div 16")
    head = lambda subject: F.concat(F.lit("Message-ID: <"), F.col("doc_id"), F.lit(f"@example.com>\nSubject: {subject} "), F.col("doc_id"), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"))
    raw = lambda subject: F.encode(F.concat(head(subject), F.coalesce("text", F.lit(""))), "UTF-8")
    rows = lambda of, raw: of.select(F.concat(F.lit("box"), k, F.lit(".mbox")).alias("name"), F.col("doc_id").alias("n"), raw.alias("raw"))
    into = Snapshots(spark, corpus.folder(spark, "looks"), buckets=8)
    write_mailboxes(rows(docs, raw("first")), uri)
    sync.sync_folder(into, [uri], "me", policy=())
    write_mailboxes(rows(docs.where((k % 7 == 0) | (k % 5 == 0)), F.when(k % 5 != 0, raw("second"))), uri)
    report = sync.sync_folder(into, [uri], "me", policy=())
    return report.select("added", "updated", "deleted", "touched_threads", "files", "files_read", "files_unchanged", "failures")


@query("""WITH k AS (SELECT DISTINCT conv_id AS k FROM conversations WHERE conv_id IS NOT NULL)
SELECT count(*) AS listed, count(*) FILTER (k % 10 = 0 OR k % 3 = 0) AS "read", count(*) FILTER (k % 10 <> 0 AND k % 3 <> 0) AS skipped, count(*) FILTER (k % 20 = 10) AS failures, (3 * count(*) FILTER (k % 20 = 10))::BIGINT AS attempts,
count(*) FILTER (k % 20 = 0) AS added, count(*) FILTER (k % 10 <> 0 AND k % 3 = 0) AS updated, 0::BIGINT AS unchanged FROM k""")
def provider_looks(spark, d):
    """Conversations as a provider's messages, looked at twice: of one of ten the raw message lacks, of half of these it comes between the looks; one envelope of three changes."""
    rows = corpus.read(spark, d, "conversations").where("conv_id IS NOT NULL")
    said = rows.groupBy(F.col("conv_id").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    folder = corpus.folder(spark, "provider")
    raw = F.concat(F.lit("Subject: talk "), F.col("k"), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.col("body"))
    put = lambda of: provider.write_raw(said.where(of).select(F.col("k").cast("string").alias("provider_key"), raw.alias("raw")), folder)
    envelope = lambda flags: F.to_json(F.struct(F.array(F.struct(F.col("k").alias("id"), F.concat(F.lit("talk "), "k").alias("subject"), flags.alias("flags"))).alias("envelopes")))
    none = F.array().cast("array<string>")
    paged = lambda flags: said.select(envelope(flags)).write.mode("overwrite").text(f"{folder}/pages")
    into = Snapshots(spark, corpus.folder(spark, "looks"), buckets=8)
    put("k % 10 != 0")
    paged(none)
    sync.sync_provider(into, folder, "me", policy=(), delay_ms=1)
    put("k % 20 = 0")
    paged(F.when(F.col("k") % 3 == 0, F.array(F.lit("seen"))).otherwise(none))
    report = sync.sync_provider(into, folder, "me", policy=(), delay_ms=1)
    tried = into.read("dead_letters").agg(F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"))
    return report.select("listed", "read", "skipped", "failures", "added", "updated", "unchanged").join(F.broadcast(tried))  # one row each


@query("""WITH w AS (SELECT user_id, max(lpad(epoch_us(ts)::VARCHAR, 20, '0') || ':' || event_id) AS l, arg_max(event_type, lpad(epoch_us(ts)::VARCHAR, 20, '0') || ':' || event_id) AS h, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL GROUP BY ALL),
c AS (SELECT *, CASE WHEN user_id % 3 <> 0 THEN 'added' WHEN h IS NOT DISTINCT FROM 'click' THEN 'unchanged' ELSE 'updated' END AS change, user_id % 50 AS t FROM w)
SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'unchanged') AS unchanged, coalesce(sum(n - 1), 0)::BIGINT AS repeated, count(DISTINCT t) FILTER (change <> 'unchanged') AS touched_threads FROM c""")
def stream_counters(spark, d):
    """Events streamed in at least three batches, a key a user, a third of whom were there with a click; the counters of all batches."""
    events = corpus.read(spark, d, "events")
    place, n = f"{d}/events.parquet", len(events.inputFiles())
    if n < 3:
        place, n = corpus.folder(spark, "events"), 12
        events.repartition(n).write.parquet(place)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-n // 3)).parquet(place)
    at = F.concat_ws(":", F.lpad(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), 20, "0"), F.when(F.col("ts").isNotNull(), F.col("event_id").cast("string")))
    source = source.where("ts IS NOT NULL AND event_id IS NOT NULL").select("user_id", at.alias("at"), "event_type", (F.col("user_id") % 50).alias("thread"))
    stored = events.where("user_id % 3 = 0").select("user_id", F.lit("click").alias("event_type")).distinct()
    into = Snapshots(spark, corpus.folder(spark, "changes"))
    query = stream_changes.follow(stream_changes.changes(source, key="user_id", order="at", hash_col="event_type", thread="thread", stored=stored), into, corpus.folder(spark, "stream"))
    query.awaitTermination()
    return stream_changes.counters(into.read(stream_changes.CHANGES))
