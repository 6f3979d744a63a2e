"""Projects the test tables to messages, in DataFrame functions and in SQL."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlark.functions import text as T
from postlark.operators import archive, search


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each document: account is its source, mailbox its language, subject its first line."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    blank = F.lit("")
    account, mailbox, body = F.coalesce("source", blank), F.coalesce("lang", blank), F.coalesce("text", blank)
    out = d.select(
        "doc_id",
        account.alias("account_id"),
        mailbox.alias("mailbox"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("provider_key"),
        F.split(body, "\n")[0].alias("subject"),
        F.concat(mailbox, F.lit("@example.com")).alias("from_address"),
        F.array(F.concat(account, F.lit("@example.com"))).alias("to_addresses"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("date"),
        body.alias("latest_text"),
        F.array_compact(F.array(F.when(F.col("toxic") == 1, "CATEGORY_SPAM"), F.when(F.col("quality") == 0, "CATEGORY_PROMOTIONS"))).alias("classifications"),
    )
    scoped = lambda c: T.make_id(F.col("account_id"), F.col("mailbox"), c)
    return (
        out.withColumn("message_id", scoped(F.col("provider_key")))
        .withColumn("thread_id", scoped(T.make_id(F.col("account_id"), T.normalize_subject(F.col("subject")))))
        .withColumn("categories", T.categories(F.col("classifications")))
        .withColumn("normalized_hash", F.sha2("latest_text", 256))
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as messages; each answer quotes the turn before it."""
    c = read(spark, sf_dir, "conversations")
    one = c.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    before = one.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("said"))
    body = F.coalesce(F.concat(F.col("text"), F.lit("\n\nOn Tue, x wrote:\n> "), F.col("said")), F.col("text"), F.lit(""))
    subject = F.concat(F.when(F.col("turn") > 0, "Re: FW:  ").otherwise(""), F.lit(" Talk "), F.col("conv_id"))
    return one.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", body.alias("body"), subject.alias("subject"))


#: Words in the scripts that have an analyzer of their own, behind each text of a language.
WORDS = {"en": "合同 更新", "fr": "계약 갱신", "de": "契約 更新 の 条件", "es": "تجديد العقد"}


def scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a word in another script behind each text."""
    word = F.coalesce(*(F.when(F.col("lang") == k, v) for k, v in WORDS.items()), F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), word).alias("t"))


S = "s AS (SELECT doc_id, coalesce(text, '') || ' ' || CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WORDS.items()) + " ELSE '' END AS t FROM documents)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as messages of one thread a conversation, a minute after one another."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    return c.select(F.concat(F.lit("talk-"), "conv_id").alias("thread_id"), F.concat_ws(":", "conv_id", "turn").alias("message_id"), date.alias("date"))


TURNS = "m AS (SELECT DISTINCT 'talk-' || conv_id AS thread_id, conv_id || ':' || turn AS message_id, strftime(TIMESTAMP '2024-01-01' + to_minutes(turn), '%Y-%m-%dT%H:%M:%S.000Z') AS date FROM conversations)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.chunks(messages(spark, sf_dir))


_BUILT: dict[tuple[str, ...], str] = {}


def folder(spark: SparkSession, what: str) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="postlark-")  # one machine
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/postlark-{what}-{uuid.uuid4().hex}"


def state(spark: SparkSession, sf_dir: str, *names: str) -> tuple[str, ...]:
    """An application and what files of tables it finds, and when they were changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for name in names:
        p = path(f"{sf_dir}/{name}.parquet")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        out += [f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in (fs.listStatus(p) if fs.exists(p) else [])]
    return (spark.sparkContext.applicationId, sf_dir, *sorted(out))


def index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The index of sf_dir's chunks; the first query of an application builds it, as does one after the tables changed."""
    key = state(spark, sf_dir, "documents", "labels")
    if key not in _BUILT:
        path = folder(spark, "index")
        search.Index.write(search.shown(search.pieces(messages(spark, sf_dir))), path, ("text",))
        _BUILT[key] = path
    return search.Index.read(spark, _BUILT[key])


#: The same as SQL, for use as WITH <M>, <C>, <TOK> SELECT ...
M = r"""
lab AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m0 AS (
  SELECT d.doc_id, coalesce(source, '') AS account_id, coalesce(lang, '') AS mailbox, 'doc-' || d.doc_id AS provider_key,
         split_part(coalesce(text, ''), chr(10), 1) AS subject, coalesce(lang, '') || '@example.com' AS from_address, [coalesce(source, '') || '@example.com'] AS to_addresses,
         strftime(TIMESTAMP '2024-01-01' + to_minutes(d.doc_id), '%Y-%m-%dT%H:%M:%S.000Z') AS date, coalesce(text, '') AS latest_text,
         list_filter([CASE WHEN toxic = 1 THEN 'spam' END, CASE WHEN quality = 0 THEN 'promotions' END], lambda x: x IS NOT NULL) AS categories
  FROM documents d LEFT JOIN lab ON lab.doc_id = d.doc_id),
m AS (
  SELECT *, left(sha256(account_id || chr(0) || mailbox || chr(0) || provider_key), 24) AS message_id, sha256(latest_text) AS normalized_hash,
         left(sha256(account_id || chr(0) || mailbox || chr(0) || left(sha256(account_id || chr(0) || lower(regexp_replace(regexp_replace(subject, '^((re|fw|fwd)\s*:\s*)+', '', 'i'), '^\s+|\s+$', '', 'g'))), 24)), 24) AS thread_id
  FROM m0)"""
C = r"""
para AS (
  SELECT message_id, thread_id, account_id, mailbox, date, p.p AS para, p.o AS po
  FROM m, LATERAL (SELECT unnest(x) AS p, generate_subscripts(x, 1) AS o FROM (SELECT regexp_split_to_array(latest_text, '\n\s*\n') AS x)) p),
cut AS (
  SELECT * EXCLUDE (para), unnest([regexp_replace(substr(t, i * 2400 + 1, 2400), '^\s+|\s+$', '', 'g') FOR i IN range((length(t) + 2399) // 2400)]) AS text,
         unnest(range((length(t) + 2399) // 2400)) AS co
  FROM (SELECT *, regexp_replace(para, '^\s+|\s+$', '', 'g') AS t FROM para)),
c0 AS (
  SELECT message_id, thread_id, account_id, mailbox, date AS started_at, 'latest' AS section, text,
         (row_number() OVER (PARTITION BY message_id ORDER BY po, co) - 1)::INT AS ordinal
  FROM cut WHERE text <> ''),
c AS (
  SELECT *, left(sha256(account_id || chr(0) || mailbox || chr(0) || message_id || chr(0) || section || chr(0) || ordinal || chr(0) || text), 24) AS chunk_id, sha256(text) AS content_hash FROM c0)"""
TOK = r"""
tok AS (
  SELECT chunk_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos, len(ts) AS dl
  FROM (SELECT chunk_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS ts FROM c)),
st AS (
  SELECT count(*) AS n, avg(len(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'))) AS avgdl FROM c)"""
