"""Messages from JSON: fixture files, and envelopes of a mail provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTACHMENTS = "array<struct<name:string,mimeType:string,size:long,text:string,contentHash:string>>"
MAIL = (
    "accountId string, mailbox string, providerKey string, messageId string, threadId string, inReplyTo string, subject string, `from` string, `to` array<string>, cc array<string>, "
    "date string, text string, html string, labels array<string>, flags array<string>, classifications array<string>, rawMime string, sourceHash string, "
    f"attachments {ATTACHMENTS}"
)
EPOCH = "1970-01-01T00:00:00.000Z"


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of messages as they are, without validation."""
    return spark.read.schema(MAIL).option("multiLine", True).json(path)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _plain(v: Column) -> Column:
    """An address that is a text, or an object with an email; else empty."""
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string")).when(_is(v, "OBJECT"), F.coalesce(F.try_variant_get(v, "$.email", "string"), F.lit(""))).otherwise("")


def _address(v: Column) -> Column:
    return F.when(_is(v, "ARRAY"), _plain(F.try_variant_get(v, "$[0]", "variant"))).otherwise(_plain(v))


def _addresses(v: Column) -> Column:
    several = F.try_variant_get(v, "$", "array<variant>")
    one = F.when(_is(v, "STRING") | _is(v, "OBJECT"), F.array(_plain(v))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.when(_is(v, "ARRAY"), F.transform(several, _address)).otherwise(one), lambda x: x != "")


def unpack(pages: DataFrame, json_col: str = "value") -> DataFrame:
    """A row for each envelope of pages, which are a list or an object with a list `envelopes`; other columns stay.

    Pages that are neither, or no JSON, give no row.
    """
    v = F.try_parse_json(json_col)
    listed = F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.try_variant_get(v, "$.envelopes", "array<variant>"))
    rest = [c for c in pages.columns if c != json_col]
    return pages.select(*rest, F.explode(listed).alias(json_col)).withColumn(json_col, F.to_json(json_col))


def messages(envelopes: DataFrame, account: str, mailbox: str, json_col: str = "value") -> DataFrame:
    """Provider envelopes (a JSON object a row) as messages; other columns stay.

    The key is the id, the uid or the message id. Missing dates are the epoch;
    source_hash is of the envelope's text and tells whether it has changed.
    """
    v = F.try_parse_json(json_col)
    get = lambda name: F.try_variant_get(v, f"$['{name}']", "variant")
    text = lambda name: F.try_variant_get(v, f"$['{name}']", "string")
    texts = lambda name: F.coalesce(F.try_variant_get(v, f"$['{name}']", "array<string>"), F.array().cast("array<string>"))
    return envelopes.select(
        "*",
        F.lit(account).alias("account_id"),
        F.lit(mailbox).alias("mailbox"),
        F.coalesce(text("id"), text("uid"), text("message-id")).alias("provider_key"),
        text("message-id").alias("message_id"),
        F.try_variant_get(v, "$['in-reply-to'][0]", "string").alias("in_reply_to"),
        F.coalesce(text("subject"), F.lit("")).alias("subject"),
        _address(get("from")).alias("from_address"),
        _addresses(get("to")).alias("to_addresses"),
        _addresses(get("cc")).alias("cc_addresses"),
        F.coalesce(text("date"), F.lit(EPOCH)).alias("date"),
        F.coalesce(text("body"), text("snippet"), F.lit("")).alias("text"),
        texts("labels").alias("labels"),
        texts("flags").alias("flags"),
        texts("classifications").alias("classifications"),
        F.sha2(json_col, 256).alias("source_hash"),
    )


def to_read(listed: DataFrame, states: DataFrame, policy: str) -> DataFrame:
    """Listed messages that are new or changed under this exclusion policy.

    states: provider_key, source_hash, policy of what was read before.
    """
    known = states.where(F.col("policy") == policy).select("provider_key", "source_hash")
    return listed.join(known, ["provider_key", "source_hash"], "left_anti")
