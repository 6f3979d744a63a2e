"""Content-addressed WARC archive.

An archive is a folder with two Parquet tables. `payloads` has each payload's
bytes once, under its SHA-256 and length. `records` has the exact header bytes
of every record, its type, and the key of its payload. Joining both gives the
original records: header block, payload, two line ends.

Of records with equal payloads the one with the smallest id is the response and
the others are revisits of it. Bytes are hashed where they are read; only keys,
ids and lengths are shuffled to find it. Payloads move once, when the store
picks the response's copy, and are checked against their key when read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir

END = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 160 bits are 4 times 8 digits of 5 bits."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _keyed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.to_binary(F.lit(""), F.lit("utf-8")))
    df = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return df.select("id", "url", "payload", F.sha2("payload", 256).alias("key"), F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("digest"))


def header(date: str, prefix: str) -> Column:
    """The header block of a record, its blank line included."""
    id_of = lambda c: F.concat(F.lit(f"<{prefix}"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    plain = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    revisit = F.col("type") == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.col("type")),
        line("WARC-Record-ID", id_of(F.coalesce(F.col("id").cast("string"), F.lit("null")))),
        line("WARC-Target-URI", plain),
        line("WARC-Date", F.lit(date)),
        F.when(revisit, line("WARC-Refers-To", id_of(F.col("refers_to")))).otherwise(""),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.col("bytes").cast("string")),
        F.lit(END),
    )


def write_archive(pages: DataFrame, path: str | None = None, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", at_least: int = 0, date: str = "2024-01-01T00:00:00Z", prefix: str = "urn:page:") -> str:
    """Writes a record for each row and returns the archive's folder.

    Null payloads are empty ones, null urls empty texts. Payloads under at_least
    bytes are all responses. Rows that share both the smallest id and the payload
    are all responses. Rows with a null id are responses unless an equal payload
    has an id; then they revisit it. An empty table makes an empty archive. Other
    columns are not read. Without path a new folder in the shared one is used.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    keyed = _keyed(pages, id_col, url_col, payload_col)
    first = keyed.groupBy("key", "bytes").agg(F.min("id").alias("first"))
    is_first = (F.col("bytes") < at_least) | F.col("first").isNull() | F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    records = keyed.drop("payload").join(first, ["key", "bytes"]).withColumn("type", F.when(is_first, "response").otherwise("revisit"))
    records = records.withColumn("refers_to", F.when(~is_first, F.col("first")))
    records.select("id", "type", "refers_to", "key", "bytes", F.encode(header(date, prefix), "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")
    # Which row's copy is kept: its id if it has one, as equal keys are equal bytes.
    keyed.select("key", "bytes", "payload").dropDuplicates(["key", "bytes"]).write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def read_payloads(spark: SparkSession, path: str, **derived: Column) -> DataFrame:
    """Stored payloads that match their key, with columns derived from the bytes.

    A payload that does not match fails the job: the archive is damaged.
    """
    df = spark.read.parquet(f"{path}/payloads")
    true = (F.sha2("payload", 256) == F.col("key")) & (F.octet_length("payload") == F.col("bytes"))
    checked = df.withColumn("payload", F.when(true, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("key"))).cast("binary")))
    return checked.select("key", "bytes", *(c.alias(k) for k, c in derived.items()))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/records")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """The original records: id, type and the exact bytes of each record."""
    whole = read_records(spark, path).select("id", "type", "key", "bytes", "header").join(read_payloads(spark, path, payload=F.col("payload")), ["key", "bytes"])
    return whole.select("id", "type", F.concat("header", "payload", F.encode(F.lit(END * 2), "UTF-8")).alias("record"))


def header_field(name: str) -> Column:
    """A field's value in the header bytes, or null."""
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def parse_records(df: DataFrame, record_col: str = "record") -> DataFrame:
    """Splits whole records into header and payload bytes: at the first blank line, and by Content-Length."""
    record = F.col(record_col)
    cut = F.instr(F.decode(record, "ISO-8859-1"), END * 2) + 3  # a byte is a character there
    split = df.withColumns({"header": F.substring(record, F.lit(1), cut), "_at": cut + 1})
    return split.withColumn("payload", F.substring(record, F.col("_at"), header_field("Content-Length").cast("int"))).drop("_at")


def write_files(spark: SparkSession, path: str, out: str) -> None:
    """Exports the archive as WARC files that hold records one after another."""
    reconstruct(spark, path).select(F.regexp_replace(F.decode("record", "UTF-8"), r"\r\n\r\n\z", "")).write.option("lineSep", END * 2).text(out)


def round_trip(pages: DataFrame, *, prefix: str = "urn:page:", **options) -> DataFrame:
    """Writes an archive, reconstructs its records and reads them; a row for each record.

    Everything comes from the bytes of the reconstructed records: id, type and
    reference from the header, length and digest from the payload, which must agree
    with the header.
    """
    spark = pages.sparkSession
    path = write_archive(pages, prefix=prefix, **options)
    kind = read_records(spark, path).schema["id"].dataType
    parsed = parse_records(reconstruct(spark, path).select("record"))
    ident = lambda name: F.regexp_extract(header_field(name), f"^<{prefix}(.*)>$", 1)
    rows = parsed.select(
        F.when(ident("WARC-Record-ID") != "null", ident("WARC-Record-ID").cast(kind)).alias("id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("sha1"),
        header_field("WARC-Type").alias("record_type"),
        ident("WARC-Refers-To").cast(kind).alias("refers_to"),
        header_field("Content-Length").cast("long").alias("n"),
        header_field("WARC-Payload-Digest").alias("digest"),
        (F.octet_length("record") - F.octet_length("header") - F.octet_length("payload")).alias("rest"),
    )
    agrees = (F.col("digest") == F.concat(F.lit("sha1:"), "sha1")) & (F.col("n") == F.col("payload_bytes")) & (F.col("rest") == len(END * 2)) & (F.col("refers_to").isNotNull() == (F.col("record_type") == "revisit"))
    return rows.select("id", "payload_bytes", F.when(agrees, F.col("sha1")).otherwise(F.raise_error(F.lit("header and payload differ"))).alias("payload_digest"), "record_type", "refers_to")
