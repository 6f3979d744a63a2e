"""Reads .eml and .mbox files: one row for each message or failure.

Files come through Spark's sources, so any file system works. binaryFile prunes
`content` where only sizes and times are asked for; read_mboxes() reads mailboxes of
any size by blocks. read_files() reads just the files of a table, in its tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from email import message_from_bytes, policy
from email.utils import parsedate_to_datetime
from functools import lru_cache
from html.parser import HTMLParser
from itertools import islice
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import ArrowException
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_BYTES = 50 << 20
MAX_TEXT = 1_000_000
EPOCH = "1970-01-01T00:00:00.000Z"
NOT_MBOX = "not an mbox file: content before the first separator"
NOT_READ = "file cannot be read"
_PARSED = 256  # files or messages that are parsed before their rows go on
ATTEMPTS = 3  # to read a file or a block of it
_SEPARATOR = re.compile(rb"(?:\A(?:\r?\n)?|(?<=\n\n)|(?<=\n\r\n))From ([^\n]*)(?:\n|\Z)")
_ESCAPED = re.compile(rb"^>(?=>*From )", re.M)

SCHEMA = (
    "path string, label string, provider_key string, message_id string, in_reply_to string, subject string, sender string, "
    "recipients array<string>, cc array<string>, date string, body string, labels array<string>, attachments array<struct<name:string,mime_type:string,size:bigint,text:string,content_hash:string>>, error string, truncated boolean"
)


class _Text(HTMLParser):
    """Text of a page: block tags break lines; scripts, styles and comments are left out."""

    _BLOCK = frozenset("address article blockquote br dd div dl dt footer h1 h2 h3 h4 h5 h6 header hr li ol p pre section table td th tr ul".split())
    _HIDDEN = frozenset(("script", "style", "head"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self._HIDDEN
        if tag in self._BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in self._HIDDEN))
        if tag in self._BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_text(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def iso(when: datetime) -> str:
    when = when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)
    return when.strftime("%Y-%m-%dT%H:%M:%S.") + f"{when.microsecond // 1000:03d}Z"


def _envelope_date(envelope: str) -> str:
    """The date of a separator in UTC; a zone, as an offset before or behind the year or as GMT or UTC, counts; what is no date is the epoch."""
    found = re.search(r"([A-Z][a-z]{2}) +([A-Z][a-z]{2}) +(\d{1,2}) +(\d\d:\d\d:\d\d)(?: +([+-]\d{4}|[A-Z]{3,4}))? +(\d{4})(?: +([+-]\d{4}))?", envelope)
    if not found:
        return EPOCH
    _, month, day, at, zone, year, behind = found.groups()
    offset = next((z for z in (zone, behind) if z and z[0] in "+-"), "+0000")
    try:
        return iso(datetime.strptime(f"{month} {day} {at} {year} {offset}", "%b %d %H:%M:%S %Y %z"))
    except ValueError:
        return EPOCH


def _date(header: str | None, envelope: str) -> str:
    try:
        return iso(parsedate_to_datetime(header or ""))
    except (ValueError, TypeError):
        return _envelope_date(envelope)


def split_mbox(data: bytes) -> list[tuple[str, bytes]] | None:
    """(separator, raw message) pairs; None if text stands before the first separator."""
    data = data.removeprefix(b"\xef\xbb\xbf")
    at = list(_SEPARATOR.finditer(data))
    if data[: at[0].start() if at else None].strip(b"\r\n"):
        return None
    ends = [m.start() for m in at[1:]] + [len(data)] if at else []
    out = []
    for m, end in zip(at, ends, strict=True):
        out.append((m[1].decode("latin1").strip(), _unframed(data[m.end() : end])))
    return out


def _unframed(raw: bytes) -> bytes:
    """A message of a mailbox without the escapes of its lines and the blank line behind it."""
    raw = _ESCAPED.sub(b"", raw) if b">From " in raw else raw
    framing = 2 if raw.endswith(b"\r\n\r\n") else 1 if raw.endswith(b"\n\n") else 0
    return raw[: len(raw) - framing]


def gmail_labels(value: str) -> list[str]:
    """Comma-separated labels, quoted ones with backslash escapes; categories as the provider's API names them."""
    found = ((q or w).strip() for q, w in re.findall(r'"((?:[^"\\]|\\.)*)"|([^,]+)', value))
    return [f"CATEGORY_{x[9:].strip().upper()}" if x.lower().startswith("category ") else x for x in found if x]


@lru_cache(256)
def _header(name: str, value: str):
    return policy.default.header_fetch_parse(name, value)


class _Policy(policy.EmailPolicy):
    """The default policy; a short header that is asked for several times, as each Content-Type is, is parsed once."""

    def header_fetch_parse(self, name, value):
        short = len(value) < 256 and not hasattr(value, "name")
        return _header(name, value) if short else super().header_fetch_parse(name, value)


_POLICY = _Policy()


def _parts(m) -> tuple[str, list[tuple]]:
    """Text of a parsed message, and its attachments: name, type, size, text of small text parts, hash of the base64 content."""
    part = m.get_body(("plain", "html"))
    body = part.get_content() if part else ""
    body = html_text(body) if part and part.get_content_subtype() == "html" else body
    files = []
    for a in m.iter_attachments():
        held = a.get_payload(decode=True) or b""
        kind = a.get_content_type()
        text = held.decode("utf-8", "replace") if kind.startswith("text/") and len(held) <= MAX_TEXT else None
        files.append((a.get_filename() or "unnamed", kind, len(held), text, hashlib.sha256(base64.b64encode(held)).hexdigest()))
    return body, files


def mime_parts(raw: bytes) -> tuple[str, list[dict]]:
    """Text and attachments of a raw message."""
    body, files = _parts(message_from_bytes(raw, policy=_POLICY))
    return body, [dict(zip(("name", "mimeType", "size", "text", "contentHash"), f, strict=True)) for f in files]


def parse(path: str, label: str, raw: bytes, envelope: str = "") -> tuple:
    """One row of SCHEMA for a raw message.

    A failed message of a mailbox has a provider key too, of its separator or its content,
    by which it is known again.
    """
    single = label.lower().endswith(".eml")
    key = None if single else f"oversize:{envelope}" if len(raw) > MAX_BYTES else f"sha256:{hashlib.sha256(raw).hexdigest()}"
    blank = (key, *(None,) * 10)
    if len(raw) > MAX_BYTES:
        return (path, label, *blank, f"message exceeds {MAX_BYTES} bytes", None)
    try:
        m = message_from_bytes(raw, policy=_POLICY)
        if not m.keys():
            return (path, label, *blank, "malformed message: no headers", None)
        ident = str(m["message-id"] or "").strip()
        ident = "" if ident == "<>" else ident
        key = f"message-id:{ident}" if ident else f"sha256:{hashlib.sha256(raw).hexdigest()}"
        reply = re.search(r"<[^>]+>|\S+", str(m["in-reply-to"] or ""))
        people = lambda h: [a.addr_spec for x in m.get_all(h, []) for a in getattr(x, "addresses", ()) if a.addr_spec not in ("", "<>")]
        body, files = _parts(m)
        labels = gmail_labels(str(m["x-gmail-labels"] or ""))
        sender = (people("from") or [""])[0]
        return (path, label, key, ident or None, reply and reply[0], str(m["subject"] or ""), sender, people("to"), people("cc"), _date(m["date"] and str(m["date"]), envelope), body[:MAX_TEXT], labels, files, None, len(body) > MAX_TEXT)
    except (LookupError, ValueError, AttributeError, TypeError) as e:
        return (path, label, *blank, f"malformed message: {type(e).__name__}", None)


def entries(path: str, content: bytes) -> Iterator[tuple]:
    name = path.rsplit("/", 1)[-1]
    if name.lower().endswith(".eml"):
        yield parse(path, name, content)
        return
    found = split_mbox(content)
    if found is None:
        yield (path, name, *(None,) * 11, NOT_MBOX, None)
    for i, (envelope, raw) in enumerate(found or (), 1):
        yield parse(path, f"{name}#{i}", raw, envelope)


def _numbered(path: str, i: int, held: bytes) -> tuple:
    """The row of a mailbox's i-th message, from behind its `From ` to the next one."""
    envelope, _, raw = held.partition(b"\n")
    return parse(path, f"{path.rsplit('/', 1)[-1]}#{i}", _unframed(raw), envelope.decode("latin1").strip())


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = "path label provider_key message_id in_reply_to subject sender recipients cc date body labels attachments error truncated".split()
    out = pd.DataFrame(rows, columns=names, dtype=object)
    held = [None if a is None else [dict(zip(("name", "mime_type", "size", "text", "content_hash"), x, strict=True)) for x in a] for a in out["attachments"]]
    return out.assign(attachments=pd.Series(held, dtype=object))


def read_mail(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA for a frame with path and content; failures are rows with an error."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), _PARSED):  # parsed rows of a few files at once, not of a whole batch
                some = b.iloc[at : at + _PARSED]
                yield _frame([r for p, c in zip(some["path"], some["content"], strict=True) for r in entries(p, bytes(c))])

    return files.select("path", "content").mapInPandas(parsed, SCHEMA)


_MESSAGES, _MAILBOXES = "*.[eE][mM][lL]", "*.[mM][bB][oO][xX],*.[mM][bB][xX],mbox"


def bundled(path: Column) -> Column:
    """Whether a file named `mbox` is the one of a bundle; true for all others."""
    return ~path.endswith("/mbox") | path.rlike(r"(?i)[^/]\.mbox/mbox$")


def scan(spark: SparkSession, path: str, names: str = f"{{{_MESSAGES},{_MAILBOXES}}}") -> DataFrame:
    """path, modificationTime, length, content of every mail file below a folder.

    Mail files end in .eml, .mbox or .mbx in any case, or are the `mbox` of a bundle `X.mbox`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    return files.where(bundled(F.col("path")))


_CUT = 4096  # pieces that go on at once
_PIECE = "path string, block long, n int, last boolean, blank boolean, raw binary"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of _cut()."""
    found = _cut(r for b in batches for r in zip(b["path"], b["block"], b["record"], strict=True))
    while some := list(islice(found, _CUT)):
        yield pd.DataFrame(some, columns=["path", "block", "n", "last", "blank", "raw"])


def _cut(records: Iterable[tuple[str, int, bytes | None]]) -> Iterator[tuple]:
    """Pieces of _PIECE from records (path, block, content) between line ends followed by `From `, which come in order within a block.

    n counts the messages that start in a block from 1. 0 is what stands in it before the
    first sure start: the rest of a message of an earlier block, or a message if the record
    before it ended with a blank line. -1 marks text before a file's first separator, -2 a
    block that could not be read (its record is null).
    `blank` tells of a block's last piece whether a message may follow it.
    """
    at: tuple[str, int] | None = None
    n, parts, ended, junk = 0, [], True, False

    def piece(last: bool) -> tuple:
        raw = b"\nFrom ".join(parts)
        return (*at, -1 if junk else n, last, ended, raw if last else raw + b"\n")

    for path, block, record in records:
        if record is None:
            if at and parts:
                yield piece(True)
            at, parts = None, []
            yield path, int(block), -2, True, True, b""
            continue
        record = bytes(record)
        if at != (path, block):
            if at and parts:
                yield piece(True)
            at, n, parts, junk = (path, int(block)), 0, [], False
            if not block:
                record = record.removeprefix(b"\xef\xbb\xbf")
                if record.startswith(b"From "):
                    n, record = 1, record[5:]
                else:
                    junk = bool(record.strip(b"\r\n"))
                    ended = record in (b"", b"\r") or record.endswith((b"\n", b"\n\r"))
                    parts = [b""] if junk else []
                    continue
        elif ended:
            if parts:
                yield piece(False)
            n, parts, junk = n + 1, [], False
        if junk or not (n or block):
            junk, parts = True, [b""]  # none of it is a message
        else:
            parts.append(record)
        ended = record.endswith((b"\n", b"\n\r"))
    if at and parts:
        yield piece(True)


def read_mboxes(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA for mailboxes of any size below a folder, read by blocks.

    The rows are those of read_mail(). A file's blocks are split by its separators in
    different tasks and dealt out once by block; a message that goes on in later blocks
    is put together by its number. Only a list of blocks is put in the order of a file.
    A separator that ends a file, with nothing behind it, gives no row.
    """
    lines = spark.read.option("lineSep", "\nFrom ").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{_MAILBOXES}}}").text(path)
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # as binaryFile gives it
    records = lines.select(name.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("record"))
    return _mailboxes(records.where(bundled(F.col("path"))))


def _mailboxes(records: DataFrame) -> DataFrame:
    """Rows of SCHEMA from path, block and record, in order within a block and one block after another."""
    pieces = records.mapInPandas(_pieces, _PIECE)
    blocks = pieces.groupBy("path", "block").agg(F.max("n").alias("top"), F.min("n").alias("low"), F.max_by("blank", F.struct("last", "n")).alias("blank"))
    order = Window.partitionBy("path").orderBy("block")
    starts = (F.col("low") == 0) & F.coalesce(F.lag("blank").over(order), F.lit(True))  # what stands first in a block is a message
    blocks = blocks.withColumn("shift", starts.cast("int"))
    before = F.sum(F.greatest("top", F.lit(0)) + F.col("shift")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    follows = F.coalesce(F.lead("shift").over(order), F.lit(0)) == 1
    blocks = blocks.select("path", "block", "shift", follows.alias("follows"), F.coalesce(before, F.lit(0)).alias("before"), "low", (F.min("low").over(Window.partitionBy("path")) < 0).alias("bad"))
    placed = pieces.join(blocks, ["path", "block"]).where(~F.col("bad")).withColumn("number", F.col("before") + F.when(F.col("n") == 0, F.col("shift")).otherwise(F.col("n") + F.col("shift")))
    placed = placed.withColumn("raw", F.when(F.col("last") & F.col("follows"), F.concat("raw", F.lit(b"\n"))).otherwise(F.col("raw")))
    edge = F.col("last") | (F.col("n") == 0)
    held = F.array_sort(F.collect_list(F.struct("block", "n", "raw")))
    joined = placed.where(edge).groupBy("path", "number").agg(held.alias("held")).select("path", "number", F.aggregate(F.slice("held", 2, F.greatest(F.size("held") - 1, F.lit(0))), F.col("held")[0]["raw"], lambda a, x: F.concat(a, F.lit(b"\nFrom "), x["raw"])).alias("raw"))
    whole = placed.where(~edge).select("path", "number", "raw").unionByName(joined)

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), _PARSED):
                some = b.iloc[at : at + _PARSED]
                yield _frame([_numbered(p, i, bytes(raw)) for p, i, raw in zip(some["path"], some["number"], some["raw"], strict=True)])

    bad = blocks.where("bad").groupBy("path").agg(F.min("low").alias("low"))
    failed = bad.select("path", F.element_at(F.split("path", "/"), -1).alias("label"), F.when(F.col("low") == -2, NOT_READ).otherwise(NOT_MBOX).alias("error"))
    return whole.mapInPandas(parsed, SCHEMA).unionByName(failed, allowMissingColumns=True)


def strict(found: DataFrame) -> DataFrame:
    """Rows of SCHEMA as they are; a failure among them fails the job."""
    failed = F.raise_error(F.concat_ws(": ", "label", "error")).cast("boolean")
    return found.where(F.when(F.col("error").isNull(), True).otherwise(failed))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA for all mail files below a folder."""
    return read_mail(scan(spark, path, _MESSAGES)).unionByName(read_mboxes(spark, path))


def _open(uri: str, rel: str) -> BinaryIO:
    """A file below a root; `rel` is empty if the root is the file."""
    where = urlsplit(uri)
    base = unquote(where.path)
    full = f"{base.rstrip('/')}/{rel}" if rel else base
    if where.scheme in ("", "file"):
        return open(full, "rb")
    system, path = arrow_fs.FileSystem.from_uri(where._replace(path=full).geturl())
    return system.open_input_file(path)


def _tried(read, *args):
    """What read(*args) gives, or None if every attempt to read fails."""
    for i in range(ATTEMPTS):
        try:
            return read(*args)
        except (OSError, ArrowException):
            time.sleep(0.05 * 2**i)
    return None


def _whole(uri: str, rel: str) -> bytes:
    with _open(uri, rel) as f:
        return f.read()


_SPLIT = b"\nFrom "


def _block(uri: str, rel: str, start: int, end: int) -> list[bytes]:
    """Records that start from `start` up to `end`; the last one goes on to the next separator."""
    lead = min(start, len(_SPLIT))
    with _open(uri, rel) as f:
        f.seek(start - lead)
        data = bytearray(f.read(end - start + lead))
        edge = len(data) - len(_SPLIT)  # a separator from here on starts a record of a later block
        first = 0
        if start:
            at = data.find(_SPLIT)
            if at < 0 or at >= edge:
                return []
            first = at + len(_SPLIT)
        look = max(first, edge)
        while (cut := data.find(_SPLIT, look)) < 0 and (more := f.read(1 << 20)):
            look = max(first, len(data) - len(_SPLIT) + 1)
            data += more
    return bytes(data[first : cut if cut >= 0 else None]).split(_SPLIT)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, uri, rel, start, end in b[["path", "uri", "rel", "block", "end"]].itertuples(index=False):
            held = _tried(_block, uri, rel, int(start), int(end))
            yield pd.DataFrame({"path": path, "block": start, "record": [None] if held is None else held})


def _of_file(path: str, uri: str, rel: str, size: int) -> Iterator[tuple]:
    """Rows of SCHEMA of an .eml file, or of a mailbox that is one block, as _mailboxes() gives them."""
    name = path.rsplit("/", 1)[-1]
    failed = lambda error: (path, name, *(None,) * 11, error, None)
    if name.lower().endswith(".eml"):
        raw = b"" if size > MAX_BYTES else _tried(_whole, uri, rel)
        yield failed(f"message exceeds {MAX_BYTES} bytes") if size > MAX_BYTES else failed(NOT_READ) if raw is None else parse(path, name, raw)
        return
    held = _tried(_block, uri, rel, 0, size)
    found = [] if held is None else list(_cut((path, 0, record) for record in held))
    if held is None or any(n < 0 for _, _, n, *_ in found):
        yield failed(NOT_READ if held is None else NOT_MBOX)
        return
    for _, _, n, _, _, raw in found:
        yield _numbered(path, n, raw)


def _of_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = (r for b in batches for f in b[["path", "uri", "rel", "size"]].itertuples(index=False) for r in _of_file(*f[:3], int(f[3])))
    while some := list(islice(rows, _PARSED)):
        yield _frame(some)


def read_files(files: DataFrame, block: int = 32 << 20) -> DataFrame:
    """Rows of SCHEMA for mail files of a table: path (distinct), uri of a root, rel (the way below it; empty if it is the file), size.

    Only these files are opened. A file of at most `block` bytes is read and parsed by one
    task, once; larger mailboxes by blocks, dealt out to tasks.
    What cannot be read in ATTEMPTS is a row with the error NOT_READ.
    """
    total = files.agg(F.sum(F.col("size") + (1 << 20))).first()[0] or 0  # opening counts as 1 MB
    tasks = int(min(200_000, max(files.sparkSession.sparkContext.defaultParallelism, total // max(block, 32 << 20))))
    single = F.col("path").rlike(r"(?i)\.eml$") | (F.col("size") <= block)
    small = files.where(single).repartition(tasks, "path").mapInPandas(_of_files, SCHEMA)
    large = files.where(~single)
    if large.isEmpty():
        return small
    cut = large.select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("size") - 1).cast("long"), F.lit(block).cast("long"))).alias("block"))
    dealt = cut.withColumn("end", F.least(F.col("block") + block, "size")).repartition(tasks, "path", "block")
    return small.unionByName(_mailboxes(dealt.mapInPandas(_blocks, "path string, block long, record binary")))


def changed(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose size or time differs from what is known (path, length, modificationTime)."""
    return scanned.join(known.select("path", "length", "modificationTime"), ["path", "length", "modificationTime"], "left_anti")


def by_slices(f: Callable[[list], pa.Array], column: pa.Array) -> pa.Array:
    """What f makes of a column of a batch, _PARSED values at once, so that only these are held as Python's objects."""
    made = [f(column.slice(at, _PARSED).to_pylist()) for at in range(0, len(column) or 1, _PARSED)]
    return pa.concat_arrays(made)


@F.arrow_udf(StringType())
def html_to_text(html: pa.Array) -> pa.Array:
    return by_slices(lambda some: pa.array([html_text(x) for x in some], pa.string()), html)


def write_mailboxes(rows: DataFrame, uri: str) -> None:
    """Writes mailboxes below a folder that is there: name, n (the order in it), raw (a message, or null for none).

    A mailbox is written by one task as its messages come, so none is held whole; one
    whose messages are all null is deleted. Separators within messages are escaped.
    """
    where = urlsplit(uri)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = (arrow_fs.LocalFileSystem(), unquote(where.path)) if where.scheme in ("", "file") else arrow_fs.FileSystem.from_uri(uri)
        name, out = None, None
        for b in batches:
            for here, raw in zip(b["name"], b["raw"], strict=True):
                if here != name:
                    if out:
                        out.close()
                    name, out = here, None
                    full = f"{path.rstrip('/')}/{name}"
                    if system.get_file_info(full).type != arrow_fs.FileType.NotFound:
                        system.delete_file(full)
                if raw is not None:
                    raw = bytes(raw)
                    out = out or system.open_output_stream(full)
                    out.write(b"From - Thu Jan  1 00:00:00 2024\n" + (_TO_ESCAPE.sub(rb">\1", raw) if b"From " in raw else raw) + b"\n\n")
        if out:
            out.close()
        yield pd.DataFrame({"done": [1]})

    dealt = rows.select("name", "n", "raw").repartition("name").sortWithinPartitions("name", "n")
    dealt.mapInPandas(write, "done int").write.format("noop").mode("overwrite").save()


_TO_ESCAPE = re.compile(rb"^(>*From )", re.M)
