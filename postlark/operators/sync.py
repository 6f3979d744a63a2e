"""Sync from messages to snapshots: normalized messages, chunks, attachments, states, and which file holds what."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from postlark.functions import text as T
from postlark.operators import archive, search
from postlark.sources import envelopes, provider
from postlark.sources.mail_files import NOT_READ, by_slices, mime_parts, read_files
from postlark.sources.walk import resolve_root, walk
from postlark.streaming.ingest import Change, Snapshots

POLICY = ("spam", "promotions")
FILE = ["root_key", "rel_path"]
_AGAIN = 1 << 17  # entries to leave out that are broadcast
_ATTACHMENT = StructType([StructField("name", StringType()), StructField("mimeType", StringType()), StructField("size", LongType()), StructField("text", StringType()), StructField("contentHash", StringType())])
_MIME = StructType([StructField("text", StringType()), StructField("attachments", ArrayType(_ATTACHMENT))])


@F.arrow_udf(_MIME)
def _mime(raw: pa.Array) -> pa.Array:
    """Text and attachments of raw messages; null without one."""

    def some(held: list) -> pa.Array:
        got = [(None, None) if r is None else mime_parts(r.encode()) for r in held]
        return pa.array([{"text": t, "attachments": a} for t, a in got], to_arrow_type(_MIME))

    return by_slices(some, raw)


def policy_key(policy: Iterable[str]) -> str:
    """The text that tells whether two exclusion policies are the same."""
    return ",".join(sorted({p.strip().lower() for p in policy}))


def effective_policy(replace: Sequence[str] | None = None, include: Sequence[str] = ()) -> tuple[str, ...]:
    """Excluded categories: the given ones, or the default, without those to include."""
    kept = {p.strip().lower() for p in (replace if replace is not None else POLICY)} - {p.strip().lower() for p in include}
    return tuple(sorted(kept))


def normalize(mail: DataFrame) -> DataFrame:
    """Messages as sources give them (envelopes.MAIL) with scoped identities, sections, categories and hash.

    A raw message replaces text and attachments. The hash covers what is searched
    or classified, so neither date nor thread. `truncated` tells that a source cut the text.
    """
    none = F.array().cast("array<string>")
    parts = _mime(F.col("rawMime"))
    m = mail.withColumn("_parts", parts)
    raw = F.col("rawMime").isNotNull()
    body = F.coalesce(F.when(raw, F.col("_parts.text")).otherwise(F.col("text")), F.lit(""))
    files = F.coalesce(F.when(raw, F.col("_parts.attachments")).otherwise(F.col("attachments")), F.array().cast(ArrayType(_ATTACHMENT)))
    latest, quoted = T.split_quoted(body)
    subject = T.trim(F.coalesce("subject", F.lit("")))
    scoped = lambda c: T.make_id(F.col("accountId"), F.col("mailbox"), c)
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    out = m.select(
        F.col("accountId").alias("account_id"),
        "mailbox",
        F.col("providerKey").alias("source_key"),
        scoped(F.col("providerKey")).alias("provider_key"),
        scoped(F.coalesce(given("messageId"), F.col("providerKey"))).alias("message_id"),
        scoped(F.coalesce(given("threadId"), T.make_id(F.col("accountId"), T.normalize_subject(subject)))).alias("thread_id"),
        F.when(given("inReplyTo").isNotNull(), scoped(F.col("inReplyTo"))).alias("in_reply_to"),
        subject.alias("subject"),
        T.normalize_subject(subject).alias("normalized_subject"),
        F.coalesce("from", F.lit("")).alias("from_address"),
        F.coalesce("to", none).alias("to_addresses"),
        F.coalesce("cc", none).alias("cc_addresses"),
        "date",
        latest.alias("latest_text"),
        quoted.alias("quoted_text"),
        F.array_join(F.transform(files, lambda a: a["text"]), "\n").alias("attachment_text"),
        "labels",
        "flags",
        "classifications",
        T.categories(F.col("classifications"), F.col("labels"), F.col("flags")).alias("categories"),
        files.alias("attachments"),
        F.col("sourceHash").alias("source_hash"),
        (F.col("truncated") if "truncated" in mail.columns else F.lit(False)).alias("truncated"),
    )
    hashed = F.struct("subject", "from_address", "to_addresses", "cc_addresses", "latest_text", "quoted_text", "labels", "flags", "classifications", "attachments")
    return out.withColumn("normalized_hash", F.sha2(F.to_json(hashed), 256))


def attachments(messages: DataFrame) -> DataFrame:
    """A row for each attachment; its id is the message's and its place."""
    each = messages.select("message_id", F.posexplode("attachments").alias("i", "a"))
    return each.select(F.concat_ws(":", "message_id", F.col("i").cast("string")).alias("attachment_id"), "message_id", F.col("a.name").alias("name"), F.col("a.mimeType").alias("mime_type"), F.col("a.size").alias("size"), F.col("a.contentHash").alias("content_hash"), F.col("a.text").alias("extracted_text"))


def list_attachments(attached: DataFrame, message_id: str | None = None) -> DataFrame:
    """Attachments of one message, or of all, in the order of their ids as texts."""
    return (attached if message_id is None else attached.where(F.col("message_id") == message_id)).orderBy("attachment_id")


def get_message(messages: DataFrame, message_id: str) -> DataFrame:
    return messages.where(F.col("message_id") == message_id)


def check_identities(batch: DataFrame, stored: DataFrame | None) -> None:
    """Raises for blank and repeated identities of a batch, and for a provider key that another message holds."""
    blank = batch.where(T.trim(F.coalesce("source_key", F.lit(""))) == "")
    if not blank.isEmpty():
        raise ValueError("message provider identity is required")
    bad = archive.identity_violations(batch).select("violation", "value")
    if stored is not None:
        owned = batch.select("provider_key", "message_id").join(stored.select("provider_key", F.col("message_id").alias("owner")), "provider_key").where("owner != message_id")
        bad = bad.unionByName(owned.select(F.lit("provider key of another message").alias("violation"), F.col("provider_key").alias("value")))
    found = bad.first()
    if found:
        raise ValueError(f"{found.violation}: {found.value}")


@dataclass(frozen=True)
class Scan:
    """One look at folders of mail files.

    files: root_key, rel_path, size, mtime_ms, changed, status (complete, partial or
    unreadable), failures and failed_entries (array<string>), and keys, the scoped
    provider keys it holds. unlisted: root_key, rel_path of what could not be listed.
    held: root_key, rel_path, provider_key in place of keys, for files of any number of messages.
    """

    account_id: str
    roots: Sequence[str]
    files: DataFrame
    unlisted: DataFrame
    authoritative: bool = False
    held: DataFrame | None = None


@dataclass(frozen=True)
class Held:
    """What is known of files: links (root_key, rel_path, provider_key), their states, and roots (root_key, account_id)."""

    links: DataFrame
    files: DataFrame
    roots: DataFrame


def file_status(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Status of files by their entries: path, status, failures, failed_entries.

    entries: path, label, error (null for a message) as read_mail() gives them; known:
    path, failed_entries of the last time. A file without any entry that could be
    told apart is unreadable; failures that are all known leave it complete, as does a
    message that fills an .eml file and is malformed. Failed entries are known again by their
    provider key where there is one, else by label.
    """
    keyed = "provider_key" in entries.columns
    entry = F.col("provider_key").isNotNull() if keyed else F.col("label").contains("#")
    known_by = F.col("provider_key" if keyed else "label")
    alone = F.col("path").rlike(r"(?i)\.eml$") & (F.col("error") != NOT_READ)
    each = entries.groupBy("path").agg(
        F.count_if(F.col("error").isNotNull() & ~entry & ~alone).alias("whole"),
        F.coalesce(F.collect_list(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "label", "error"))), F.array()).alias("failures"),
        F.coalesce(F.collect_set(F.when(F.col("error").isNotNull() & entry, known_by)), F.array()).alias("failed_entries"),
    )
    both = each.join(known.select("path", F.col("failed_entries").alias("_known")), "path", "left")
    fresh = F.size(F.array_except("failed_entries", F.coalesce("_known", F.array().cast("array<string>"))))
    status = F.when(F.col("whole") > 0, "unreadable").when(fresh > 0, "partial").otherwise("complete")
    return both.select("path", status.alias("status"), F.array_sort("failures").alias("failures"), F.array_sort("failed_entries").alias("failed_entries"))


def _union(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def reconcile(held: Held, scan: Scan, policy: str) -> tuple[Held, DataFrame]:
    """What is held after a scan, and the provider keys that no file holds any more.

    Files that are gone, but for those at or below an unlisted path, lose links and
    state. Of changed files complete ones replace their links, partial ones only if
    every message they held is still there; otherwise links only grow, and the failed
    entries stay those of the last time. Unreadable ones keep links and lose their
    state. An authoritative scan without any failure releases the account's other roots.
    """
    paths = _union(held.links.select(*FILE), held.files.select(*FILE)).distinct()
    covered = archive.below(paths, scan.unlisted)
    gone = paths.where(F.col("root_key").isin(*scan.roots)).join(scan.files.select(*FILE), FILE, "left_anti").join(covered, FILE, "left_anti")
    links = held.links.join(gone, FILE, "left_anti")
    released = [held.links.join(gone, FILE, "left_semi")]

    changed = scan.files.where("changed")
    current = (changed.select(*FILE, F.explode("keys").alias("provider_key")) if scan.held is None else scan.held.select(*FILE, "provider_key")).distinct()
    partial = changed.where("status = 'partial'").select(*FILE)
    lacking = links.join(partial, FILE, "left_semi").join(current, [*FILE, "provider_key"], "left_anti").select(*FILE).distinct()
    replaced = _union(changed.where("status = 'complete'").select(*FILE), partial.join(lacking, FILE, "left_anti"))
    released.append(links.join(replaced, FILE, "left_semi"))
    links = _union(links.join(replaced, FILE, "left_anti"), current).distinct()

    before = held.files.select(*FILE, F.col("failed_entries").alias("_before"))
    state = changed.where("status != 'unreadable'").join(lacking.withColumn("_lacks", F.lit(True)), FILE, "left").join(before, FILE, "left")
    entries = F.when(F.col("_lacks"), F.coalesce("_before", F.array().cast("array<string>"))).otherwise(F.col("failed_entries"))
    state = state.select(*FILE, F.lit(scan.account_id).alias("account_id"), "size", "mtime_ms", F.lit(policy).alias("policy"), "failures", entries.alias("failed_entries"))
    files = _union(held.files.join(gone, FILE, "left_anti").join(changed.select(*FILE), FILE, "left_anti"), state)

    mine = scan.files.sparkSession.createDataFrame([(r, scan.account_id) for r in scan.roots], "root_key string, account_id string")
    roots = archive.merge(held.roots, mine, ["root_key"])
    unsafe = not scan.unlisted.isEmpty() or not scan.files.where(F.size("failures") > 0).isEmpty()
    if scan.authoritative and not unsafe:
        stale = roots.where((F.col("account_id") == scan.account_id) & ~F.col("root_key").isin(*scan.roots)).select("root_key")
        released.append(links.join(stale, "root_key", "left_semi").select(*links.columns))
        links, files, roots = (x.join(stale, "root_key", "left_anti").select(*x.columns) for x in (links, files, roots))
    keys = _union(*(r.select("provider_key") for r in released)).distinct()
    return Held(links, files, roots), keys.join(links, "provider_key", "left_anti")


_HELD = {
    "links": "root_key string, rel_path string, provider_key string",
    "files": "root_key string, rel_path string, account_id string, size long, mtime_ms double, policy string, failures array<string>, failed_entries array<string>",
    "roots": "root_key string, account_id string",
}


def sync(into: Snapshots, mail: DataFrame, policy: Sequence[str] = POLICY, scan: Scan | None = None) -> DataFrame:
    """Merges a batch of messages into the archive's tables and its keyword index as one new version; one row of counters.

    Excluded messages, and those whose last file is gone, leave with their chunks,
    attachments and words. Chunks are made anew only for messages whose hash, thread or
    date has changed. Tables are kept in buckets, by message, by provider key or by chunk;
    those without a message of the batch are neither read nor written. An index by
    other analyzers is made anew.
    """
    with into.lease():
        return _sync(into, mail, policy, scan, {})


def _sync(into: Snapshots, mail: DataFrame, policy: Sequence[str], scan: Scan | None, also: Mapping[str, DataFrame], source: DataFrame | None = None) -> DataFrame:
    """sync() of a writer that has the lease; `also` are further tables of the version, written whole, `source` staged rows that only `mail` reads."""
    spark = into.spark
    batch = into.staged(normalize(mail))
    into.unstaged(mail if source is None else source)
    before = into.version()
    held_keys = into.read("keys", before, near=batch.select("provider_key"))
    check_identities(batch, held_keys)
    out = archive.excluded(F.col("categories"), policy)
    included, excluded = batch.where(~out), batch.where(out)
    held = into.read("messages", before, near=included.select("message_id"))
    first = held is None
    held = included.limit(0) if first else held.join(included.select("message_id"), "message_id", "left_semi")
    shown = F.struct("thread_id", "date")
    places = held.select("provider_key", shown.alias("_shown"))
    diffed = archive.diff(held, included.select("provider_key", "normalized_hash", "thread_id", "date")).join(places, "provider_key", "left")
    diffed = into.staged(diffed.select("provider_key", "thread_id", "change", ((F.col("change") != "unchanged") | ~F.col("_shown").eqNullSafe(shown)).alias("remade")))  # keys alone; texts are stored once
    remade = included if first else included.join(diffed.where("remade").select("provider_key"), "provider_key", "left_semi")
    gone = excluded.select("provider_key")
    staying = lambda rows: rows  # noqa: E731  (keys of a batch are distinct, so no included one is excluded)
    tables: dict[str, DataFrame | Change] = dict(also)
    deleted = None
    if scan is not None:
        kept = [into.read(t, before) for t in _HELD]
        state, released = reconcile(Held(*(k if k is not None else spark.createDataFrame([], s) for k, s in zip(kept, _HELD.values(), strict=True))), scan, policy_key(policy))
        tables |= {"links": state.links, "files": state.files, "roots": state.roots}
        released = into.staged(released)
        known = into.read("keys", before, near=released)
        everything = included.select("provider_key") if known is None else known.select("provider_key").union(included.select("provider_key")).distinct()
        deleted = released.join(everything, "provider_key", "left_semi")
        gone = gone.union(released)
        staying = lambda rows: rows.join(released, "provider_key", "left_anti")
    gone = into.staged(gone.distinct())
    owners = into.read("keys", before, near=gone)
    leaving = spark.createDataFrame([], "message_id string") if owners is None else owners.join(gone, "provider_key", "left_semi").select("message_id").join(included.join(gone, "provider_key", "left_anti").select("message_id"), "message_id", "left_anti")
    leaving = into.staged(leaving.distinct())
    kept_rows = staying(included)
    moved = into.staged(held.join(included.select("message_id", F.col("provider_key").alias("_now")), "message_id").where("_now != provider_key").select("provider_key").union(gone))
    stale = into.staged(remade.select("message_id").union(leaving).distinct())
    lost = into.read("chunks", before, near=stale)
    lost = None if lost is None else into.staged(lost.join(stale, "message_id", "left_semi").select("chunk_id"))
    live = staying(remade)
    pieces = into.staged(search.measured(search.pieces(live)))
    tables |= {
        "messages": Change(("message_id",), kept_rows, leaving, as_read=True),
        "keys": Change(("provider_key",), kept_rows.select("provider_key", "message_id"), moved),
        "chunks": Change(("message_id",), pieces.select(*archive.CHUNK), stale, as_read=True),
        "attachments": Change(("message_id",), attachments(kept_rows), leaving.union(included.select("message_id"))),
        "states": Change(("provider_key",), batch.where("source_hash IS NOT NULL").select("provider_key", "source_hash", F.lit(policy_key(policy)).alias("policy"))),
    }
    new = search.shown(pieces)
    current = search.current(into, before)
    if current:
        tables |= search.changes(into, before, new, lost)
    row = archive.changes(diffed).first().asDict() | {"excluded": excluded.count(), "deleted": deleted.count() if deleted is not None else 0}
    row["truncated"] = included.where("truncated").count()
    row["touched_threads"] = diffed.where("change != 'unchanged'").agg(F.countDistinct("thread_id")).first()[0]
    reasons = {r.reason: r.n for r in archive.excluded_by_reason(excluded, policy).collect()}  # a row a category
    version = into.publish(tables, before + 1)
    if not current:
        version = reindex(into)
    row["chunks"] = into.read("chunks", version).count()
    names = ["added", "updated", "unchanged", "deleted", "excluded", "touched_threads", "truncated", "chunks"]
    return spark.createDataFrame([(*(int(row[n]) for n in names), reasons)], ", ".join(f"{n} long" for n in names) + ", excluded_by_reason map<string,long>")


def reindex(into: Snapshots) -> int:
    """Publishes the archive with a keyword index made anew from its chunks; the version."""
    at = into.version()
    held = search.entries(into.read("chunks", at), into.read("messages", at))
    return into.publish(search.changes(into, 0, held, None), at + 1, drop=search.INDEX)


def roll_up(reports: DataFrame) -> DataFrame:
    """One report of several batches: sums of counters and of reasons; chunks are those of the last state."""
    sums = [F.sum(n).alias(n) for n in ("added", "updated", "unchanged", "deleted", "excluded", "touched_threads", "truncated")]
    reasons = reports.select(F.explode("excluded_by_reason").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))
    mapped = reasons.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("excluded_by_reason"))
    return reports.agg(*sums, F.max("chunks").alias("chunks")).crossJoin(mapped)  # one row each


def _mailbox(given: str | None) -> Column:
    """The mailbox of a mail file by its path."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    of_bundle = F.regexp_replace(F.when(F.lower(name) == "mbox", F.element_at(parts, -2)).otherwise(name), r"(?i)\.(mbox|mbx)$", "")
    derived = F.when(name.rlike(r"(?i)\.eml$"), F.element_at(parts, -2)).otherwise(of_bundle)
    return F.lit(given) if given is not None else F.coalesce(F.when(derived != "", derived), F.lit("files"))


def _good(entries: DataFrame, mailbox: str | None) -> DataFrame:
    """read_mail() rows without an error, with their mailbox and number in the file."""
    number = F.coalesce(F.try_element_at(F.split("label", "#"), F.lit(2)).cast("long"), F.lit(0))
    return entries.where("error IS NULL").withColumns({"mailbox": _mailbox(mailbox), "number": number})


def repeated(entries: DataFrame, mailbox: str | None = None) -> DataFrame:
    """path and number of messages of mail files of which another copy is taken: of those with one mailbox and key the first file's first entry wins."""
    rows = _good(entries, mailbox).select("mailbox", "provider_key", "path", "number")
    return archive.first_wins(rows, ["mailbox", "provider_key"], ["path", "number"]).where("NOT first").select("path", "number")


def from_files(entries: DataFrame, account: str, mailbox: str | None = None, again: DataFrame | None = None) -> DataFrame:
    """Messages of mail files (read_mail() rows without an error) as sources give them; other columns are null.

    The mailbox is the given one, else an .eml file's folder, or the name of an .mbox
    file or bundle. `again` are the entries to leave out, if not those that repeated() gives;
    where these are few and broadcast, no text is shuffled.
    """
    first = _good(entries, mailbox).join(repeated(entries, mailbox) if again is None else again, ["path", "number"], "left_anti")
    files = F.transform("attachments", lambda a: F.struct(a["name"].alias("name"), a["mime_type"].alias("mimeType"), a["size"].alias("size"), a["text"].alias("text"), a["content_hash"].alias("contentHash")))
    nothing = F.lit(None).cast("string")
    return first.select(
        F.lit(account).alias("accountId"), "mailbox", F.col("provider_key").alias("providerKey"), F.col("message_id").alias("messageId"), nothing.alias("threadId"), F.col("in_reply_to").alias("inReplyTo"), "subject", F.col("sender").alias("from"),
        F.col("recipients").alias("to"), "cc", "date", F.col("body").alias("text"), nothing.alias("html"), "labels", F.lit(None).cast("array<string>").alias("flags"), F.lit(None).cast("array<string>").alias("classifications"), nothing.alias("rawMime"), nothing.alias("sourceHash"), files.alias("attachments"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )


def sync_folder(into: Snapshots, roots: Sequence[str], account: str | None = None, *, mailbox: str | None = None, policy: Sequence[str] = POLICY, strict: bool = False, lease: float = 900.0) -> DataFrame:
    """Lists folders or files, reads what has changed and syncs it; one row of sync()'s and the files' counters.

    A file is as before if size, time, policy and account are; its stored failures count
    again. The account is the given one, which then also releases its other roots, or the
    name of the first root. A root under another `mailbox` is another root. With `strict`
    any failure raises before anything is written; so do failures alone, if no file was left
    as it was. The table `problems` holds all failures of the last look: root_key, rel_path,
    kind (unlisted, unreadable, partial, or failed for those of complete files), error.
    Counters of files: files, files_read, files_unchanged, files_partial, files_unreadable,
    unlisted, failures, duplicates (messages of which another copy was taken). The lease is
    prolonged at each step; `lease` seconds must exceed the longest, the reading of files.
    """
    spark = into.spark
    uris = list(dict.fromkeys(resolve_root(spark, r) for r in roots))
    if not uris:
        raise ValueError("a sync of folders needs a root")
    name = account if account is not None else unquote(urlsplit(uris[0]).path).rstrip("/").rsplit("/", 1)[-1]
    by_key = {u if mailbox is None else f"{u}#{mailbox}": u for u in uris}
    path = lambda u: spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(u))
    is_file = lambda u: path(u).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path(u)).isFile()
    bases = spark.createDataFrame([(k, u, unquote(urlsplit(u).path).rstrip("/"), is_file(u)) for k, u in by_key.items()], "root_key string, uri string, base string, is_file boolean")
    with into.lease(lease):
        look = into.staged(walk(spark, by_key))
        unlisted = look.where("kind = 'unlisted'").select(*FILE)
        known = into.read("files")
        known = spark.createDataFrame([], _HELD["files"]) if known is None else known
        before = known.select(*FILE, *(F.col(c).alias(f"_{c}") for c in ("account_id", "size", "mtime_ms", "policy", "failures", "failed_entries")))
        same = (F.col("size") == F.col("_size")) & (F.col("mtime_ms") == F.col("_mtime_ms")) & (F.col("_policy") == policy_key(policy)) & (F.col("_account_id") == name)
        at = F.when(F.col("is_file"), F.col("base")).otherwise(F.concat_ws("/", "base", "rel_path"))
        files = look.where("kind = 'file'").join(F.broadcast(bases), "root_key").join(before, FILE, "left")  # a row a root
        files = into.staged(files.select(*FILE, "uri", F.when(F.col("is_file"), "").otherwise(F.col("rel_path")).alias("rel"), at.alias("path"), "size", "mtime_ms", (~F.coalesce(same, F.lit(False))).alias("changed"), "_failures", "_failed_entries"))
        new = files.where("changed")
        found = into.staged(read_files(new.select("path", "uri", "rel", "size").dropDuplicates(["path"])))
        nothing = F.array().cast("array<string>")
        status = file_status(found, new.select("path", F.col("_failed_entries").alias("failed_entries")).dropDuplicates(["path"]))
        looked = files.join(status, "path", "left")
        held_on = lambda c: F.coalesce(F.when(F.col("changed"), F.col(c)).otherwise(F.col(f"_{c}")), nothing).alias(c)
        looked = into.staged(looked.select(*FILE, "size", "mtime_ms", "changed", F.coalesce("status", F.lit("complete")).alias("status"), held_on("failures"), held_on("failed_entries")))
        kind = F.when(F.col("status") == "complete", "failed").otherwise(F.col("status"))
        problems = looked.select(*FILE, kind.alias("kind"), F.explode("failures").alias("error")).unionByName(unlisted.select(*FILE, F.lit("unlisted").alias("kind"), F.lit("cannot be listed").alias("error")))
        problems = into.staged(problems)
        first = problems.first() if strict else None
        if first:
            raise ValueError(f"{first.kind}: {first.rel_path}: {first.error}")
        read = lambda c: F.count_if(F.col("changed") & c)
        n = looked.agg(F.count("*").alias("files"), F.count_if("changed").alias("files_read"), F.count_if(~F.col("changed")).alias("files_unchanged"), read(F.col("status") == "partial").alias("files_partial"), read(F.col("status") == "unreadable").alias("files_unreadable")).first().asDict()
        n["unlisted"], n["failures"] = unlisted.count(), problems.count()
        each = found.where("error IS NULL")
        good = each.count()
        if n["failures"] and not good and not n["files_unchanged"]:
            raise ValueError(f"no message could be read; {n['failures']} failures")
        again = into.staged(repeated(found, mailbox))
        n["duplicates"] = again.count()
        mail = from_files(found, name, mailbox, F.broadcast(again) if n["duplicates"] <= _AGAIN else again)  # _AGAIN rows at most
        keys = each.select("path", T.make_id(F.lit(name), _mailbox(mailbox), F.col("provider_key")).alias("provider_key")).join(new.select(*FILE, "path"), "path").select(*FILE, "provider_key")
        keys = into.staged(keys)
        scan = Scan(name, list(by_key), looked, unlisted, account is not None, keys)
        report = _sync(into, mail, policy, scan, {"problems": problems}, found)
    return report.select("*", *(F.lit(int(v)).cast("long").alias(c) for c, v in n.items()))


def sync_provider(into: Snapshots, uri: str, account: str, mailbox: str = "INBOX", *, policy: Sequence[str] = POLICY, limit: int | None = None, attempts: int = 3, delay_ms: float = 250.0, strict: bool = False, lease: float = 900.0) -> DataFrame:
    """Reads a provider's envelopes and the raw messages of those that are new or changed, and syncs them; one row of counters.

    An envelope is as before if its text and the policy are. Of a key on several pages the
    first counts. What could not be read goes to the table `dead_letters` (provider_key,
    attempts, error) of the last look and is tried again at the next; with `strict` it raises
    before anything is written, and so it does if nothing was read and nothing was unchanged.
    Counters besides sync()'s: listed, read, skipped (unchanged envelopes), failures.
    """
    spark = into.spark
    root = resolve_root(spark, uri)
    with into.lease(lease):
        each = envelopes.messages(envelopes.unpack(provider.pages(spark, root, limit=limit)), account, mailbox)
        rest = [c for c in each.columns if c not in ("provider_key", "value")]
        keyed = each.where("provider_key IS NOT NULL").groupBy("provider_key").agg(F.min_by(F.struct(*rest), F.struct("file", "page", "source_hash")).alias("_e")).select("provider_key", "_e.*")
        listed = into.staged(keyed.unionByName(each.where("provider_key IS NULL").select("provider_key", *rest)))
        scoped = listed.select("provider_key", "source_hash", T.make_id(F.lit(account), F.lit(mailbox), F.col("provider_key")).alias("_id"))
        states = into.read("states", near=scoped.select(F.col("_id").alias("provider_key")))
        known = scoped.limit(0) if states is None else scoped.join(states.where(F.col("policy") == policy_key(policy)).select(F.col("provider_key").alias("_id"), "source_hash"), ["_id", "source_hash"], "left_semi")
        wanted = into.staged(scoped.join(known.select("_id"), "_id", "left_anti").select("provider_key"))
        n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        got = into.staged(provider.fetch(wanted.repartition(n_parts), root, attempts=attempts, delay_ms=delay_ms))
        dead = into.staged(got.where("error IS NOT NULL").select("provider_key", "attempts", "error"))
        n = {"listed": listed.count(), "read": got.count()}
        n |= {"skipped": n["listed"] - n["read"], "failures": dead.count()}
        first = dead.first() if strict else None
        if first:
            raise ValueError(f"{first.error}, after {first.attempts} attempts")
        if n["failures"] and n["failures"] == n["read"] and not n["skipped"]:
            raise ValueError(f"no message could be read; {n['failures']} failures")
        named = {"account_id": "accountId", "provider_key": "providerKey", "message_id": "messageId", "in_reply_to": "inReplyTo", "from_address": "from", "to_addresses": "to", "cc_addresses": "cc", "source_hash": "sourceHash", "raw": "rawMime"}
        mail = listed.join(got.where("error IS NULL").select("provider_key", "raw"), "provider_key").drop("file", "page").withColumnsRenamed(named)
        mail = mail.withColumns({c: F.lit(None).cast("string") for c in ("threadId", "html")} | {"attachments": F.lit(None).cast(envelopes.ATTACHMENTS)})
        report = _sync(into, mail, policy, None, {"dead_letters": dead})
    return report.select("*", *(F.lit(int(v)).cast("long").alias(c) for c, v in n.items()))
