"""Messages to chunks, snapshot merges, change counts, thread navigation and health."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlark.functions import text as T

SECTIONS = ("latest", "quoted", "attachment")
#: Columns of a chunk.
CHUNK = ("message_id", "thread_id", "account_id", "mailbox", "started_at", "section", "ordinal", "text", "chunk_id", "content_hash")


def _section(name: str) -> Column:
    pieces = T.split_text(F.coalesce(F.col(f"{name}_text"), F.lit("")))
    return F.transform(pieces, lambda p, i: F.struct(F.lit(name).alias("section"), i.alias("ordinal"), p.alias("text")))


def chunks(messages: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Explodes each message's sections into content-addressed chunks, with the message's columns `also`; narrow, without a shuffle."""
    cols = set(messages.columns)
    parts = [_section(name) for name in SECTIONS if f"{name}_text" in cols]
    keep = ["message_id", "thread_id", "account_id", "mailbox", F.col("date").alias("started_at")]
    out = messages.select(*keep, *also, F.explode(F.concat(*parts)).alias("p")).select("message_id", "thread_id", "account_id", "mailbox", "started_at", *also, "p.section", "p.ordinal", "p.text")
    ident = T.make_id(*(F.col(c) for c in ("account_id", "mailbox", "message_id", "section", "ordinal", "text")))
    return out.withColumn("chunk_id", ident).withColumn("content_hash", F.sha2("text", 256))


def merge(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The snapshot after an upsert: rows of `new` replace those with the same keys."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def remove(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The snapshot of a table, or of a table below it, without the rows of `gone`."""
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def diff(existing: DataFrame, new: DataFrame, key: str = "provider_key", digest: str = "normalized_hash") -> DataFrame:
    """`new` with a column change: added, updated or unchanged."""
    old = existing.select(key, F.col(digest).alias("_old"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_old") == F.col(digest), "unchanged").otherwise("updated")
    return new.join(old, key, "left").withColumn("change", change).drop("_old")


def changes(diffed: DataFrame) -> DataFrame:
    """One row of counters over diff()."""
    return diffed.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "updated", "unchanged")))


def excluded(categories: Column, policy: Sequence[str]) -> Column:
    return F.arrays_overlap(categories, F.array(*(F.lit(p) for p in policy)))


def excluded_by_reason(messages: DataFrame, policy: Sequence[str]) -> DataFrame:
    """Messages for each excluded category; one with two counts in both."""
    reason = F.explode(F.array_intersect("categories", F.array(*(F.lit(p) for p in policy))))
    return messages.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Marks in `first` the first row of each key; min() combines before the shuffle, so hot keys stay cheap."""
    lead = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min(F.struct(*order)).alias("_lead"))
    hit = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(lead, hit).select(*rows.columns, F.struct(*order).eqNullSafe(F.col("_lead")).alias("first"))


def identity_violations(batch: DataFrame) -> DataFrame:
    """Blank and repeated provider keys and message ids that must stop a batch."""
    blank = batch.where(T.trim(F.coalesce("provider_key", F.lit(""))) == "").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("blank provider_key").alias("violation"), F.lit("").alias("value"), "n")
    for c in ("provider_key", "message_id"):
        more = batch.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).where("n > 1")
        blank = blank.unionByName(more.select(F.lit(f"duplicate {c}").alias("violation"), "value", "n"))
    return blank


def released(stored: DataFrame, present: DataFrame, unlisted: Sequence[str], links: DataFrame) -> DataFrame:
    """Provider keys whose last file is gone.

    stored and present: rel_path. unlisted: folders that could not be listed;
    what lies in them is not gone. links: rel_path, provider_key.
    """
    gone = stored.join(present.select("rel_path").distinct(), "rel_path", "left_anti")
    for p in unlisted:
        gone = gone.where((F.col("rel_path") != p) & ~F.col("rel_path").startswith(p + "/") if p else F.lit(False))
    lost = links.join(gone.select("rel_path").distinct(), "rel_path", "left_semi").select("provider_key").distinct()
    held = links.join(gone.select("rel_path").distinct(), "rel_path", "left_anti").select("provider_key").distinct()
    return lost.join(held, "provider_key", "left_anti")


def ancestors(path: Column) -> Column:
    """A path's folders from the root (empty) down, and itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def below(paths: DataFrame, tops: DataFrame) -> DataFrame:
    """The paths (root_key, rel_path) at or below one of the folders `tops` of their root.

    Each path is looked up by each of its folders, so it is an equi-join on root and
    folder: no root is one group, and no path is compared with all folders.
    """
    each = paths.select("root_key", "rel_path", F.explode(F.when(F.col("rel_path") == "", F.array(F.lit(""))).otherwise(ancestors(F.col("rel_path")))).alias("_top"))
    return each.join(tops.select("root_key", F.col("rel_path").alias("_top")).distinct(), ["root_key", "_top"], "left_semi").select("root_key", "rel_path").distinct()


def revision(chunked: DataFrame) -> DataFrame:
    """A digest of the set of (chunk_id, content_hash).

    It sums words of each pair's SHA-256, so it is combined before the shuffle
    and no task holds the sorted corpus.
    """
    d = F.sha2(F.concat("chunk_id", F.lit(T.NUL), "content_hash"), 256)
    words = [F.sum(F.conv(F.substring(d, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    text = F.concat_ws(":", F.count("*").cast("string"), *(F.coalesce(w, F.lit(0)).cast("string") for w in words))
    return chunked.agg(F.sha2(text, 256).alias("archive_revision"))


def thread(messages: DataFrame, thread_id: str) -> DataFrame:
    return messages.where(F.col("thread_id") == thread_id).orderBy("date", "message_id")


def thread_context(messages: DataFrame, thread_id: str, message_id: str | None = None) -> DataFrame:
    """A thread's messages, each previous, current or next.

    Without message_id the first is current; with an unknown one, all are next.
    """
    held = messages.where(F.col("thread_id") == thread_id)
    pivot = held if message_id is None else held.where(F.col("message_id") == message_id)
    at = pivot.agg(F.min(F.struct("date", "message_id")).alias("_at"))
    here = F.struct("date", "message_id")
    place = F.when(here < F.col("_at"), "previous").when(here == F.col("_at"), "current").otherwise("next")
    return held.join(F.broadcast(at)).withColumn("place", place).drop("_at")  # one row


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows the ids before and behind each in its thread, a task's number, and at its ends true in _first or _last."""
    task, held, start, none = TaskContext.get().partitionId(), None, True, pa.nulls(1, pa.string())

    def shown(b: pa.RecordBatch, before: pa.RecordBatch | None, behind: pa.RecordBatch | None) -> pa.RecordBatch:
        edge = lambda x, last: (none, none) if x is None else tuple(x.column(c).slice(x.num_rows - 1 if last else 0, 1) for c in ("thread_id", "chunk_id"))
        n, ends = b.num_rows, (edge(before, True), edge(behind, False))
        thread = pa.concat_arrays([ends[0][0].cast(pa.string()), b.column("thread_id").cast(pa.string()), ends[1][0].cast(pa.string())])
        ids = pa.concat_arrays([ends[0][1].cast(pa.string()), b.column("chunk_id").cast(pa.string()), ends[1][1].cast(pa.string())])
        same = pc.fill_null(pc.equal(thread.slice(1), thread.slice(0, n + 1)), False).to_numpy(zero_copy_only=False)
        previous, following = (ids.take(pa.array(np.arange(n) + at, mask=~same[at // 2 : at // 2 + n])) for at in (0, 2))
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[0], last[-1] = before is None, behind is None
        names = [*b.schema.names, "previous_id", "next_id", "_task", "_first", "_last"]
        return pa.RecordBatch.from_arrays([*b.columns, previous, following, pa.array(np.full(n, task, np.int32)), pa.array(first), pa.array(last)], names=names)

    before = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            yield shown(held, before, b)
            before = held
        held = b
    if held is not None:
        yield shown(held, before, None)


def chunk_context(chunked: DataFrame, path: str) -> DataFrame:
    """The chunks before and behind each one in its thread, as previous_id and next_id.

    Rows are dealt out by ranges of thread and place in it, so a thread may span any
    number of tasks, and written sorted below path, a new folder that all tasks share.
    Neighbours within a task are the rows beside each; those over a border follow from
    one row at each end of a task. Chunks without a thread have no neighbours.
    """
    spark = chunked.sparkSession
    order = ["thread_id", "started_at", "message_id", "section", "ordinal", "chunk_id"]
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = StructType([*chunked.schema, *StructType.fromDDL("previous_id string, next_id string, _task int, _first boolean, _last boolean")])
    chunked.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_beside, schema).write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    ends = sorted(out.where("_first OR _last").select("_task", "_first", "_last", "thread_id", "chunk_id").collect(), key=lambda r: (r["_task"], not r["_first"]))  # two rows a task
    over = []
    for a, b in zip((r for r in ends if r["_last"]), [r for r in ends if r["_first"]][1:], strict=False):
        if a.thread_id is not None and a.thread_id == b.thread_id:
            over += [(a["_task"], a.chunk_id, True, b.chunk_id), (b["_task"], b.chunk_id, False, a.chunk_id)]
    border = spark.createDataFrame(over, "_task int, chunk_id string, _end boolean, _other string")
    for end, flag, name in ((True, "_last", "next_id"), (False, "_first", "previous_id")):
        mine = border.where(F.col("_end") == end).select("_task", "chunk_id", F.col("_other").alias("_o"), F.lit(True).alias(flag))
        out = out.join(F.broadcast(mine), ["_task", "chunk_id", flag], "left").withColumn(name, F.coalesce("_o", name)).drop("_o")
    return out.select(*chunked.columns, "previous_id", "next_id")


def to_embed(chunked: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector of the same content: the embedding backlog."""
    return chunked.join(vectors.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")


def reused(chunked: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunked.join(vectors.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi")


def orphans(vectors: DataFrame, chunked: DataFrame) -> DataFrame:
    return vectors.join(chunked.select("chunk_id"), "chunk_id", "left_anti")
