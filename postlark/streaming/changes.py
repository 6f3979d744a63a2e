"""What a stream of messages changes, kept by key over all of its batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postlark.streaming.ingest import Change, Snapshots

CHANGES = "changes"
_COMBINED = "key string, first string, last string, hash string, thread string, n long"
_STATE = "first string, last string, hash string, thread string, n long, base string"
_OUT = "key string, change string, thread string, first string, last string, n long"


def _combine(rows: pd.DataFrame) -> pd.DataFrame:
    """One row a key: the least and the greatest place, what stands at the greatest, and how many rows there were."""
    rows = rows.sort_values(["last", "hash", "thread"], na_position="first", kind="stable")
    ends = rows.groupby("key", sort=False).agg(first=("first", "min"), n=("n", "sum"))
    return rows.groupby("key", sort=False).tail(1).drop(columns=["first", "n"]).merge(ends, left_on="key", right_index=True)


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield _combine(b)[["key", "first", "last", "hash", "thread", "n"]]


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state of a key after more rows; a batch at a time is held."""
    none = lambda v: None if pd.isna(v) else v
    order = lambda last, *rest: (last, *((v is not None, v or "") for v in rest))  # noqa: E731  (null before all texts)
    held = state.get if state.exists else None
    first, best, n, base = (held[0], tuple(held[1:4]), held[4], held[5]) if held else (None, None, 0, None)
    for b in batches:  # few rows, combined before, so plain values cost less than a frame's operations
        base = none(b["base"].iloc[0]) if best is None else base
        for f, *place, m in zip(b["first"], b["last"], b["hash"], b["thread"], b["n"], strict=True):
            place = tuple(map(none, place))
            first = f if first is None or f < first else first
            best = place if best is None or order(*place) >= order(*best) else best
            n += int(m)
    last, hashed, thread = best
    state.update((first, last, hashed, thread, n, base))
    change = "added" if base is None else "unchanged" if base == hashed else "updated"
    yield pd.DataFrame({"key": [key[0]], "change": [change], "thread": [thread], "first": [first], "last": [last], "n": [n]})


def changes(source: DataFrame, *, key: str, order: str, hash_col: str, thread: str, stored: DataFrame | None = None) -> DataFrame:
    """Streams, for each key of a batch, what has become of it since before the stream.

    key, change (added, updated, unchanged), thread, first and last (the least and the
    greatest `order`, a text, over all batches), n (rows so far). What stands at the greatest
    `order` counts, then by hash and thread. As least, greatest and sum do not ask for an
    order, a stream read in any number of batches ends with the same rows as one batch.
    `stored` (key, hash) is what was there before; rows with a null key or order are left out.

    Rows of a key are combined in each task's batches before they are shuffled, so that a
    key with a third of all rows stays cheap, and then in a state of one row.
    """
    text = lambda c: F.col(c).cast("string")
    rows = source.select(text(key).alias("key"), text(order).alias("first"), text(order).alias("last"), text(hash_col).alias("hash"), text(thread).alias("thread"), F.lit(1).cast("long").alias("n"))
    rows = rows.where(F.col("key").isNotNull() & F.col("first").isNotNull()).mapInPandas(_combined, _COMBINED)
    if stored is None:
        rows = rows.withColumn("base", F.lit(None).cast("string"))
    else:
        known = stored.select(text(stored.columns[0]).alias("key"), F.coalesce(text(stored.columns[1]), F.lit("")).alias("base")).dropDuplicates(["key"])
        rows = rows.join(known, "key", "left")
    return rows.groupBy("key").applyInPandasWithState(_advance, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def follow(streamed: DataFrame, into: Snapshots, checkpoint: str) -> StreamingQuery:
    """Starts keeping the rows of changes() in the table `changes`, the newest of each key, exactly once for each batch."""

    def publish(batch: DataFrame, i: int) -> None:
        done = into.read("change_batches")
        if done is not None and not done.where((F.col("stream") == checkpoint) & (F.col("batch") >= i)).isEmpty():
            return
        mine = into.spark.createDataFrame([(checkpoint, i)], "stream string, batch long")
        kept = mine if done is None else done.where(F.col("stream") != checkpoint).unionByName(mine)
        into.publish({CHANGES: Change(("key",), into.staged(batch)), "change_batches": kept})

    return streamed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(availableNow=True).start()


def counters(kept: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """added, updated, unchanged, repeated (rows beyond a key's first) and touched_threads of a table of changes."""
    count = lambda c: F.count_if(F.col("change") == c).alias(c)
    touched = F.when(F.col("change") != "unchanged", F.col("thread"))
    return kept.groupBy(*by).agg(count("added"), count("updated"), count("unchanged"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"), F.countDistinct(touched).alias("touched_threads"))
