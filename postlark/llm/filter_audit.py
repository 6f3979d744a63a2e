"""Audit of filters: who removes what in each order, and what their overlap hides.

Each document gets a mask, a bit for each filter it fails. Exact duplicates are found by
a sort: rows are dealt out by ranges of text fingerprint and doc_id, so a group of copies
may span many tasks, and sorted there by fingerprint, full text and doc_id. A row fails if
it follows a row of the same text whose first doc_id is smaller. Only the first fingerprint
of a task can go on from the task before: those rows keep a digest of their text, each task
tells the digest and first doc_id of the texts at its two ends, and a join with these few
rows decides. Masks are then added up by part; every figure of every order follows from at
most 32 counters a part.

Null and empty texts are one text without words. A null doc_id is neither smaller than
another nor has it a smaller one; it has no label. Rows repeated with the same doc_id and
text do not make each other fail. Of several labels of a doc_id any counts. An empty table
gives no rows. Columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, partitions, stored

FILTERS = "ABCDE"
_DUPLICATE = 1 << FILTERS.index("E")
_MARKED = "doc_id long, part string, mask int, digest string, edge boolean"


def failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails: short, repetitive, shouting, with symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    conditions = [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * F.char_length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks duplicates in rows sorted by fingerprint, text and doc_id, and tells what stands at both ends."""
    opening = before = None  # the first fingerprint; fingerprint, text and first doc_id of the row before
    edges: dict[str, int | None] = {}
    tail: dict[str, int | None] = {}
    sha = lambda x: hashlib.sha256(x.as_py().encode()).hexdigest()
    for b in batches:
        if not b.num_rows:
            continue
        fp, text, ids = b.column("fp").to_numpy(), b.column("text"), b.column("doc_id")
        opening = fp[0] if opening is None else opening
        new = np.ones(b.num_rows, bool)
        new[1:] = (fp[1:] != fp[:-1]) | ~pc.equal(text.slice(1), text.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[0] = before is None or before[0] != fp[0] or before[1] != text[0].as_py()
        known, value = pc.is_valid(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()
        run = np.cumsum(new) - int(new[0])
        starts = np.flatnonzero(new)
        has, lead = known[starts], value[starts]
        if not new[0]:  # run 0 goes on from the batch before
            has, lead = np.append(before[2] is not None, has), np.append(before[2] or 0, lead)
        late = known & has[run] & (value > lead[run])
        digest = np.full(b.num_rows, None, object)
        for i in np.flatnonzero((fp == opening) & ~late):
            digest[i] = sha(text[int(i)])
        for i in starts[fp[starts] == opening]:
            edges[sha(text[int(i)])] = int(value[i]) if known[i] else None
        if before is None or before[0] != fp[-1]:
            tail = {}
        for i in starts[fp[starts] == fp[-1]]:
            tail[sha(text[int(i)])] = int(value[i]) if known[i] else None
        before = (fp[-1], text[b.num_rows - 1].as_py(), int(lead[-1]) if has[-1] else None)
        mask = b.column("mask").to_numpy() + late * _DUPLICATE
        yield pa.RecordBatch.from_arrays([ids, b.column("part"), pa.array(mask.astype(np.int32)), pa.array(digest, pa.string()), pa.array(np.zeros(b.num_rows, bool))], names=["doc_id", "part", "mask", "digest", "edge"])
    ends = [(k, v) for k, v in (edges | tail).items() if v is not None]
    n = len(ends)
    yield pa.RecordBatch.from_arrays([pa.array([v for _, v in ends], pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array([k for k, _ in ends], pa.string()), pa.array(np.ones(n, bool))], names=["doc_id", "part", "mask", "digest", "edge"])


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part and mask of each document, stored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("fp", F.xxhash64("text"))
    at = F.col("doc_id").asc_nulls_last()
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "fp", at).sortWithinPartitions("fp", "text", at)
    marked = stored(dealt.withColumn("mask", failures(F.col("text"))).mapInArrow(_compare, _MARKED), "masks")
    edges = marked.where("edge").groupBy("digest").agg(F.min("doc_id").alias("_first"))
    again = F.when(F.col("_first") < F.col("doc_id"), _DUPLICATE).otherwise(0)
    decided = marked.where("NOT edge").join(F.broadcast(edges), "digest", "left")  # about two rows a task
    out = decided.select("doc_id", "part", F.col("mask").bitwiseOR(again).alias("mask"))
    out.stored_at = marked.stored_at
    return out


def counters(marked: DataFrame, labels: DataFrame, *, label_id: str = "doc_id") -> DataFrame:
    """part, mask and how many documents have it: n, good, toxic. Counters of disjoint documents add up."""
    one = labels.select(F.col(label_id).cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("doc_id IS NOT NULL")
    one = one.groupBy("doc_id").agg(*(F.coalesce(F.max(c), F.lit(False)).cast("long").alias(c) for c in ("good", "toxic")))
    total = marked.groupBy("part", "mask").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    labelled = marked.join(one, "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    every = total.select("part", "mask", "n", zero.alias("good"), zero.alias("toxic")).unionByName(labelled.select("part", "mask", zero.alias("n"), "good", "toxic"))
    return every.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, *, filters: str = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", label_id: str = "doc_id") -> DataFrame:
    """A row for each part, order of the filters and step, with its counts."""
    marked = masks(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    counted = stored(counters(marked, labels, label_id=label_id), "counters")
    discard(marked)
    bit = lambda i: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.substring(F.col("filter_order"), i, F.lit(1))) - 1)
    before = F.aggregate(F.expr("slice(sequence(0, step), 2, step - 1)"), F.lit(0), lambda s, i: s.bitwiseOR(bit(i)))
    steps = counted.withColumn("filter_order", F.explode(F.lit(["".join(o) for o in permutations(filters)]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    m = F.col("mask")
    fails, earlier = m.bitwiseAND(F.col("bit")) != 0, m.bitwiseAND(F.col("before")) != 0
    of = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).alias("_")
    orders = F.lit(factorial(len(filters)))
    sums = {
        "kept": of("n", ~fails & ~earlier), "removed": of("n", fails & ~earlier), "redundant": of("n", fails & earlier), "unique_fails": of("n", m == F.col("bit")),
        "good_lost": of("good", fails & ~earlier), "toxic_lost": of("toxic", fails & ~earlier),
        "shapley": F.sum(F.when(fails, F.col("n") * (orders / F.bit_count("mask")).cast("long")).otherwise(0)),  # of k filters that it fails each is first in 1 of k orders
    }
    return steps.withColumns({"bit": bit(F.col("step")), "before": before}).groupBy("part", "filter_order", "step").agg(*(c.alias(k) for k, c in sums.items()))
