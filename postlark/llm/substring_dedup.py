"""Exact substring deduplication over super-k-mers.

A window is `window` consecutive words. Its minimiser is the smallest hash among
the `k`-word grams inside it. Consecutive windows with one minimiser form a
super-k-mer, which travels as one packed string (its words, joined by spaces) to
the minimiser's bucket. Equal windows have equal minimisers, so they meet; there
they are sorted, and windows that compare equal as strings get the smallest
document that has them.

Before anything travels:
* texts with the same words are one class; all but the copy with the smallest
  id are covered completely, so only that one goes on;
* a minimiser that occurs in one class alone cannot have a repeated window. This
  is found on the smallest and largest class of each minimiser, which tasks
  combine before the shuffle, without any text.

A minimiser with more than `hot` super-k-mers has its bucket split by a hash of
class and place. Each part sorts and compares its windows in the same way; what
loses there has lost, and of the others each different window goes on once for
each part, to be compared as text with those of the other parts. So neither a
passage that a third of all documents share nor a text that repeats one passage
makes a large bucket, and no window is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, fresh, partitions, row_key, stored
from .wordhash import U64, Words, fold_all, mix, shingles, signed, slices, sliding_min, split, windows

_CUT = 64  # windows in a super-k-mer at most; equal windows still share a bucket


def _joined(w: Words, a: int, b: int) -> bytes:
    """Words a to b of one text, joined by one space each."""
    if a >= b:
        return b""
    raw = w.data[w.starts[a] : w.ends[b - 1]].tobytes()
    if len(raw) == int((w.ends[a:b] - w.starts[a:b]).sum()) + b - a - 1 and not any(x in raw for x in b"\t\n\r\x0b\x0c"):
        return raw
    return b" ".join(raw.split())


def _minimisers(h: np.ndarray, window: int, k: int) -> np.ndarray:
    """The minimiser of each window."""
    return sliding_min(mix(shingles(h, k)), window - k + 1) if len(h) >= window else np.zeros(0, U64)


def _class(h: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a word sequence as two signed longs; the first alone goes with minimisers."""
    a, b = fold_all(h, 1), fold_all(h, 2)
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)


def _runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of windows with one minimiser."""
    cut = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else np.zeros(0, np.int64)
    return cut, np.append(cut[1:], len(m))


def _info(df: DataFrame) -> DataFrame:
    """Each row's number of words, class and digest of its words."""
    names = ["doc_id", "r1", "r2", "n_words", "c1", "c2", "sha"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                w = split(part.column("text"))
                cls, sha = [], []
                for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    cls.append(_class(w.hashes[a:z]))
                    sha.append(sha256(_joined(w, a, z)).hexdigest())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), pa.array(w.counts(), pa.int64()), *(pa.array([x[i] for x in cls], pa.int64()) for i in (0, 1)), pa.array(sha, pa.string())], names=names)

    return df.mapInArrow(run, "doc_id long, r1 long, r2 long, n_words long, c1 long, c2 long, sha string")


def _grams(df: DataFrame, window: int, k: int) -> DataFrame:
    """For each text its distinct minimisers, its class and how many super-k-mers each one makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for part in slices(b, "text"):
                w = split(part.column("text"))
                out, cls, n = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    if z - a < window or (c := _class(w.hashes[a:z]))[0] in seen:
                        continue
                    if len(seen) < 1 << 20:  # copies that it misses are combined later
                        seen.add(c[0])
                    m = _minimisers(w.hashes[a:z], window, k)
                    begin, end = _runs(m)
                    of, at = np.unique(m[begin], return_inverse=True)
                    out.append(of)
                    n.append(np.bincount(at, -(-(end - begin) // _CUT), minlength=len(of)).astype(np.int64))
                    cls.append(np.full(len(of), c[0], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(out))), pa.array(np.concatenate(cls)), pa.array(np.concatenate(n).astype(np.int32))], names=["m", "c1", "n"])

    return df.select("text").mapInArrow(run, "m long, c1 long, n int")


_PACKED = "m long, s int, parts int, packed binary, doc_id long, c1 long, c2 long, start int, n int"


def _super(df: DataFrame, window: int, k: int) -> DataFrame:
    """The super-k-mers of texts with minimisers in `flags`."""
    names = [x.split()[0] for x in _PACKED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", 1 << 20):
                w = split(part.column("text"))
                flags, ids, c1, c2 = (part.column(x).to_pylist() for x in ("flags", "doc_id", "c1", "c2"))
                rows: list[tuple] = []
                for i in range(part.num_rows):
                    a = int(w.first[i])
                    m = signed(_minimisers(w.hashes[a : w.first[i + 1]], window, k))
                    wanted = {f["m"]: f["parts"] for f in flags[i]}
                    keys = np.array(sorted(wanted), np.int64)
                    begin, end = _runs(m)
                    mine = np.isin(m[begin], keys)
                    begin, end = begin[mine], end[mine]
                    times = -(-(end - begin) // _CUT)
                    q = np.repeat(begin, times) + _CUT * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
                    n = np.minimum(np.repeat(end, times) - q, _CUT)
                    parts = np.array([wanted[x] for x in m[q].tolist()], np.int64)
                    s = (mix(q.astype(U64) + U64(c1[i] & 0xFFFFFFFFFFFFFFFF)) % parts.astype(U64)).tolist()
                    rows += [(x, y, z, _joined(w, a + p, a + p + g + window - 1), ids[i], c1[i], c2[i], p, g) for x, y, z, p, g in zip(m[q].tolist(), s, parts.tolist(), q.tolist(), n.tolist(), strict=True)]
                    if len(rows) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return df.mapInArrow(run, _PACKED)


def _sorted_out(rows: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """Of whole buckets: word ranges whose windows a smaller document has, and the other windows of split ones."""
    packed = rows.column("packed").combine_chunks()
    m, s, parts, doc, c1, c2, start, n = (rows.column(x).to_numpy() for x in ("m", "s", "parts", "doc_id", "c1", "c2", "start", "n"))
    w = split(packed.cast(pa.string()))
    raw = w.data.tobytes()
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    word = w.first[of] + at
    key = windows(w.hashes, window)[word]
    order = np.lexsort((at, doc[of], key, s[of], m[of]))
    of, at, word, key = of[order], at[order], word[order], key[order]
    begins, ends = w.starts[word], w.ends[word + window - 1]
    new = np.ones(len(of), bool)
    new[1:] = (key[1:] != key[:-1]) | (m[of[1:]] != m[of[:-1]]) | (s[of[1:]] != s[of[:-1]])
    cut = np.flatnonzero(new)
    size = np.diff(np.append(cut, len(of)))
    lost = np.zeros(len(of), bool)
    for a, many in zip(cut[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        first: dict[bytes, int] = {}  # compared as text; hashes only put them in order
        for i, x, y, d in zip(range(a, a + many), begins[a : a + many].tolist(), ends[a : a + many].tolist(), doc[of[a : a + many]].tolist(), strict=True):
            least = first.setdefault(raw[x:y], d)
            lost[i] = d > least
    gone = np.flatnonzero(lost)
    gone = gone[np.lexsort((at[gone], of[gone]))]
    joins = np.zeros(len(gone), bool)
    joins[1:] = (of[gone[1:]] == of[gone[:-1]]) & (at[gone[1:]] == at[gone[:-1]] + 1)
    begin = np.flatnonzero(~joins)
    end = np.append(begin[1:], len(gone)) - 1
    i, z = gone[begin], gone[end] if len(gone) else gone
    none = len(i)
    yield pa.RecordBatch.from_arrays([pa.array(c1[of[i]]), pa.array(c2[of[i]]), pa.array((start[of[i]] + at[i]).astype(np.int32)), pa.array((start[of[z]] + at[z] + window).astype(np.int32)), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary())], names=_FOUND)
    left = np.flatnonzero(~lost & (parts[of] > 1))
    for x in range(0, len(left), 20_000):
        i = left[x : x + 20_000]
        texts = [raw[y:z] for y, z in zip(begins[i].tolist(), ends[i].tolist(), strict=True)]
        begin = (start[of[i]] + at[i]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(c1[of[i]]), pa.array(c2[of[i]]), pa.array(begin), pa.array(begin + np.int32(window)), pa.array(doc[of[i]]), pa.array(texts, pa.binary())], names=_FOUND)


_FOUND = ["c1", "c2", "from", "to", "doc_id", "win"]


def _buckets(df: DataFrame, window: int, rows: int = 5000) -> DataFrame:
    """Rows (c1, c2, from, to) that are lost, and with win and doc_id the windows of split buckets that are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            for x in range(0, b.num_rows, rows):
                part = b.slice(x, rows)
                m, s = (part.column(c).to_numpy() for c in ("m", "s"))
                last = int(np.flatnonzero((m != m[-1]) | (s != s[-1]))[-1]) + 1 if ((m != m[-1]) | (s != s[-1])).any() else 0
                done = held and (held[-1].column("m")[-1].as_py(), held[-1].column("s")[-1].as_py()) != (int(m[-1]), int(s[-1]))
                if last or done:
                    yield from _sorted_out(pa.Table.from_batches([*held, *([part.slice(0, last)] if last else [])]), window)
                    held = []
                held.append(part.slice(last))
        if held:
            yield from _sorted_out(pa.Table.from_batches(held), window)

    return df.mapInArrow(run, "c1 long, c2 long, from int, to int, doc_id long, win binary")


def _merge(ranges: F.Column) -> F.Column:
    """Sorted word ranges, those that touch joined."""
    empty = F.array().cast("array<struct<from:int,to:int>>")

    def add(acc: F.Column, x: F.Column) -> F.Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["to"] >= x["from"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(ranges), empty, add)


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = 12, hot: int = 2000) -> tuple[DataFrame, DataFrame]:
    """What each row loses: (info, ranges).

    info has a row for each row of docs: doc_id, r1 and r2 (a 128-bit hash of id
    and text), n_words, sha (of its words), c1 and c2 (its class), first (doc_id,
    r1 and r2 of its class's row with the smallest id). ranges has for classes
    whose first copy loses words: c1, c2 and `gone`, the sorted, merged word ranges
    that are removed from that copy; every other copy with a larger id and at least
    `window` words loses all words.

    Null texts have no words. Rows with a null id neither lose words nor count as
    a source. Rows with equal ids are one document: none of them takes from the
    other. Ties, repeated rows and empty tables need no more than that.
    """
    spark = docs.sparkSession
    n_parts = partitions(spark)
    r1, r2 = row_key(id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), r1.alias("r1"), r2.alias("r2"))
    info = stored(_info(rows), "words")
    classes = info.where("doc_id IS NOT NULL").groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "r1", "r2")).alias("first"), F.max("n_words").alias("n"))

    pairs = stored(_grams(rows.where("doc_id IS NOT NULL"), window, k), "minimisers")
    total = pairs.groupBy("m").agg(F.min("c1").alias("a"), F.max("c1").alias("b"), F.sum("n").alias("n"))
    shared = total.where("a < b").select("m", F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    doubtful = classes.groupBy("c1").count().where("count > 1").select("c1")  # one first long for several classes
    every = pairs.join(doubtful, "c1", "left_semi").select("m").distinct().join(total, "m").select("m", F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    flags = pairs.join(shared.union(every).distinct(), "m").groupBy("c1").agg(F.collect_set(F.struct("m", "parts")).alias("flags"))
    flagged = classes.where(F.col("n") >= window).join(flags, "c1").select("c1", "c2", "first.r1", "first.r2", "flags")
    texts = stored(rows.join(flagged, ["r1", "r2"]).select("doc_id", "text", "c1", "c2", "flags"), "flagged")
    discard(pairs)

    found = stored(_buckets(_super(texts, window, k).repartition(n_parts, "m", "s").sortWithinPartitions("m", "s"), window), "sorted")
    discard(texts)
    winners = found.where("win IS NOT NULL").withColumns({"h1": F.xxhash64("win"), "h2": F.xxhash64(F.lit(7), "win")})
    met = winners.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h1", "h2")
    again = winners.join(met, ["h1", "h2"], "left_semi")
    least = again.groupBy("win").agg(F.min("doc_id").alias("least"))
    more = again.join(least, "win").where("doc_id > least").select("c1", "c2", "from", "to")
    lost = found.where("win IS NULL").select("c1", "c2", "from", "to").union(more)
    gone = stored(lost.groupBy("c1", "c2").agg(_merge(F.collect_set(F.struct("from", "to"))).alias("gone")), "ranges")
    discard(found)
    return info.join(classes.select("c1", "c2", "first"), ["c1", "c2"], "left"), gone


def _kept(w: Words, i: int, gone: list[dict]) -> tuple[int, bytes]:
    """How many words of text i go, and the rest joined by spaces."""
    a, z = int(w.first[i]), int(w.first[i + 1])
    parts, at, n = [], a, 0
    for r in gone:
        parts.append(_joined(w, at, a + r["from"]))
        at = a + r["to"]
        n += r["to"] - r["from"]
    parts.append(_joined(w, at, z))
    return n, b" ".join(p for p in parts if p)


def _cut_texts(df: DataFrame) -> DataFrame:
    """Adds to rows with text and gone: n_removed, kept (the text that is left)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                w = split(part.column("text"), hashed=False)
                cut = [_kept(w, i, g or []) for i, g in enumerate(part.column("gone").to_pylist())]
                keys = [part.column(i) for i in range(part.num_columns - 2)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([c[0] for c in cut], pa.int64()), pa.array([c[1].decode() for c in cut], pa.string())], names=[*part.schema.names[:-2], "n_removed", "kept"])

    rest = [c for c in df.columns if c not in ("text", "gone")]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(*rest, "text", "gone").mapInArrow(run, f"{kinds}, n_removed long, kept string")


def _loses_all(window: int) -> F.Column:
    return F.coalesce((F.col("doc_id") > F.col("first.doc_id")) & (F.col("n_words") >= window), F.lit(False))


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, **options) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept_sha256 (of the words kept).

    Nulls, ties, repeated rows and empty tables are as repeats() says; other columns
    are not read, so their names cannot clash.
    """
    info, gone = repeats(docs, id_col=id_col, text_col=text_col, window=window, **options)
    r1, r2 = row_key(id_col, text_col)
    texts = docs.select(r1.alias("r1"), r2.alias("r2"), F.col(text_col).cast("string").alias("text"))
    # Only the first copies that lose words are read again.
    owners = info.where("doc_id = first.doc_id").select("c1", "c2", "first.r1", "first.r2").distinct().join(gone, ["c1", "c2"])
    cut = _cut_texts(texts.join(owners, ["r1", "r2"]).select("c1", "c2", "text", "gone")).select("c1", "c2", "n_removed", F.sha2("kept", 256).alias("cut_sha")).dropDuplicates(["c1", "c2"])
    whole = _loses_all(window)
    mine = F.coalesce((F.col("doc_id") == F.col("first.doc_id")) & F.col("n_removed").isNotNull(), F.lit(False))
    return info.join(cut, ["c1", "c2"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).when(mine, F.col("n_removed")).otherwise(0).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).when(mine, F.col("cut_sha")).otherwise(F.col("sha")).alias("kept_sha256"),
    )


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, **options) -> DataFrame:
    """docs without repeated windows: a row's text is what is left of it.

    Rows that lose no word stay as they are; the others' words are joined by one
    space. Rows that lose every word go. Columns may have any names.
    """
    info, gone = repeats(docs, id_col=id_col, text_col=text_col, window=window, **options)
    whole = _loses_all(window)
    mine = F.coalesce(F.col("doc_id") == F.col("first.doc_id"), F.lit(False))
    state = info.where(whole | mine).join(gone, ["c1", "c2"], "left").select("r1", "r2", whole.alias("whole"), F.when(~whole, F.col("gone")).alias("gone")).where("whole OR gone IS NOT NULL").dropDuplicates(["r1", "r2"])
    k1, k2, all_of_it, ranges = fresh(docs.columns, "r1", "r2", "whole", "gone")
    keys = row_key(id_col, text_col)
    left = docs.withColumns({k1: keys[0], k2: keys[1]}).join(state.toDF(k1, k2, all_of_it, ranges), [k1, k2], "left").where(~F.coalesce(F.col(all_of_it), F.lit(False)))
    columns = docs.columns
    as_is = left.where(F.col(ranges).isNull()).select(*columns)
    renamed = left.where(F.col(ranges).isNotNull()).select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(columns) if c != text_col), F.col(text_col).cast("string").alias("text"), F.col(ranges).alias("gone"))
    cut = _cut_texts(renamed).where("kept != ''")
    return as_is.unionByName(cut.select(*(F.col("kept" if c == text_col else f"k{i}").alias(c) for i, c in enumerate(columns))))
