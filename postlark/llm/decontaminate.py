"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of consecutive words. A window is the
set of its word shingles, and a document contains it only if it has all of them,
so one prefix token is enough: the window's rarest shingle, by counts over all
documents. Documents' shingles are joined with these prefix tokens, each match
fixes where the window would lie (positional bound), windows that would leave
the document go (length bound), and the rest are compared word by word.

Up to `block` windows are broadcast and documents are not shuffled. More windows
are joined: one pass counts shingles in hashed buckets, a second one sends the
places of documents whose shingle may be a prefix token, by a table of bits over
all of these, with the words around, to the token's windows. The number of passes
does not follow the number of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, packed_counts, stored, total_counts
from .wordhash import LOWER, NON_ALNUM, U64, Words, shingles, signed, slices, split

SHINGLE = 3  # words; windows of fewer are one shingle
BUCKETS = 1 << 20  # of counts in the join
_CHUNK = 1024
_MOST_BITS = 1 << 27  # of the table of prefix tokens; beyond, more places pass it
PLACE_ROWS = 1 << 17  # places of one prefix token that travel as one group


def _words(w: Words, i: int) -> tuple[list[bytes], np.ndarray]:
    a, b = w.first[i], w.first[i + 1]
    return [bytes(LOWER[w.data[s:e]]) for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)], w.hashes[a:b]


def item_windows(items: DataFrame, *, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows (words joined by a space) with the item ids that have them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, of, out = b.column(0).to_pylist(), [], []
            w = split(b.column(1), NON_ALNUM, LOWER, hashed=True)
            for i in range(b.num_rows):
                words, _ = _words(w, i)
                for k in range(max(1, len(words) - window + 1)) if words else ():
                    of.append(ids[i])
                    out.append(b" ".join(words[k : k + window]))
            yield pa.RecordBatch.from_pydict({"item": pa.array(of, pa.string()), "win": pa.array(out, pa.binary())})

    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item IS NOT NULL")
    return rows.mapInArrow(cut, "item string, win binary").groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Index:
    """A block of windows, found by the hash of one shingle each."""

    def __init__(self, wins: list[bytes], items: list[list[str]]):
        self.items = items
        self.words = [x.split(b" ") for x in wins]
        joined = split(pa.array([x.decode("utf-8", "surrogateescape") for x in wins], pa.string()), NON_ALNUM, SAME_CASE)
        self.size = np.diff(joined.first)
        self.hashes = joined.hashes
        self.first = joined.first[:-1]
        keys, of, place = [], [], []
        for i, n in enumerate(self.size):
            h = joined.hashes[joined.first[i] : joined.first[i + 1]]
            s = shingles(h, min(SHINGLE, n)) ^ U64(min(SHINGLE, n))
            keys.append(s)
            of.append(np.full(len(s), i))
            place.append(np.arange(len(s)))
        self.keys, self.of, self.place = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((keys, U64), (of, np.int64), (place, np.int64)))
        self.sizes = sorted({int(min(SHINGLE, n)) for n in self.size})

    def keep_rarest(self, n: np.ndarray) -> None:
        """Leaves each window its prefix: the shingle with the smallest (count, hash), at its first place; n are the counts of keys."""
        order = np.lexsort((self.place, self.keys, n, self.of))
        at = order[np.unique(self.of[order], return_index=True)[1]]
        at = at[np.argsort(self.keys[at], kind="stable")]
        self.keys, self.of, self.place = self.keys[at], self.of[at], self.place[at]

    def probes(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in h whose shingle is a key, and that shingle's place among the sorted keys."""
        for k in self.sizes:
            s = shingles(h, k) ^ U64(k)
            at = np.searchsorted(self.keys, s)
            at[at == len(self.keys)] = 0
            found = np.flatnonzero(self.keys[at] == s) if len(self.keys) else np.zeros(0, np.int64)
            yield found, s[found]


SAME_CASE = np.arange(256, dtype=np.uint8)


def _count(docs: DataFrame, index, keys: np.ndarray) -> np.ndarray:
    """How often all documents have each of the block's shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        keys = np.unique(ix.keys)
        total = np.zeros(len(keys), np.int64)
        for b in batches:
            for part in slices(b, "text"):
                w = split(part.column("text"), NON_ALNUM, LOWER)
                for k in ix.sizes:
                    s = shingles(w.hashes, k) ^ U64(k)  # those across two texts only blur a count
                    at = np.searchsorted(keys, s)
                    at[at == len(keys)] = 0
                    total += np.bincount(at[keys[at] == s], minlength=len(keys))
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(signed(keys[here]), pa.int64()), "n": pa.array(total[here], pa.int64())})

    got = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    distinct = np.unique(keys)
    total = np.zeros(len(distinct), np.int64)
    total[np.searchsorted(distinct, got["k"].to_numpy().view(U64))] = got["n"].to_numpy()
    return total[np.searchsorted(distinct, keys)]


def _bucket(s: np.ndarray, n: int) -> np.ndarray:
    """The top bits of hashes; n is a power of two."""
    return (s >> U64(65 - n.bit_length())).astype(np.int64)


def _bucket_counts(docs: DataFrame, sizes: list[int]) -> np.ndarray:
    """How often all documents have the shingles of each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for part in slices(b, "text"):
                w = split(part.column("text"), NON_ALNUM, LOWER)
                for k in sizes:
                    total += np.bincount(_bucket(shingles(w.hashes, k) ^ U64(k), BUCKETS), minlength=BUCKETS)
        at, packed = packed_counts(total, _CHUNK)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(at, pa.int32()), "counts": pa.array(packed, pa.binary())})

    return total_counts(docs.select("text").mapInArrow(count, "chunk int, counts binary"), BUCKETS, _CHUNK)


def _groups(counts: np.ndarray, s: np.ndarray, place_rows: int) -> np.ndarray:
    """Into how many groups the places of shingles are dealt: by the counts of their buckets, which are not too small."""
    return np.maximum(1, -(-counts[_bucket(s, BUCKETS)] // place_rows))


def _tokens(wins: DataFrame, counts, place_rows: int) -> DataFrame:
    """Each window with its prefix token (key), where in the window that is and the groups of the token's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ix = Index(b.column("win").to_pylist(), b.column("items").to_pylist())
            ix.keep_rarest(counts.value[_bucket(ix.keys, BUCKETS)])
            of = pa.array(ix.of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(ix.keys), pa.int64()), pa.array(ix.place, pa.int32()), pa.array(ix.size[ix.of], pa.int32()), b.column("win").take(of).cast(pa.string()), b.column("items").take(of), pa.array(_groups(counts.value, ix.keys, place_rows), pa.int64())],
                names=["key", "place", "size", "win", "items", "groups"],
            )

    return wins.select("win", "items").mapInArrow(run, "key long, place int, size int, win string, items array<string>, groups long")


def _bits(tokens: DataFrame, n: int) -> np.ndarray:
    """A table of n bits with those of all prefix tokens set."""
    at = F.shiftrightunsigned("key", 65 - n.bit_length())
    words = tokens.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(n // 64, U64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(U64)
    return out


def _places(docs: DataFrame, bits, n: int, sizes: list[int], window: int, counts, place_rows: int) -> DataFrame:
    """Places of documents whose shingle may be a prefix token, with all words that a window there could have, and one of its groups.

    The group is drawn from the document and the place, so one long text fills several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                w = split(part.column("text"), NON_ALNUM, LOWER)
                text_of = w.text_of()
                for k in sizes:
                    s = shingles(w.hashes, k) ^ U64(k)
                    bit = _bucket(s, n)
                    ok = (bits.value[bit >> 6] >> (bit & 63).astype(U64) & U64(1)).astype(bool)
                    at = np.flatnonzero(ok)
                    of = text_of[at]
                    at, of = (x[at + k <= w.first[of + 1]] for x in (at, of))
                    for i in range(0, len(at), 8192):
                        here, doc = at[i : i + 8192], of[i : i + 8192]
                        lo, hi = np.maximum(w.first[doc], here - (window - k)), np.minimum(w.first[doc + 1], here + window)
                        around = [b" ".join(LOWER[w.data[x:y]].tobytes() for x, y in zip(w.starts[p:q], w.ends[p:q], strict=True)) for p, q in zip(lo.tolist(), hi.tolist(), strict=True)]
                        key, place = s[here], here - w.first[doc]
                        drawn = (part.column("r1").to_numpy().view(U64)[doc] + place.astype(U64)) % _groups(counts.value, key, place_rows).astype(U64)
                        yield pa.RecordBatch.from_arrays(
                            [*(part.column(c).take(pa.array(doc)) for c in ("r1", "r2")), pa.array(signed(key), pa.int64()), pa.array(place, pa.int32()), pa.array(here - lo, pa.int32()), pa.array(around, pa.binary()).cast(pa.string()), pa.array(drawn.astype(np.int64))],
                            names=["r1", "r2", "key", "at", "before", "around", "group"],
                        )

    return docs.select("r1", "r2", "text").mapInArrow(run, "r1 long, r2 long, key long, at int, before int, around string, group long")


def _joined(docs: DataFrame, wins: DataFrame, total: int, window: int, place_rows: int) -> DataFrame:
    """The join for any number of windows: r1, r2 of documents, their spans and items, where there are any."""
    spark = docs.sparkSession
    count = F.least(F.lit(SHINGLE), F.size(F.split(F.col("win").cast("string"), " ")))
    sizes = sorted(r[0] for r in wins.select(count).distinct().collect())  # 1 to SHINGLE
    counts = spark.sparkContext.broadcast(_bucket_counts(docs, sizes))
    tokens = stored(_tokens(wins, counts, place_rows), "tokens")
    n = min(_MOST_BITS, max(1 << 16, 1 << (16 * total).bit_length()))
    bits = spark.sparkContext.broadcast(_bits(tokens, n))
    places = _places(docs, bits, n, sizes, window, counts, place_rows).dropDuplicates(["r1", "r2", "key", "at"])
    dealt = tokens.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    start = F.col("before") - F.col("place")
    words = F.split("around", " ")
    hits = (
        places.join(dealt, ["key", "group"])
        .where((start >= 0) & (start + F.col("size") <= F.size(words)))
        .where(F.array_join(F.slice(words, F.greatest(start, F.lit(0)) + 1, F.col("size")), " ") == F.col("win"))
        .select("r1", "r2", (F.col("at") - F.col("place")).alias("from"), (F.col("at") - F.col("place") + F.col("size")).alias("to"), "items")
    )
    found = hits.groupBy("r1", "r2").agg(F.collect_set(F.struct("from", "to")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    schema = found.schema

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"from": a, "to": z} for a, z in _merged([(x["from"], x["to"]) for x in row])] for row in b.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("r1"), b.column("r2"), pa.array(spans, _SPANS), b.column("items")], names=schema.names)

    return found.mapInArrow(merge, "r1 long, r2 long, spans array<struct<from:int,to:int>>, items array<string>")


def _matches(ix: Index, w: Words, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts in text i of the windows that occur there, and which windows these are."""
    a, b = w.first[i], w.first[i + 1]
    h, starts, wins = w.hashes[a:b], [], []
    for found, keys in ix.probes(h):
        lo, hi = np.searchsorted(ix.keys, keys), np.searchsorted(ix.keys, keys, side="right")
        n = hi - lo
        which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        start, win = np.repeat(found, n) - ix.place[which], ix.of[which]
        ok = (start >= 0) & (start + ix.size[win] <= len(h))
        starts.append(start[ok])
        wins.append(win[ok])
    start, win = np.concatenate(starts), np.concatenate(wins)
    k = 0
    while len(start) and k < ix.size.max():  # a word more at a time
        far = np.minimum(k, ix.size[win] - 1)
        ok = h[start + far] == ix.hashes[ix.first[win] + far]
        start, win, k = start[ok], win[ok], k + 1
    same = np.array([all(bytes(LOWER[w.data[w.starts[a + s + j] : w.ends[a + s + j]]]) == x for j, x in enumerate(ix.words[v])) for s, v in zip(start.tolist(), win.tolist(), strict=True)], bool)
    return start[same], win[same]


_SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block: int = 100_000, place_rows: int = PLACE_ROWS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Finds where whole windows of benchmark items occur in documents.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
    Adds to the columns `keep` (id_col alone if None): n_words, spans (merged word
    ranges `from` up to `to`), items (sorted ids of items with a window there).
    One row for each row of docs, whatever the ids. Null and empty texts have no
    words; items with a null id or no word have no window; an empty benchmark
    hits nothing. Long texts are read whole. Repeated items and windows count
    once for each item id. Where `keep` has one of the new names, the new one gets
    underscores in front. Up to `block` windows are broadcast, more are joined; both
    give the same rows. In the join the places of one prefix token are dealt to groups of
    about `place_rows`, however many there are.
    """
    wins = stored(item_windows(items, item_col=item_col, text_col=item_text_col, window=window), "windows")
    total = wins.count()
    kept = keep if keep is not None else (id_col,)
    text, named = F.col(text_col).cast("string"), [F.col(c).alias(f"k{i}") for i, c in enumerate(kept)]
    ends = ["n_words", "spans", "items"]
    if total <= block:
        found = _looked_up(docs.select(*named, text.alias("text")), wins)
    else:
        kind = F.when(F.col(id_col).isNull(), 1).otherwise(0) + F.when(text.isNull(), 2).otherwise(0)  # a null hashes as nothing
        keys = [F.xxhash64(F.lit(x), kind, F.col(id_col), text).alias(f"r{x}") for x in (1, 2)]  # 128 bits; equal for repeated rows alone
        hits = _joined(docs.select(*keys, text.alias("text")), wins, total, window, place_rows)
        n_words = F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words")
        found = docs.select(*keys, *named, n_words).join(hits, ["r1", "r2"], "left").withColumns({c: F.coalesce(F.col(c), F.array().cast(hits.schema[c].dataType)) for c in ends[1:]})
    return found.select(*(f"k{i}" for i in range(len(kept))), *ends).toDF(*kept, *fresh(kept, *ends))


def _looked_up(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """The join with a block of windows that is broadcast: the columns of docs, n_words, spans, items."""
    spark = docs.sparkSession
    rows = wins.toArrow()
    index = Index(rows["win"].to_pylist(), rows["items"].to_pylist())
    if len(index.keys):
        held = spark.sparkContext.broadcast(index)
        index.keep_rarest(_count(docs, held, index.keys))
        held.unpersist()
    held = spark.sparkContext.broadcast(index)
    schema = T.StructType(docs.schema.fields[:-1] + T.StructType.fromDDL("n_words long, spans array<struct<from:int,to:int>>, items array<string>").fields)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for b in batches:
            for part in slices(b, "text"):
                w = split(part.column("text"), NON_ALNUM, LOWER)
                spans, items = [], []
                hit = np.zeros(len(w.hashes) + 1, bool)
                if len(ix.keys):
                    for found, _ in ix.probes(w.hashes):
                        hit[found] = True
                any_hit = np.add.reduceat(hit, np.minimum(w.first[:-1], len(hit) - 1)) * (w.counts() > 0) if part.num_rows else []
                for i in range(part.num_rows):
                    mine, ids = [], set()
                    if any_hit[i]:
                        start, win = _matches(ix, w, i)
                        mine = _merged([(int(s), int(s + ix.size[v])) for s, v in zip(start, win, strict=True)])
                        ids.update(x for v in set(win.tolist()) for x in ix.items[v])
                    spans.append([{"from": a, "to": z} for a, z in mine])
                    items.append(sorted(ids))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(w.counts(), pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=schema.names)

    return docs.mapInArrow(match, schema)


#: A word, for counting: letters and digits of ASCII, and all beyond it.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs without a window of an item, with their columns, whatever these are called."""
    found = decontaminate(docs, items, keep=tuple(docs.columns), **options)
    return found.where(F.size(F.col(found.columns[-1])) == 0).select(*docs.columns)


def n_hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
