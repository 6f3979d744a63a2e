"""Exact Jaccard similarity join on word shingles, and its connected components.

Texts with equal shingle sets are one class and are joined once. For the classes
a prefix filter finds candidates: with shingles in one global order, rare first,
two sets of similarity t share a shingle within their first n - ceil(t n) + 1.
The order is by counts over all documents, kept for hashed buckets, then by hash;
any fixed order is exact, a good one only makes fewer candidates. Candidates pass
a length filter, a positional filter (what can still follow in both), and a
suffix filter: every class has a sketch, the parities of how many of its shingles
fall on each of some bits, and two sets differ in as many shingles as their
sketches in bits, at least. What is left is verified on the full sets, once for
each pair.

A shingle shared by a large group of near copies would make all pairs of the
group. Only links that join components matter for them, so the members of a
shingle's list are first compared with one pivot: the member that has the shingle
earliest, as the text that others were copied from has the fewest rare shingles
before it. Then members of a list that are still in different components are
compared, at first each with the nearest one by sketch, then every pair that is
left, so no link between components is lost. links() skips the pivots and gives
every link.

Lists that the counts show to be long are split by a hash of the class, and the
comparison inside a list is dealt out in blocks, so a task holds a bounded part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, fresh, packed_counts, partitions, row_key, stored, total_counts
from .wordhash import LOWER, SPACE, U64, fold_all, mix, shingles, signed, slices, split

BUCKETS = 1 << 20
_CHUNK = 1024
_MOST_BITS = 1 << 13  # of a sketch


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text; fewer words than k make one, none make none."""
    w = split(column, SPACE, LOWER)
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        h = w.hashes[a:z]
        yield np.unique(shingles(h, min(k, len(h))) ^ U64(min(k, len(h)))) if len(h) else h


def _class(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set as two signed longs; the first one alone finds candidates."""
    a, b = fold_all(s, 3), fold_all(s, 4)
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> U64(44)).astype(np.int64)


def _sketch(s: np.ndarray) -> bytes:
    """A bit for each of about 2 to 4 len(s) places: whether an odd number of shingles falls there."""
    size = min(max(64, 1 << (2 * len(s) - 1).bit_length()), _MOST_BITS) if len(s) else 64
    return np.packbits((np.bincount((s & U64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def _folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Sketches, a row each, at a smaller number of bytes."""
    while sketches.shape[1] > size:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits rows of x and y differ."""
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def _info(rows: DataFrame, k: int) -> DataFrame:
    """A row for each document (chunk null) and, from each task, counts of shingle buckets."""
    names = ["doc_id", "r1", "r2", "n", "c1", "c2", "sketch", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for part in slices(b, "text"):
                sets = list(_sets(part.column("text"), k))
                if sets:
                    counts += np.bincount(_bucket(np.concatenate(sets)), minlength=BUCKETS)
                cls = [_class(s) for s in sets]
                none = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names[:3]), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([c[i] for c in cls], pa.int64()) for i in (0, 1)), pa.array([_sketch(s) for s in sets], pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())],
                    names=names,
                )
        at, packed = packed_counts(counts, _CHUNK)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), pa.int64()) for _ in range(6)), pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return rows.mapInArrow(run, "doc_id long, r1 long, r2 long, n long, c1 long, c2 long, sketch binary, chunk int, counts binary")


def _need(n: np.ndarray | int, percent: int):
    """ceil(percent / 100 * n)."""
    return -(-n * percent // 100)


def _needed(total, percent: int):
    """The overlap that sets of `total` shingles together need: ceil(t / (1 + t) * total)."""
    return -(-total * percent // (100 + percent))


def _fits(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, percent: int) -> np.ndarray:
    """Length and positional filter of pairs that share the shingle at p1 and p2."""
    n1, p1, n2, p2 = (x.astype(np.int64) for x in (n1, p1, n2, p2))
    return (np.minimum(n1, n2) * 100 >= percent * np.maximum(n1, n2)) & (np.minimum(n1 - p1, n2 - p2) >= _needed(n1 + n2, percent))


def _narrow(x: np.ndarray) -> bytes:
    """Integers from 0 on in as few bytes as the largest needs."""
    return x.astype(next(d for d in (np.uint8, np.uint16, np.uint32) if not len(x) or x.max() <= np.iinfo(d).max)).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int32)


def _shares(t: np.ndarray, freq: np.ndarray, list_rows: int) -> np.ndarray:
    """In how many parts the lists of shingles are cut."""
    return -(-freq[_bucket(t)].astype(np.int64) // list_rows)


def _prefixes(rows: DataFrame, counts, k: int, percent: int, n_buckets: int, list_rows: int) -> DataFrame:
    """Prefix shingles, gathered by bucket: parallel arrays of shingle, class, place and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = np.frombuffer(counts.value, np.uint32)
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            t, c, p, n = (np.concatenate(x) for x in zip(*held, strict=True))
            shares = _shares(t, freq, list_rows)
            to = (mix(t ^ np.where(shares > 1, mix(c.view(U64)) % shares.clip(1).astype(U64), U64(0))) % U64(n_buckets)).astype(np.int32)
            order = np.lexsort((t, to))
            t, c, p, n, to = (x[order] for x in (t, c, p, n, to))
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            ends = np.append(cut[1:], len(to))
            ranges = list(zip(cut.tolist(), ends.tolist(), strict=True))
            pieces = [[x[a:z].tobytes() for a, z in ranges] for x in (t, c)] + [[_narrow(x[a:z]) for a, z in ranges] for x in (p, n)]
            yield pa.RecordBatch.from_arrays([pa.array(to[cut]), *(pa.array(x, pa.binary()) for x in pieces)], names=["bucket", "t", "c", "p", "n"])

        for b in batches:
            for part in slices(b, "text"):
                for s in _sets(part.column("text"), k):
                    n = len(s)
                    if not n or (c := _class(s)) in seen:
                        continue
                    if len(seen) < 1 << 19:  # copies that it misses go later
                        seen.add(c)
                    m = n - _need(n, percent) + 1
                    order = np.lexsort((s, freq[_bucket(s)]))[:m]
                    held.append((s[order], np.full(m, c[0], np.int64), np.arange(m, dtype=np.int32), np.full(m, n, np.int32)))
                    size += m
                    if size > 1 << 20:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return rows.select("text").mapInArrow(run, "bucket int, t binary, c binary, p binary, n binary")


def _lists(gathered: DataFrame, counts, percent: int, list_rows: int) -> DataFrame:
    """Lists of the shingles that several classes have in their prefixes, a row for each member.

    m is the members of the list (or of its part), v its pivot, near whether the
    member and the pivot pass the filters, cut whether the list has more parts.
    """
    kinds = pa.schema([("t", pa.int64()), ("c", pa.int64()), ("p", pa.int32()), ("n", pa.int32()), ("m", pa.int32()), ("v", pa.int64()), ("near", pa.bool_()), ("cut", pa.bool_())])

    def run(batch: pa.Table) -> pa.Table:
        raw = [batch.column(x).to_pylist() for x in ("t", "c", "p", "n")]
        t, c = (np.concatenate([np.frombuffer(x, d) for x in part]) for part, d in zip(raw[:2], (U64, np.int64), strict=True))
        p, n = (np.concatenate([_wide(x, len(like) // 8) for x, like in zip(part, raw[0], strict=True)]) for part in raw[2:])
        order = np.lexsort((c, n, p, t))
        t, c, p, n = t[order], c[order], p[order], n[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1]) | (p[1:] != p[:-1]) | (n[1:] != n[:-1])  # a class may come from several tasks
        t, c, p, n = t[new], c[new], p[new], n[new]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        m = np.diff(np.append(first, len(t)))
        cut = _shares(t[first], np.frombuffer(counts.value, np.uint32), list_rows) > 1
        pivot = np.repeat(first, m)
        keep = np.repeat((m > 1) | cut, m)
        near = _fits(n, p, n[pivot], p[pivot], percent)
        cols = [signed(t), c, p, n, np.repeat(m, m).astype(np.int32), c[pivot], near, np.repeat(cut, m)]
        return pa.Table.from_arrays([pa.array(x[keep]) for x in cols], schema=kinds)

    return gathered.groupBy("bucket").applyInArrow(run, "t long, c long, p int, n int, m int, v long, near boolean, cut boolean")


def _pivoted(lists: DataFrame) -> DataFrame:
    """Candidates (a, b) of each list: its members with its pivot, and the pivots of its parts with the first of them."""
    near = lists.where("near AND c != v").select("c", "v")
    heads = lists.where("cut AND c = v").select("t", "p", "n", "c")
    lead = heads.groupBy("t").agg(F.min(F.struct("p", "n", "c"))["c"].alias("v"))
    near = near.unionByName(heads.join(lead, "t").where("c != v").select("c", "v"))
    return near.select(F.least("c", "v").alias("a"), F.greatest("c", "v").alias("b")).distinct()


_PAIR = "a1 long, a2 long, b1 long, b2 long"


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) as pairs of classes that pass the length and the suffix filter."""
    of = lambda x: classes.select(F.col("c1").alias(x), F.col("c2").alias(f"{x}2"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & ((F.col("a") != F.col("b")) | (F.col("a2") < F.col("b2"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(x).to_numpy() for x in ("na", "nb"))
            x, y = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            sizes = np.array([(len(u), len(v)) for u, v in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
            far = np.zeros(len(x), np.int64)
            for u, v in np.unique(sizes, axis=0).tolist():
                at = np.flatnonzero((sizes == (u, v)).all(1))
                rows = [np.frombuffer(b"".join(side[i] for i in at.tolist()), np.uint8).reshape(len(at), -1) for side in (x, y)]
                far[at] = _apart(*(_folded(r, min(u, v)) for r in rows))
            ok = pa.array(far <= na + nb - 2 * _needed(na + nb, percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "a2", "b", "b2")], names=["a1", "a2", "b1", "b2"])

    return both.select("a", "a2", "b", "b2", "na", "nb", "sa", "sb").mapInArrow(run, _PAIR)


def _across(members: DataFrame, percent: int, block: int, nearest: bool) -> DataFrame:
    """Pairs of members of a list in different components that pass all filters; with
    nearest, of each member and block only the pair with the nearest sketch.

    members: t, m, c1, c2, p, n, k1, k2 (the component), sketch. A list is dealt out to
    pairs of its parts, so a group has about 2 block members.
    """
    s = F.ceil(F.col("m") / block).cast("int")
    dealt = members.withColumn("s", s).withColumn("mine", F.pmod(F.xxhash64("c1", "c2"), F.col("s")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = dealt.select("t", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "c1", "c2", "p", "n", "k1", "k2", "sketch")
    names = ["a1", "a2", "b1", "b2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rest = None, []
        for b in batches:
            keys = np.stack([b.column(x).to_numpy().astype(np.int64) for x in ("t", "lo", "hi")])
            cut = np.flatnonzero((np.diff(keys, prepend=keys[:, :1] - 1) != 0).any(0)).tolist()
            for a, z in zip(cut, [*cut[1:], b.num_rows], strict=True):
                if (now := tuple(keys[:, a])) != key:
                    yield from found(rest)
                    key, rest = now, []
                rest.append(b.slice(a, z - a))
        yield from found(rest)

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts) if parts else None
        if rows is None or rows.num_rows < 2:
            return
        c1, c2, p, n, k1, k2, mine = (rows.column(x).to_numpy().astype(np.int64) for x in ("c1", "c2", "p", "n", "k1", "k2", "mine"))
        two = bool((mine != mine[0]).any())
        order = np.lexsort((c1, n))
        c1, c2, p, n, k1, k2, mine = (x[order] for x in (c1, c2, p, n, k1, k2, mine))
        held = rows.column("sketch").to_pylist()
        held = [held[i] for i in order.tolist()]
        width = np.array([len(x) for x in held])
        at_width, firsts = {}, {}
        for w in np.unique(width).tolist():  # longer sets have no shorter sketches
            firsts[w] = int(np.searchsorted(width, w))
            parts_of = [_folded(np.frombuffer(b"".join(x for x in held[firsts[w] :] if len(x) == v), np.uint8).reshape(-1, v), w) for v in np.unique(width[firsts[w] :]).tolist()]
            at_width[w] = np.concatenate(parts_of)
        best = np.full(len(n), 2.0)
        partner = np.full(len(n), -1)
        xs, ys = [], []
        for i in range(len(n) - 1):
            z = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
            js = np.arange(i + 1, z)
            js = js[((k1[js] != k1[i]) | (k2[js] != k2[i])) & (~np.full(len(js), two) | (mine[js] != mine[i]))]
            js = js[_fits(np.full(len(js), n[i]), np.full(len(js), p[i]), n[js], p[js], percent)]
            if not len(js):
                continue
            w = int(width[i])
            far = _apart(at_width[w][js - firsts[w]], at_width[w][i - firsts[w]][None, :])
            limit = n[i] + n[js] - 2 * _needed(n[i] + n[js], percent)
            ok = far <= limit
            js, share = js[ok], (far[ok] / np.maximum(limit[ok], 1))
            if nearest and len(js):
                nearer = js[share < best[js]]
                best[nearer], partner[nearer] = share[share < best[js]], i
                if share.min() < best[i]:
                    best[i], partner[i] = share.min(), js[np.argmin(share)]
            else:
                xs.append(np.full(len(js), i))
                ys.append(js)
            if sum(map(len, ys)) > 1 << 18:
                yield out(np.concatenate(xs), np.concatenate(ys), c1, c2)
                xs, ys = [], []
        if nearest:
            xs, ys = [np.flatnonzero(partner >= 0)], [partner[partner >= 0]]
        if xs:
            yield out(np.concatenate(xs), np.concatenate(ys), c1, c2)

    def out(x: np.ndarray, y: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> pa.RecordBatch:
        swap = (c1[x] > c1[y]) | ((c1[x] == c1[y]) & (c2[x] > c2[y]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (c1[x], c2[x], c1[y], c2[y])], names=names)

    keys = ["t", "lo", "hi"]
    return dealt.repartition(partitions(members.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, _PAIR).distinct()


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough. Sets are made of one text for each class that is in a pair."""
    wanted = pairs.select(F.col("a1").alias("c1"), F.col("a2").alias("c2")).union(pairs.select("b1", "b2")).distinct()
    wanted = wanted.join(classes.select("c1", "c2", "r1", "r2"), ["c1", "c2"])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                yield pa.RecordBatch.from_arrays([part.column("c1"), part.column("c2"), pa.array([s.tobytes() for s in _sets(part.column("text"), k)], pa.binary())], names=["c1", "c2", "s"])

    sets = rows.select("r1", "r2", "text").join(wanted, ["r1", "r2"]).select("c1", "c2", "text").mapInArrow(to_sets, "c1 long, c2 long, s binary").dropDuplicates(["c1", "c2"])
    sets = stored(sets, "sets")
    both = pairs.join(sets.toDF("a1", "a2", "x"), ["a1", "a2"]).join(sets.toDF("b1", "b2", "y"), ["b1", "b2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * same >= percent * (len(x) + len(y) - same))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a1", "a2", "b1", "b2")], names=["a1", "a2", "b1", "b2"])

    links = stored(both.select("a1", "a2", "b1", "b2", "x", "y").mapInArrow(run, _PAIR), "links")
    discard(sets)
    return links


def _members(lists: DataFrame, classes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Members of the lists that may still hide a link, as _across() takes them.

    groups: c1, c2, k1, k2, the component of classes that have links. A list of two
    whose members were compared as pivot and other has none.
    """
    of = classes.select(F.col("c1").alias("c"), "c2")
    if groups is None:
        of = of.withColumns({"k1": F.col("c"), "k2": F.col("c2")})
        open_lists = lists.groupBy("t").agg(F.count("*").alias("size")).where("size > 1")
        parts = lists.select("t", "c", "p", "n").join(of, "c")
    else:
        of = of.join(groups.withColumnRenamed("c1", "c"), ["c", "c2"], "left").select("c", "c2", F.coalesce("k1", "c").alias("k1"), F.coalesce("k2", "c2").alias("k2"))
        parts = lists.where("m > 2 OR cut").select("t", "c", "p", "n").join(of, "c")
        k = F.struct("k1", "k2")
        open_lists = parts.groupBy("t").agg(F.count("*").alias("size"), F.min(k).alias("least"), F.max(k).alias("most")).where("size > 2 AND least < most")
    held = parts.join(open_lists.select("t", F.col("size").alias("m")), "t").withColumnRenamed("c", "c1")
    return held.join(classes.select("c1", "c2", "sketch"), ["c1", "c2"]).select("t", "m", "c1", "c2", "p", "n", "k1", "k2", "sketch")


def _prepared(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, bucket_rows: int, list_rows: int) -> tuple[DataFrame, ...]:
    """Rows with their keys, what is known of each, classes, and lists."""
    spark = docs.sparkSession
    r1, r2 = row_key(id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), r1.alias("r1"), r2.alias("r2"))
    seen = stored(_info(rows, k), "shingles")
    info = seen.where("chunk IS NULL").drop("chunk", "counts")
    counts = np.minimum(total_counts(seen.where("chunk IS NOT NULL").select("chunk", "counts"), BUCKETS, _CHUNK), 0xFFFFFFFF).astype(np.uint32)
    held = spark.sparkContext.broadcast(counts.tobytes())
    list_rows = max(list_rows, 4 * int(counts.mean()))  # a bucket's count is that of many shingles
    row = F.min(F.struct("r1", "r2"))
    classes = info.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), row["r1"].alias("r1"), row["r2"].alias("r2"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    classes = stored(classes, "classes")
    total = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    n_buckets = max(partitions(spark), int(total) // bucket_rows + 1)
    lists = stored(_lists(_prefixes(rows, held, k, percent, n_buckets, list_rows), held, percent, list_rows), "lists")
    return rows, info, classes, lists


def _same_first(classes: DataFrame) -> DataFrame:
    """Candidates of classes whose first longs are equal."""
    return classes.groupBy(F.col("c1").alias("a")).count().where("count > 1").select("a", F.col("a").alias("b"))


def links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bucket_rows: int = 1 << 19, list_rows: int = 1 << 17, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Every link between different shingle sets: (membership, pairs).

    membership has a row for each row of docs: doc_id, n_shingles, c1 and c2 (its
    class; null without shingles). pairs has a1, a2, b1, b2, the two classes, once for each
    pair. A row's number of links is that of its class's pairs, each counted with
    the other class's rows, and the other rows of its own class. Groups of near
    copies give all their pairs here; similar() does not make them.
    """
    rows, info, classes, lists = _prepared(docs, id_col, text_col, k, percent, bucket_rows, list_rows)
    pairs = _across(_members(lists, classes, None), percent, block, nearest=False)
    found = stored(pairs.union(_alike(_same_first(classes), classes, percent)).distinct(), "pairs")
    out = _verified(found, rows, classes, k, percent)
    discard(lists, found)
    named = lambda c: F.when(F.col("n") > 0, F.col(c)).alias(c)
    return info.select("doc_id", F.col("n").alias("n_shingles"), named("c1"), named("c2")), out


def _nodes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between classes, each with the smallest id of its documents in front, so the smallest node names the component."""
    of = lambda x: classes.select(F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), F.struct(F.col("least").isNull().alias("none"), "least", "c1", "c2").alias(x))
    return pairs.join(of("a"), ["a1", "a2"]).join(of("b"), ["b1", "b2"]).select("a", "b")


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bucket_rows: int = 1 << 19, list_rows: int = 1 << 17, block: int = 2048) -> DataFrame:
    """For each row: doc_id, r1 and r2 (a 128-bit hash of id and text), n_shingles, c1 and c2 (its class), component_id.

    Two documents link if percent / 100 of the union of their shingle sets is in
    both; component_id is the smallest doc_id that links lead to. Null and empty
    texts have no shingle and link with nothing: component_id is their own id.
    Rows with a null id link like others and get the component's id if it has
    one. Repeated rows are in one class. Other columns are not read, so their
    names cannot clash. An empty table gives no rows.
    """
    rows, info, classes, lists = _prepared(docs, id_col, text_col, k, percent, bucket_rows, list_rows)
    tried = stored(_alike(_pivoted(lists).union(_same_first(classes)), classes, percent), "pairs")
    found = _verified(tried, rows, classes, k, percent)
    groups = components(_nodes(found, classes))
    for nearest in (True, False):
        of = groups.select("node.c1", "node.c2", F.col("component.c1").alias("k1"), F.col("component.c2").alias("k2"))
        more = stored(_across(_members(lists, classes, of), percent, block, nearest).join(tried, ["a1", "a2", "b1", "b2"], "left_anti"), "pairs")
        if not more.isEmpty():
            fresh_links = _verified(more, rows, classes, k, percent)
            if not fresh_links.isEmpty():
                before = groups
                groups = components(before.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_nodes(fresh_links, classes)))
                discard(before)
            discard(fresh_links)
            tried = tried.unionByName(more)
    discard(lists, found)
    linked = groups.select("node.c1", "node.c2", F.col("component.least").alias("least_of_all"))
    named = classes.join(linked, ["c1", "c2"], "left").select("c1", "c2", F.when(F.col("least_of_all").isNotNull(), F.col("least_of_all")).otherwise(F.col("least")).alias("component_id"))
    return info.join(named, ["c1", "c2"], "left").select("doc_id", "r1", "r2", F.col("n").alias("n_shingles"), "c1", "c2", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _own_class() -> Column:
    return F.when(F.col("component_id").isNull(), F.struct("c1", "c2"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each component: the row with the smallest id.

    Rows without shingles stay. Of rows with equal ids and texts one stays; rows
    whose ids are null stay only if their component has no other. Columns may have
    any names.
    """
    found = similar(docs, id_col=id_col, text_col=text_col, **options)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")).alias("f")
    of = found.where("n_shingles > 0").groupBy("component_id", _own_class().alias("alone")).agg(first)
    kept = stored(of.select("f.r1", "f.r2").union(found.where("n_shingles = 0").select("r1", "r2").distinct()), "kept")
    again = found.groupBy("r1", "r2").count().where("count > 1").select("r1", "r2", F.lit(True).alias("again"))
    n1, n2, mark = fresh(docs.columns, "r1", "r2", "again")
    keys = row_key(id_col, text_col)
    kept = kept.join(again, ["r1", "r2"], "left").toDF(n1, n2, mark)
    left = docs.withColumns({n1: keys[0], n2: keys[1]}).join(kept, [n1, n2])
    repeated = left.where(F.col(mark)).dropDuplicates([n1, n2])
    return left.where(F.col(mark).isNull()).unionByName(repeated).select(*docs.columns)
