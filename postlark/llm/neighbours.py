"""Approximate nearest neighbours over low-dimensional stable projections.

Vectors are projected to a few dimensions with Gaussian (2-stable) weights. For
a pair at distance d, the squared projected distance divided by d^2 follows a
chi-square law with as many degrees of freedom. A query takes its neighbours in
the projected space one after another and verifies them on the full vectors; it
stops when the next projected distance would, by that law, almost surely
(`confidence`) not belong to a vector nearer than the k-th best so far.

The projected space is cut by a kd-tree whose cells are dealt over the cluster.
The tree is fitted on a sample that grows with the rows up to `sample`; every row
is indexed. Each query first searches its own cell, then all cells within the
radius at which it would stop. Inside a cell a second tree, fitted there, gives
leaves of some dozen rows, which a query takes by their distance to it.
Cells over `cell_rows` rows are split by a hash of the id, and queries of a cell
go in blocks of `query_rows`, so no task holds more, wherever the rows crowd.
Of equal vectors in a batch only the k + 1 smallest distinct ids can be a result;
the others, and rows that repeat an id and its vector, are dropped while indexing,
which is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored
from .wordhash import mix

#: Of projected points at most; 64 MB at 8 dimensions.
SAMPLE = 1 << 20
#: Sampled points a cell, and rows of a leaf inside it.
_A_CELL, _LEAF = 32, 64


def chi2_quantile(p: float, dof: int) -> float:
    """Where a chi-square law of an even number of degrees of freedom reaches p."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))
    lo, hi = 0.0, 10.0 * dof + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


@dataclass(frozen=True)
class Tree:
    """A kd-tree over projected points; node i has the children 2i + 1 and 2i + 2."""

    axis: np.ndarray
    at: np.ndarray
    depth: int
    weights: np.ndarray

    @property
    def cells(self) -> int:
        return 1 << self.depth

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.at[node])
        return node - (self.cells - 1)

    def near(self, q: np.ndarray, radius2: float) -> list[int]:
        """Cells whose box is within the radius of a projected query."""
        out, todo = [], [(0, np.zeros(len(q)))]
        while todo:
            node, off = todo.pop()
            if node >= self.cells - 1:
                out.append(node - self.cells + 1)
                continue
            gap = q[self.axis[node]] - self.at[node]
            far = off.copy()
            far[self.axis[node]] = max(far[self.axis[node]], gap * gap)
            right = gap > 0
            todo.append((2 * node + 1 + right, off))
            if far.sum() <= radius2:
                todo.append((2 * node + 2 - right, far))
        return out


def _weights(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


def fit_tree(points: np.ndarray, rows: int, cell_rows: int, weights: np.ndarray, a_cell: int = _A_CELL) -> Tree:
    """Halves the sample at the median of its widest axis, to cells of about cell_rows rows, with a_cell points each at least."""
    depth = 0
    while rows > cell_rows << depth and len(points) >= a_cell << depth:
        depth += 1
    axis, at = np.zeros(max((1 << depth) - 1, 1), np.int64), np.zeros(max((1 << depth) - 1, 1))
    parts = {0: points}
    for node in range((1 << depth) - 1):
        p = parts.pop(node)
        if len(p):
            axis[node] = int(np.argmax(p.max(0) - p.min(0)))
            at[node] = np.median(p[:, axis[node]])
        right = p[:, axis[node]] > at[node]
        parts[2 * node + 1], parts[2 * node + 2] = p[~right], p[right]
    return Tree(axis, at, depth, weights)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _id_hash(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64))


def usable(vec: Column) -> Column:
    """Not null or empty, all components there and finite, one of them not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def _leaves(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a cell in the order of their leaves, where leaves begin, and their boxes' corners."""
    leaf = fit_tree(p, len(p), _LEAF, np.zeros((0, 0)), 1).cell(p)
    order = np.argsort(leaf, kind="stable")
    first = np.flatnonzero(np.diff(leaf[order], prepend=-1))
    return order, np.append(first, len(p)), np.minimum.reduceat(p[order], first), np.maximum.reduceat(p[order], first)


def _search(tree: Tree, k: int, factor: float, dim: int):
    """Of a group's rows and queries: each query's k best, verified leaf by leaf in projected order."""
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and queries.num_rows:
            ids, x, q = rows.column("vec_id").to_numpy(), _matrix(rows.column("vec"), dim), _matrix(queries.column("vec"), dim)
            px, pq = tree.project(x), tree.project(q)
            order, begin, low, high = _leaves(px)
            ids, x, px = ids[order], x[order], px[order]
            for i, (qid, bound) in enumerate(zip(queries.column("query_id").to_pylist(), queries.column("bound").to_pylist(), strict=True)):
                box = (np.maximum(np.maximum(low - pq[i], pq[i] - high), 0) ** 2).sum(1)
                nearest = np.argsort(box, kind="stable")
                best_d, best_id, at, many = np.zeros(0), np.zeros(0, np.int64), 0, 2
                while at < len(nearest) and not box[nearest[at]] > factor * bound * bound * (1 + 1e-12):
                    leaves = nearest[at : at + many]
                    step = np.concatenate([np.arange(begin[j], begin[j + 1]) for j in leaves.tolist()])
                    step = step[ids[step] != qid]
                    if np.isfinite(bound):
                        step = step[((px[step] - pq[i]) ** 2).sum(1) <= factor * bound * bound * (1 + 1e-12)]
                    d = np.sqrt(((x[step] - q[i]) ** 2).sum(1))
                    best_d, best_id = np.concatenate([best_d, d]), np.concatenate([best_id, ids[step]])
                    keep = np.lexsort((best_id, best_d))
                    _, first = np.unique(best_id[keep], return_index=True)  # an id counts once
                    keep = keep[np.sort(first)][:k]
                    best_d, best_id = best_d[keep], best_id[keep]
                    if len(best_d) == k:
                        bound = min(bound, float(best_d[-1]))
                    at, many = at + many, min(2 * many, 16)
                out.append((np.full(len(best_d), qid), best_id, best_d))
        return pa.Table.from_arrays([pa.array(np.concatenate([o[j] for o in out]) if out else [], f.type) for j, f in enumerate(kinds)], schema=kinds)

    return run


def neighbours(df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, dims: int = 8, confidence: float = 0.95, cell_rows: int = 4096, query_rows: int = 4096, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """The k nearest rows found for each query row: query_id, rank, vec_id, score.

    score is the Euclidean distance in double precision; ties go to the smaller
    id, and a query is no candidate of its own. Rows with a null id, or a vector
    that is null, empty, zero, or has a null or non-finite component, take no
    part. Vectors of different lengths have no distance: each length is searched by
    itself, and a query that has several lengths gives results for each. Rows that
    repeat an id count once: the nearest as candidates, the smallest vector as
    queries. Fewer candidates than k are all returned; empty tables give no rows.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = df.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy("dim").collect() or [(1, 0)]  # a row a length
    found = [_of_length(rows.where(F.size("vec") == dim), dim, total, k, dims, confidence, cell_rows, query_rows, sample, seed) for dim, total in sizes]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _of_length(rows: DataFrame, dim: int, total: int, k: int, dims: int, confidence: float, cell_rows: int, query_rows: int, sample: int, seed: int) -> DataFrame:
    """neighbours() of vectors of one length: vec_id, vec, is_query."""
    weights = _weights(dim, dims, seed)
    factor = chi2_quantile(confidence, dims)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "p": pa.array(list(_matrix(b.column(1), dim) @ weights), pa.list_(pa.float64()))})

    points = min(sample, max(1024, 2 * _A_CELL * -(-total // cell_rows)))
    share = int((1 << 30) * min(1.0, points / max(total, 1)))
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share)  # about `points` rows, by their ids
    drawn = some.select("vec_id", "vec").mapInArrow(projected, "vec_id long, p array<double>").groupBy("vec_id").agg(F.min("p").alias("p")).select("p").toArrow()  # one an id
    tree = fit_tree(_matrix(drawn["p"], dims), total, cell_rows, weights)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = _matrix(b.column("vec"), dim), b.column("vec_id").to_numpy()
            order = np.lexsort((ids, *x.T[::-1]))
            new = np.ones(len(order), bool)
            new[1:] = (x[order[1:]] != x[order[:-1]]).any(1)
            again = np.zeros(len(order), bool)
            again[1:] = ~new[1:] & (ids[order[1:]] == ids[order[:-1]])
            order, new = order[~again], new[~again]
            first = np.flatnonzero(new)
            nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            keep = np.sort(order[nth <= k])
            part = b.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([pa.array(tree.cell(tree.project(x[keep])), pa.int32()), part.column("vec_id"), part.column("vec")], names=["cell", "vec_id", "vec"])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = tree.cell(tree.project(_matrix(b.column("vec"), dim)))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column("query_id"), b.column("vec"), pa.array(np.full(len(cell), np.inf))], names=["cell", "query_id", "vec", "bound"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = tree.project(_matrix(b.column("vec"), dim))
            own, bounds = tree.cell(p), b.column("bound").to_pylist()
            near = [[c for c in tree.near(p[i], factor * bounds[i] ** 2 * (1 + 1e-12)) if c != own[i]] for i in range(len(p))]
            at = np.repeat(np.arange(len(p)), [len(c) for c in near])
            cells = np.array([c for cs in near for c in cs], np.int32)
            for a in range(0, len(at), 5000):
                part = b.take(pa.array(at[a : a + 5000]))
                yield pa.RecordBatch.from_arrays([pa.array(cells[a : a + 5000]), part.column("query_id"), part.column("vec"), part.column("bound")], names=["cell", "query_id", "vec", "bound"])

    found = "cell int, query_id long, vec array<double>, bound double"
    indexed = stored(rows.select("vec_id", "vec").mapInArrow(index, "cell int, vec_id long, vec array<double>"), "index")
    queries = stored(rows.where("is_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec")), "queries")
    per_cell = {r.cell: r["count"] for r in indexed.groupBy("cell").count().collect()}  # a row for each cell of the bounded tree

    def search(wanted: DataFrame) -> DataFrame:
        asked = {r.cell: r["count"] for r in wanted.groupBy("cell").count().collect()}
        parts = np.array([-(-per_cell.get(c, 1) // (4 * cell_rows)) for c in range(tree.cells)])
        blocks = np.array([-(-asked.get(c, 0) // query_rows) for c in range(tree.cells)])

        def dealt(own: str, times: np.ndarray, among: np.ndarray):
            """Gives a row one group by its hash on its own side, and all of the other side's."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    cell = b.column("cell").to_numpy()
                    mine = (_id_hash(b.column(own).to_numpy()) % np.maximum(among[cell], 1).astype(np.uint64)).astype(np.int32)
                    n = times[cell]
                    at = np.repeat(np.arange(len(cell)), n)
                    other = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                    for a in range(0, len(at), 20_000):
                        s = slice(a, a + 20_000)
                        part = b.take(pa.array(at[s]))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(mine[at[s]]), pa.array(other[s])], names=[*part.schema.names, "mine", "other"])

            return run

        left = indexed.mapInArrow(dealt("vec_id", blocks, parts), "cell int, vec_id long, vec array<double>, mine int, other int").withColumnsRenamed({"mine": "part", "other": "block"})
        right = wanted.mapInArrow(dealt("query_id", parts, blocks), f"{found}, mine int, other int").withColumnsRenamed({"mine": "block", "other": "part"})
        keys = ("cell", "part", "block")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(tree, k, factor, dim), "query_id long, vec_id long, score double")

    first = stored(search(queries.mapInArrow(home, found)), "first")
    kth = first.groupBy("query_id").agg(F.sort_array(F.collect_list("score")).alias("s")).select("query_id", F.when(F.size("s") >= k, F.element_at("s", k)).otherwise(float("inf")).alias("bound"))
    wider = queries.join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).mapInArrow(others, found)
    second = search(stored(wider, "wider"))
    merged = first.unionByName(second).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
