"""Neighbours among repeated rows, and recall over many cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlark.llm.neighbours import fit_tree, neighbours

ROWS = "vec_id long, embedding array<double>"


def test_repeated_rows_crowd_no_id_out(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 1.0])] * 12 + [(2, [1.0, 1.0]), (3, [1.0, 5.0])]
    got = neighbours(spark.createDataFrame(rows, ROWS).coalesce(1), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3]


@pytest.mark.parametrize("kind", ["clusters", "repeated"])
def test_recall_over_many_cells(spark, kind):
    draw, k = np.random.default_rng(3), 10
    x = draw.standard_normal((20, 16))[draw.integers(0, 20, 3000)] * 4 + draw.standard_normal((3000, 16))
    if kind == "repeated":
        x[1000:] = x[draw.integers(0, 1000, 2000)]
        x[:300] = x[0]
    assert fit_tree(x[:, :8], len(x), 64, np.eye(16, 8)).cells >= 32
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], ROWS).repartition(4)
    got = {}
    for r in neighbours(df, F.col("vec_id") % 50 == 7, cell_rows=64).collect():
        got.setdefault(r.query_id, []).append(r.score)
    hits = 0
    for i in range(7, 3000, 50):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        kth = np.sort(np.delete(d, i))[k - 1]
        assert len(got[i]) == k
        hits += sum(s <= kth + 1e-9 for s in got[i])
    assert hits >= 0.9 * k * len(got)
