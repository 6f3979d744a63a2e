"""The hash tree: proportions, movement confined to what changes, gapless slots."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from postlark.llm import sharding
from postlark.llm.sharding import Tree


def shards(spark, tree, n=4000):
    return {r.doc_id: r.shard for r in sharding.assign(spark.range(n).toDF("doc_id"), tree).collect()}


def test_growth_moves_rows_into_the_new_shard_only(spark):
    tree = Tree.even(40)
    assert tree.shards == 40 and [len(r) for r in tree.weights] == [4, 4]
    more, most = tree.growth(), tree.growth().growth()
    a, b, c = (shards(spark, t) for t in (tree, more, most))
    assert set(a.values()) == set(range(40)) and set(c.values()) == set(range(42))
    assert {b[d] for d in a if a[d] != b[d]} == {40} and {c[d] for d in b if b[d] != c[d]} == {41}
    assert 50 < sum(a[d] != b[d] for d in a) < 160  # a 41st of 4000 is 98


def test_weights(spark):
    """Rows follow weights; a changed weight moves rows into or out of its own region and rack only."""
    tree = Tree((((1.0, 3.0), (4.0,)), ((0.0, 8.0),)))
    got = Counter(shards(spark, tree).values())
    assert 3 not in got and all(abs(got[s] - 4000 * w / 16) < 200 for s, w in ((0, 1), (1, 3), (2, 4), (4, 8)))
    a, b = shards(spark, tree), shards(spark, Tree((((1.0, 3.0), (8.0,)), ((0.0, 8.0),))))
    assert all(b[d] in (0, 1, 2) for d in a if a[d] != b[d])  # into the region that gained
    assert all(b[d] == 2 for d in a if a[d] != b[d] and a[d] < 2)  # inside it, into the rack that gained


ROWS = [(i, f"text {i}") for i in range(50)] + [(7, "text 7")] * 11 + [(None, None)] * 5 + [(None, "é"), (8, ""), (9, None), (10, "long " * 50_000)]


def test_slots_and_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_COPIES", 3)
    monkeypatch.setattr(sharding, "_BLOCK", 2)
    docs = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "doc_id long, text string, shard string, n string").repartition(4)
    tree = Tree.even(5)
    rows = sharding.layout(docs, tree, [tree.growth()]).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in ROWS)
    of = {}
    for r in rows:
        of.setdefault(r.shard, []).append(r.slot)
        assert r.grown0 in (r.shard, 5)
    assert all(sorted(x) == list(range(len(x))) for x in of.values())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1


def test_names_and_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.layout(docs, Tree.even(3)).count() == 0
    assert sharding.assign(docs.withColumn("shard", F.lit("x")), Tree.even(3)).columns == ["doc_id", "text", "shard", "_shard"]
