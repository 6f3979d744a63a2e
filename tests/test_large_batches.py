"""A batch with many keys changes tables of texts without a shuffle of texts, and a merge makes no shuffle of postings."""

import pytest
from pyspark.sql import functions as F

from postlark.operators import search
from postlark.streaming import ingest
from postlark.streaming.ingest import Change, Snapshots


def table(spark, ids, text):
    return spark.createDataFrame([(f"k{i}", f"{text} {i}") for i in ids], "key string, text string")


@pytest.mark.parametrize("keys", [4, 40, 1000])
def test_texts_stay_where_they_are(spark, tmp_path, monkeypatch, keys):
    """By groups of buckets: one key too many for a broadcast in a bucket, several groups, one group."""
    monkeypatch.setattr(ingest, "_KEYS", keys, raising=False)
    into = Snapshots(spark, str(tmp_path / "s"), buckets=8)
    into.publish({"texts": Change(("key",), table(spark, range(200), "old"), as_read=True)})
    joins = []
    join = type(spark.range(0)).join
    monkeypatch.setattr(type(spark.range(0)), "join", lambda self, *a: joins.append(join(self, *a)) or joins[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gone = spark.createDataFrame([("k7",), ("k199",), ("k900",)], "key string")
        into.publish({"texts": Change(("key",), table(spark, range(100, 150), "new").withColumn("more", F.lit(1)), gone, as_read=True)})
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in joins]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert keys == 4 or plans and not any("SortMergeJoin" in p for p in plans)
    want = sorted([(f"k{i}", f"old {i}", None) for i in range(200) if i not in (7, 199, *range(100, 150))] + [(f"k{i}", f"new {i}", 1) for i in range(100, 150)])
    assert sorted(tuple(r) for r in into.read("texts").collect()) == want
    assert (len(joins) > 1) == (keys < 1000)
    into.publish({"texts": Change(("key",), None, into.read("texts").select("key"), as_read=True)})
    assert into.read("texts").count() == 0


def test_a_merge_of_all_reads_entries(spark, tmp_path, monkeypatch):
    shown = {c: F.lit("") for c in search.SHOWN if c != "to_addresses"} | {"to_addresses": F.array(F.lit("")), "content_hash": F.lit("")}
    docs = lambda ids, tail: spark.createDataFrame([(f"c{i}", f"w{i % 7} w{i % 3} {tail}") for i in ids], "chunk_id string, text string").withColumns(shown)
    into = Snapshots(spark, str(tmp_path / "i"), buckets=2)
    into.publish(search.changes(into, 0, docs(range(30), "계약 one"), None, ("text",)))
    into.publish(search.changes(into, 1, docs(range(20, 50), "two"), docs(range(3), "").select("chunk_id"), ("text",)))
    rows = lambda: sorted((r.lang, r.chunk_id, r.term, r.tf, r.dl, r.positions, r.block) for r in search.Index.of(into).postings.collect())
    want, runs = rows(), []
    laid = Snapshots.laid
    monkeypatch.setattr(Snapshots, "laid", lambda self, name, by, lists, s: runs.extend(df._jdf.queryExecution().executedPlan().toString() for df in lists.values()) or laid(self, name, by, lists, s))
    search.merge_segments(into, 2)
    assert runs and not any("Join" in p or "Exchange" in p for p in runs)
    assert rows() == want and {r[0] for r in want} > {"all"}
