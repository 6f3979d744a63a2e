"""Snapshots by manifest: touched buckets, shared files, leases, sweeps, segments."""

import time

import pytest
from pyspark.sql import functions as F

from postlark.streaming.ingest import Change, Segment, Snapshots


def rows(spark, *ids, text="x"):
    return spark.createDataFrame([(i, text) for i in ids], "id int, text string")


def paths(into, table="rows"):
    return {p["bucket"]: p["path"] for p in into.manifest()[table]["parts"]}


def test_a_small_batch_rewrites_the_buckets_it_hits(spark, tmp_path):
    into = Snapshots(spark, str(tmp_path), buckets=16)
    into.upsert(rows(spark, *range(400)), ["id"])
    before = paths(into)
    assert set(before) == set(range(16))
    into.upsert(rows(spark, 5, 6, 999, text="new"), ["id"])
    after = paths(into)
    hit = {r[0] for r in rows(spark, 5, 6, 999).select(into.bucket(["id"], 16)).collect()}
    assert {b for b in after if after[b] != before[b]} == hit and len(hit) <= 3
    got = {r.id: r.text for r in into.read().collect()}
    assert len(got) == 401 and {i for i, t in got.items() if t == "new"} == {5, 6, 999}
    assert {r.id: r.text for r in into.read(version=1).collect()} == {i: "x" for i in range(400)}
    into.publish({"rows": Change(("id",), gone=rows(spark, 5, 12345))})
    assert into.read().count() == 400 and into.read().where("id = 5").isEmpty()
    assert {r.id for r in into.read(near=rows(spark, 6)).collect()} < set(got)
    assert into.rebucket("rows", 3) == 4 and set(paths(into)) == {0, 1, 2} and into.read().count() == 400


def test_sweep_keeps_what_versions_share(spark, tmp_path):
    into = Snapshots(spark, str(tmp_path), buckets=8)
    for i in range(4):
        into.upsert(rows(spark, *(range(100) if not i else [i]), text=f"t{i}"), ["id"])
    into.staged(rows(spark, 1))
    assert into.sweep(keep=1, older=3600) == 0
    assert into.sweep(keep=1, older=-5) > 0
    assert {r.text for r in into.read().collect()} == {"t0", "t1", "t2", "t3"} and into.read().count() == 100
    assert [n for n in into._names() if n.startswith("v=")] == ["v=4.json"] and into._names("staging") == []
    assert len(into._names("data/rows")) == len({p.split("/")[2] for p in paths(into).values()})


def test_the_lease_of_a_dead_writer_is_taken_over(spark, tmp_path):
    a, b = (Snapshots(spark, str(tmp_path)) for _ in range(2))
    a._fs.mkdirs(a._path(str(tmp_path)))
    a._put("_lease", {"owner": "dead", "until": time.time() + 60})
    with pytest.raises(RuntimeError, match="another writer holds"), b.lease():
        pass
    a._write("_lease", {"owner": "dead", "until": time.time() - 1}, over=True)
    with b.lease(60):
        assert b.publish(rows(spark, 1)) == 1
        with pytest.raises(RuntimeError, match="another writer holds"), a.lease():
            pass
    assert "_lease" not in a._names()


def test_a_writer_that_lost_its_lease_publishes_nothing(spark, tmp_path):
    a, b = (Snapshots(spark, str(tmp_path)) for _ in range(2))
    a._fs.mkdirs(a._path(str(tmp_path)))
    with pytest.raises(RuntimeError, match="lease has ended"), a.lease(0.0):
        time.sleep(0.01)
        with b.lease(60):
            b.publish(rows(spark, 1))
            a.publish(rows(spark, 2))
    assert [r.id for r in a.read().collect()] == [1]


def test_of_two_writers_of_one_version_one_fails(spark, tmp_path, monkeypatch):
    a, b = (Snapshots(spark, str(tmp_path)) for _ in range(2))
    a.publish(rows(spark, 1))
    slow = a._prolong
    monkeypatch.setattr(a, "_prolong", lambda: slow() or b.version() == 1 and b.publish(rows(spark, 2)))
    with pytest.raises(RuntimeError, match="another writer"):
        a.publish(rows(spark, 3), 2)
    assert [r.id for r in b.read().collect()] == [2] and b.version() == 2


def test_a_rename_that_fails_raises(spark, tmp_path):
    into = Snapshots(spark, str(tmp_path))
    into.publish(rows(spark, 1))
    into._files = None
    with pytest.raises(AttributeError):
        into.publish(rows(spark, 2))
    assert into.version() == 1


def test_segments_grow_and_merge(spark, tmp_path):
    into = Snapshots(spark, str(tmp_path))
    for i in range(3):
        into.publish({"s": Segment(rows(spark, i, text=f"t{i % 2}").withColumn("lang", F.lit(f"l{i}")), ("lang",), note=i)})
    parts = into.manifest()["s"]["parts"]
    assert [(p["segment"], p["note"]) for p in parts] == [(1, 0), (2, 1), (3, 2)]
    assert sorted((r.id, r.lang, r.seg.split("-")[0]) for r in into.read("s").collect()) == [(0, "l0", "1"), (1, "l1", "2"), (2, "l2", "3")]
    old = tuple(p["path"].rsplit("=", 1)[1] for p in parts[:2])
    into.publish({"s": Segment(into.read("s").where(F.col("seg").isin(*old)).drop("seg"), ("lang",), old)})
    assert sorted((r.id, r.seg.split("-")[0]) for r in into.read("s").collect()) == [(0, "2"), (1, "2"), (2, "3")]
    into.publish({"s": Segment(rows(spark).withColumn("lang", F.lit("x")), ("lang",))})
    assert into.read("s").count() == 3
