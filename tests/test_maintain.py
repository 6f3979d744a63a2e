"""Vectors of an archive, their rebuilds, status and repair."""

import json

import pytest
from pyspark.sql import functions as F

from postlark.functions.embed import hash_vector
from postlark.operators import maintain, search, sync
from postlark.operators.semantic import Identity
from postlark.sources.envelopes import MAIL
from postlark.streaming.ingest import Snapshots

HASH = maintain.embedder("hash")


def mail(spark, **texts):
    return spark.createDataFrame([{"accountId": "a", "mailbox": "i", "providerKey": k, "subject": k, "text": t} for k, t in texts.items()], MAIL)


def test_vectors_follow_chunks(spark, tmp_path):
    into, store = Snapshots(spark, str(tmp_path / "mail")), Snapshots(spark, str(tmp_path / "vectors"))
    assert maintain.status(into, store, HASH).first().semantic_status == "missing" and not (tmp_path / "mail").exists()
    with pytest.raises(ValueError, match="nothing was synced"):
        maintain.index_semantic(into, store, HASH)
    sync.sync(into, mail(spark, one="first text", two="second text"))
    assert maintain.status(into, store, HASH).first().semantic_status == "never-completed"
    report = lambda **how: tuple(maintain.index_semantic(into, store, HASH, **how).first())[:3]
    assert report() == (2, 0, False)
    assert report() == (0, 2, False)
    got = maintain.doctor(into, store, HASH).first()
    assert (got.semantic_status, got.keyword_status, got.backlog, got.vectors, got.recommendation) == ("healthy", "healthy", 0, 2, "vectors are complete")
    sync.sync(into, mail(spark, one="changed", three="third"))
    got = maintain.doctor(into, store, HASH).first()
    assert (got.semantic_status, got.backlog) == ("interrupted", 2) and got.recommendation.startswith("sync")
    assert report() == (2, 1, False)
    held = {r.chunk_id: r.vector for r in store.read("vectors").collect()}
    assert held == {r.chunk_id: hash_vector(r.text) for r in into.read("chunks").collect()}
    assert report(rebuild=True) == (3, 0, True)
    other = maintain.Embedder(Identity("mock", "other", 128), HASH.documents, HASH.query)
    assert maintain.status(into, store, other).first().semantic_status == "rebuild-required"
    assert tuple(maintain.index_semantic(into, store, other).first())[:3] == (3, 0, True)
    done = maintain.repair(into, store, HASH, str(tmp_path / "index"), vectors=True)
    assert (done["vectors"].first().embedded, done["vectors"].first().rebuilt) == (3, True)
    got = maintain.status(into, store, HASH, done["keyword"]).first()
    assert (got.semantic_status, got.keyword_status, got.keyword_rows) == ("healthy", "healthy", 3)
    with pytest.raises(ValueError, match="nothing to repair"):
        maintain.repair(into, store, HASH)


def test_older_vectors_and_unnamed_ones(spark, tmp_path):
    into, store, unnamed = (Snapshots(spark, str(tmp_path / n)) for n in ("mail", "vectors", "unnamed"))
    sync.sync(into, mail(spark, one="first text", two="second text"))
    one = into.read("chunks").where("text = 'first text'").first()
    older = spark.createDataFrame([(one.chunk_id, one.content_hash, json.dumps([1.0] + [0.0] * 127))], "chunk_id string, content_hash string, vector string")
    assert tuple(maintain.index_semantic(into, store, HASH, older=(older, HASH.identity)).first())[:3] == (1, 1, False)
    assert store.read("vectors").where(f"chunk_id = '{one.chunk_id}'").first().vector[0] == 1.0
    unnamed.publish({"vectors": store.read("vectors")})
    assert maintain.status(into, unnamed, HASH).first().semantic_status == "rebuild-required"
    assert tuple(maintain.index_semantic(into, unnamed, HASH).first())[:3] == (2, 0, True)


def test_all_failed(spark):
    rows = lambda *errors: spark.createDataFrame([(e,) for e in errors], "error string")
    for fine in (rows(), rows("bad", None)):
        maintain.require_readable(fine)
    maintain.require_readable(rows("bad"), unchanged=1)
    with pytest.raises(ValueError, match="no message"):
        maintain.require_readable(rows("bad", "bad"))
    with pytest.raises(ValueError, match="unknown embedder"):
        maintain.embedder("none")


def found(into, word):
    return sorted(r.snippet for r in search.Index.of(into).search(word).collect())


def test_the_index_follows_each_sync(spark, tmp_path):
    into, store = Snapshots(spark, str(tmp_path / "mail"), buckets=4), Snapshots(spark, str(tmp_path / "v"))
    status = lambda **how: maintain.status(into, store, HASH, **how).first()
    sync.sync(into, mail(spark, one="first text", two="second text", three="third text"))
    frozen = str(tmp_path / "frozen")
    search.Index.write(search.entries(into.read("chunks"), into.read("messages")), frozen)
    old = search.Index.read(spark, frozen)
    assert found(into, "text") == ["first text", "second text", "third text"] and status(index=old).keyword_status == "healthy"
    first = {p["path"] for p in into.manifest()["postings"]["parts"]}
    spam = mail(spark, three="third text").withColumn("classifications", F.array(F.lit("CATEGORY_SPAM")))
    sync.sync(into, mail(spark, one="changed words").unionByName(spam))
    assert found(into, "first") == found(into, "third") == [] and found(into, "changed") == ["changed words"] and found(into, "text") == ["second text"]
    assert status().keyword_status == "healthy" and status(index=old).keyword_status == "stale"
    parts = into.manifest()["postings"]["parts"]
    assert first < {p["path"] for p in parts} and len(parts) == 2
    written = {r.chunk_id for r in into.read("postings").where(~F.col("seg").isin(*(p.rsplit("=", 1)[1] for p in first))).collect()}
    assert written == {r.chunk_id for r in into.read("chunks").where("text = 'changed words'").collect()}
    sync.sync(into, mail(spark, one="first text"))  # the same chunk again, deleted once
    assert found(into, "first") == ["first text"] and found(into, "changed") == []
    live = search.Index.of(into)
    n, tokens = live.stats.where("lang = 'all'").select("n", "tokens").first()
    assert n == 2 and tokens == live.entries.select(F.col("lens")["all"].alias("n")).agg(F.sum("n")).first()[0]
    before = sorted((r.term, r.tf, r.chunk_id) for r in live.of_list("all").collect())
    search.merge_segments(into, 2)
    assert len(into.manifest()["postings"]["parts"]) == 1 and into.read("deleted").count() == 0
    after = search.Index.of(into)
    assert sorted((r.term, r.tf, r.chunk_id) for r in after.of_list("all").collect()) == before
    assert maintain.repair(into, store, HASH, keyword=True)["keyword"].search("first").count() == 1


def test_dates_and_threads_of_entries_follow_too(spark, tmp_path):
    into = Snapshots(spark, str(tmp_path / "mail"), buckets=4)
    one = mail(spark, one="first text").withColumn("date", F.lit("2024-01-01"))
    sync.sync(into, one)
    assert sync.sync(into, one.withColumn("date", F.lit("2025-01-01"))).first().unchanged == 1
    hits = search.Index.of(into).search("first", filters=search.Filters(after="2024-06-01")).collect()
    assert [h.date for h in hits] == ["2025-01-01"]


def test_an_index_by_other_analyzers(spark, tmp_path, monkeypatch):
    into, store = Snapshots(spark, str(tmp_path / "mail"), buckets=4), Snapshots(spark, str(tmp_path / "v"))
    monkeypatch.setattr(search, "VERSION", "older")
    sync.sync(into, mail(spark, one="first text 계약"))
    monkeypatch.undo()
    index = search.Index.of(into)
    assert index.search("first").count() == 1 and maintain.status(into, store, HASH).first().keyword_status == "stale"
    with pytest.raises(ValueError, match="other analyzers"):
        index.search("계약")
    sync.sync(into, mail(spark, two="second text 계약"))
    assert maintain.status(into, store, HASH).first().keyword_status == "healthy" and search.Index.of(into).search("계약").count() == 2
