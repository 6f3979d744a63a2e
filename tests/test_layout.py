"""The index is laid out without a shuffle of postings or texts."""

from pyspark.sql import functions as F

from postlark.operators import archive, search
from postlark.streaming.ingest import Snapshots


def test_postings_stay_with_their_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "_PART", 16)
    monkeypatch.setattr(search, "_RUN", 50, raising=False)
    rows = [(f"c{i}", " ".join(f"w{(i * j) % 37}" for j in range(20))) for i in range(300)]
    shown = {c: F.lit("") for c in search.SHOWN if c != "to_addresses"} | {"to_addresses": F.array(F.lit("")), "content_hash": F.lit("")}
    docs = spark.createDataFrame(rows, "chunk_id string, text string").repartition(3).withColumns(shown)
    into = Snapshots(spark, str(tmp_path / "i"))
    into.publish(search.changes(into, 0, docs, None, ("text",)))
    held = into.read("postings").withColumn("file", F.input_file_name())
    assert held.groupBy("chunk_id").agg(F.countDistinct("file").alias("n")).agg(F.max("n")).first()[0] == 1
    want = sorted((r.chunk_id, r.term, r.tf, r.dl, r.positions) for r in search.postings(docs).collect())
    assert sorted((r.chunk_id, r.term, r.tf, r.dl, r.positions) for r in held.collect()) == want


def test_pieces_are_entries(spark):
    m = spark.createDataFrame([("m1", "t", "a", "b", "Re: S", "f@x", ["t@x"], "2024", "one\n\ntwo"), ("m2", "t", "a", "b", None, "f@x", [], "2024", "")], "message_id string, thread_id string, account_id string, mailbox string, subject string, from_address string, to_addresses array<string>, date string, latest_text string")
    got, want = search.shown(search.pieces(m)), search.entries(archive.chunks(m), m)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) != []


def test_a_sync_stores_texts_twice_at_most(spark, tmp_path, monkeypatch):
    """As normalized messages and as chunks, before the tables; no table of texts is dealt out."""
    from postlark.operators.sync import sync
    from postlark.sources import envelopes

    wide, dealt = [], []
    staged, hint = Snapshots.staged, type(spark.range(0)).hint
    monkeypatch.setattr(Snapshots, "staged", lambda self, df: wide.append({"latest_text", "text"} & set(df.columns)) or staged(self, df))
    monkeypatch.setattr(type(spark.range(0)), "hint", lambda self, name, *a: dealt.append({"latest_text", "text"} & set(self.columns)) or hint(self, name, *a))
    rows = spark.createDataFrame([(f"k{i}", f"word{i} text") for i in range(20)], "providerKey string, text string")
    mail = rows.withColumns({c: F.lit(None).cast(t) for c, t in ((f.split(" ")[0], f.split(" ", 1)[1]) for f in ("messageId string", "threadId string", "inReplyTo string", "html string", "rawMime string", "sourceHash string", "from string", "date string", "to array<string>", "cc array<string>", "labels array<string>", "flags array<string>", "classifications array<string>"))})
    mail = mail.withColumns({"accountId": F.lit("a"), "mailbox": F.lit("b"), "subject": F.lit("s"), "attachments": F.lit(None).cast(envelopes.ATTACHMENTS)})
    into = Snapshots(spark, str(tmp_path / "s"), buckets=2)
    for text in (F.col("text"), F.concat("text", F.lit(" more"))):
        wide.clear()
        report = sync(into, mail.withColumn("text", text)).first()
        assert sum(map(bool, wide)) == 2 and not any(dealt)
    assert report.updated == 20 and search.Index.of(into).search("more word7").count() == 1


def test_staged_files_can_go_before_the_version(spark, tmp_path):
    into = Snapshots(spark, str(tmp_path / "s"))
    one, two = into.staged(spark.range(3)), into.staged(spark.range(2))
    into.unstaged(one)
    into.unstaged(spark.range(1))  # was not staged
    assert len(into._names("staging")) == 1 and two.count() == 2
    into.publish(two)
    assert into._names("staging") == [] and into.read().count() == 2


def test_vectors_of_a_batch_are_arrays():
    import numpy as np

    from postlark.functions import embed

    got = embed._vector("one two one", {})
    assert isinstance(got, np.ndarray) and got.tolist() == embed.hash_vector("one two one")
