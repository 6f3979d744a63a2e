"""Neighbours in threads over many tasks, folders above paths, addresses and dates of mail, prefixes of embedders."""

import pytest
from pyspark.sql import functions as F

from postlark.functions.embed import hash_vector
from postlark.operators import archive, maintain, sync
from postlark.operators.semantic import Identity
from postlark.sources import mail_files
from postlark.sources.envelopes import MAIL
from postlark.streaming.ingest import Snapshots


@pytest.mark.parametrize(("tasks", "batch"), [(2, 10_000), (9, 3)])
def test_neighbours_in_threads_over_borders(spark, tmp_path, tasks, batch):
    rows = [("long", f"2024-{i // 40:02d}", f"m{i % 40:02d}", "latest", 0, f"c{i:03d}", "x") for i in range(120)]
    rows += [(f"t{i % 7}", "2024", f"m{i}", s, o, f"d{i}{s}{o}", "x") for i in range(15) for s in ("latest", "quoted") for o in (0, 1)]
    rows += [(None, "2024", f"m{i}", "latest", 0, f"e{i}", "x") for i in range(3)]
    df = spark.createDataFrame(rows, "thread_id string, started_at string, message_id string, section string, ordinal int, chunk_id string, own string").repartition(5)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        out = archive.chunk_context(df, str(tmp_path / "c"))
        got = {r.chunk_id: (r.previous_id, r.next_id) for r in out.collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert out.columns == [*df.columns, "previous_id", "next_id"]
    want = {}
    for thread in {r[0] for r in rows}:
        ids = [r[5] for r in sorted((r for r in rows if r[0] == thread), key=lambda r: r[1:6])]
        near = lambda i, ids=ids: ids[i] if 0 <= i < len(ids) else None
        want |= {x: (near(i - 1), near(i + 1)) if thread else (None, None) for i, x in enumerate(ids)}
    assert got == want
    assert archive.chunk_context(df.limit(0), str(tmp_path / "none")).count() == 0


def test_below_folders(spark):
    paths = spark.createDataFrame([("r", p) for p in ("a", "a/b", "ab", "a/b/c", "d/e", "")] + [("s", "a/b")], "root_key string, rel_path string")
    under = lambda *tops: {tuple(r) for r in archive.below(paths, spark.createDataFrame(list(tops), "root_key string, rel_path string")).collect()}
    assert under(("r", "a")) == {("r", "a"), ("r", "a/b"), ("r", "a/b/c")}
    assert under(("r", "a/b"), ("s", "a"), ("s", "a")) == {("r", "a/b"), ("r", "a/b/c"), ("s", "a/b")}
    assert len(under(("r", ""))) == 6 and under(("q", "")) == set()


def test_addresses_and_dates_of_mail():
    raw = b'From: "A, B" <a@x.com>\nTo: Team: b@x.com, C <c@x.com>;, none:;\nCc: d@x.com\nSubject: s\n\nhi\n'
    row = dict(zip([c.split(" ")[0] for c in "path label provider_key message_id in_reply_to subject sender recipients cc date body labels attachments error truncated".split()], mail_files.parse("p", "p", raw, "x Wed Aug 26 10:00:00 +0200 2026"), strict=True))
    assert (row["sender"], row["recipients"], row["cc"], row["date"]) == ("a@x.com", ["b@x.com", "c@x.com"], ["d@x.com"], "2026-08-26T08:00:00.000Z")
    date = mail_files._envelope_date
    assert date("a Wed Aug 26 10:00:00 2026") == date("a Wed Aug 26 10:00:00 GMT 2026") == date("a Wed Aug 26 12:00:00 2026 +0200") == "2026-08-26T10:00:00.000Z"
    assert date("nobody") == date("a Wed Aug 99 10:00:00 2026") == mail_files.EPOCH


def test_copies_and_cuts_reach_the_archive(spark, tmp_path, monkeypatch):
    raw = b"Message-ID: <1@x>\nFrom: a@x\nTo: b@x\nCc: c@x\nSubject: s\n\n" + b"word " * 300_000
    rows = [mail_files.parse("in/box/1.eml", "1.eml", raw)]
    df = spark.createDataFrame(mail_files._frame(rows), mail_files.SCHEMA)
    into = Snapshots(spark, str(tmp_path), buckets=2)
    assert sync.sync(into, sync.from_files(df, "me")).first().truncated == 1
    m = into.read("messages").first()
    assert (m.to_addresses, m.cc_addresses, m.truncated, m.mailbox) == (["b@x"], ["c@x"], True, "box")


def test_other_prefixes_make_other_vectors(spark, tmp_path):
    seen = []
    base = maintain.embedder("hash")
    by = lambda **how: maintain.Embedder(Identity("mock", "hash-128", 128, **how), base.documents, lambda t: seen.append(t) or hash_vector(t))
    into, store = Snapshots(spark, str(tmp_path / "m"), buckets=2), Snapshots(spark, str(tmp_path / "v"), buckets=2)
    sync.sync(into, spark.createDataFrame([{"accountId": "a", "mailbox": "i", "providerKey": "1", "subject": "s", "text": "one"}], MAIL))
    plain, prefixed = by(), by(query_prefix="query: ", passage_prefix="passage: ", build="b1")
    run = lambda e: tuple(maintain.index_semantic(into, store, e).first())[:3]
    assert run(plain) == (1, 0, False) and run(by(query_prefix="", build="other")) == (0, 1, False)
    assert maintain.status(into, store, prefixed).first().semantic_status == "rebuild-required"
    assert run(prefixed) == (1, 0, True) and maintain.held_identity(store) == Identity("mock", "hash-128", 128, maintain.held_identity(store).revision, "query: ", "passage: ", "b1")
    assert store.read("vectors").first().vector == hash_vector("passage: one")
    prefixed.asked("x")
    assert seen == ["query: x"]
    with pytest.raises(ValueError, match="prefixes differ"):
        plain.identity.require(prefixed.identity)
    with pytest.raises(ValueError, match="name of its own"):
        maintain.register("hash", prefixed)
    maintain.register("prefixed", prefixed)
    assert maintain.embedder("prefixed") is prefixed and maintain.EMBEDDERS.pop("prefixed")
