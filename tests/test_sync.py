"""Sync of mail files, and reconciliation of what files hold."""

import pytest

from postlark.operators import sync
from postlark.operators.search import Filters, Index, entries
from postlark.functions.embed import hash_vector
from postlark.sources.envelopes import MAIL
from postlark.sources.mail_files import read_mail, scan
from postlark.streaming.ingest import Snapshots

FILES = "root_key string, rel_path string, size long, mtime_ms double, changed boolean, status string, failures array<string>, failed_entries array<string>, keys array<string>"
UNLISTED = "root_key string, rel_path string"


def mbox(*subjects):
    return b"".join(b"From a@b.c Thu Jan  1 00:00:00 2024\nMessage-ID: <%s@x>\nFrom: a@b.c\nTo: d@e.f\nSubject: %s\n\nbody of %s\n\nOn Tue, x wrote:\n> old %s\n\n" % ((s.encode(),) * 4) for s in subjects)


def test_folder_synced_twice(spark, tmp_path):
    (tmp_path / "in/Work").mkdir(parents=True)
    (tmp_path / "in/box.mbox").write_bytes(mbox("one", "two"))
    (tmp_path / "in/Work/three.eml").write_bytes(b"Message-ID: <three@x>\nSubject: Re: one\nX-Gmail-Labels: Inbox,Category Promotions\n\nspecial offer\n")
    into = Snapshots(spark, str(tmp_path / "out"))
    mail = lambda: sync.from_files(read_mail(scan(spark, str(tmp_path / "in"))), "me")
    first = sync.sync(into, mail()).first()
    assert (first.added, first.updated, first.unchanged, first.excluded, first.excluded_by_reason, first.chunks) == (2, 0, 0, 1, {"promotions": 1}, 4)
    (tmp_path / "in/box.mbox").write_bytes(mbox("one", "two", "four").replace(b"body of two", b"other"))
    reports = [sync.sync(into, mail(), policy=()) for _ in range(2)]
    assert [(r.added, r.updated, r.unchanged, r.chunks) for r in (x.first() for x in reports)] == [(2, 1, 1, 7), (0, 0, 4, 7)]
    assert sync.roll_up(reports[0].unionByName(reports[1])).first().added == 2
    m = into.read("messages")
    assert {r.mailbox for r in m.collect()} == {"box", "Work"}
    Index.write(entries(into.read("chunks"), m), str(tmp_path / "index"))
    index = Index.read(spark, str(tmp_path / "index"))
    vectors = into.read("chunks").toPandas()[["chunk_id", "content_hash", "text"]]
    vectors = spark.createDataFrame([(c, h, hash_vector(t)) for c, h, t in vectors.itertuples(index=False)], "chunk_id string, content_hash string, vector array<double>")
    assert [r.snippet for r in index.search("other").collect()] == ["other"]
    assert index.search("body", filters=Filters(mailbox="Work")).count() == 0
    assert index.search("special offer", mode="semantic", vectors=vectors, embed=hash_vector).first().snippet == "special offer"
    both = index.search("special offer", mode="hybrid", vectors=vectors, embed=hash_vector).orderBy("rank").first()
    assert both.mode == "hybrid" and both.score == pytest.approx(2 / 61)
    with pytest.raises(ValueError, match="unsupported mode"):
        index.search("x", mode="fuzzy")
    with pytest.raises(ValueError, match="empty query"):
        index.search("  ")


def test_raw_message_and_attachments(spark, tmp_path):
    raw = "Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\nhello\n--b\nContent-Type: text/csv\nContent-Disposition: attachment; filename=t.csv\n\n1,2\n--b--\n"
    row = {"accountId": "a", "mailbox": "i", "providerKey": "k", "subject": " Re: S ", "text": "ignored", "rawMime": raw}
    into = Snapshots(spark, str(tmp_path))
    sync.sync(into, spark.createDataFrame([row], MAIL))
    m, files = into.read("messages").first(), sync.list_attachments(into.read("attachments")).collect()
    assert (m.latest_text, m.normalized_subject, m.attachment_text.strip()) == ("hello", "s", "1,2")
    assert [(f.attachment_id, f.name, f.mime_type) for f in files] == [(f"{m.message_id}:0", "t.csv", "text/csv")] and len(files[0].content_hash) == 64
    assert sync.get_message(into.read("messages"), m.message_id).count() == 1
    with pytest.raises(ValueError, match="identity is required"):
        sync.sync(into, spark.createDataFrame([row | {"providerKey": " "}], MAIL))
    with pytest.raises(ValueError, match="duplicate"):
        sync.sync(into, spark.createDataFrame([row, row], MAIL))
    with pytest.raises(ValueError, match="another message"):
        sync.sync(into, spark.createDataFrame([row | {"messageId": "other"}], MAIL))


def state(spark, links=(), files=(), roots=()):
    return sync.Held(*(spark.createDataFrame(list(x), s) for x, s in zip((links, files, roots), sync._HELD.values(), strict=True)))


def looked(spark, files, unlisted=(), authoritative=False, roots=("r",)):
    rows = [("r", p, 1, 1.0, True, s, f, f, k) for p, s, f, k in files]
    return sync.Scan("me", roots, spark.createDataFrame(rows, FILES), spark.createDataFrame(list(unlisted), UNLISTED), authoritative)


def row(path, root="r", failed=()):
    return (root, path, "me", 1, 1.0, "", list(failed), list(failed))


CASES = {
    "gone": ([("r", "a", "1"), ("r", "b", "1"), ("r", "c", "2")], [("a", "complete", [], ["1"])], [], False, {"2"}, {("r", "a", "1")}, {"a"}),
    "unlisted": ([("r", "d/a", "1"), ("r", "da", "2")], [], [("r", "d")], False, {"2"}, {("r", "d/a", "1")}, {"d/a"}),
    "nothing listed": ([("r", "a", "1")], [], [("r", "")], True, set(), {("r", "a", "1")}, {"a"}),
    "partial, all there": ([("r", "a", "1")], [("a", "partial", ["a#2"], ["1", "3"])], [], False, set(), {("r", "a", "1"), ("r", "a", "3")}, {"a"}),
    "partial, one lacks": ([("r", "a", "1"), ("r", "a", "2")], [("a", "partial", ["a#2"], ["1"])], [], False, set(), {("r", "a", "1"), ("r", "a", "2")}, {"a"}),
    "unreadable": ([("r", "a", "1")], [("a", "unreadable", ["a"], [])], [], False, set(), {("r", "a", "1")}, set()),
    "authoritative": ([("r", "a", "1"), ("old", "x", "2"), ("old", "y", "1")], [("a", "complete", [], ["1"])], [], True, {"2"}, {("r", "a", "1")}, {"a"}),
    "authoritative with a failure": ([("r", "a", "1"), ("old", "x", "2")], [("a", "partial", ["a#9"], ["1"])], [], True, set(), {("r", "a", "1"), ("old", "x", "2")}, {"a", "x"}),
}


@pytest.mark.parametrize("name", CASES)
def test_reconcile(spark, name):
    links, files, unlisted, authoritative, released, left, states = CASES[name]
    held = state(spark, links, {row(p, r) [:2]: row(p, r, ["before"]) for r, p, _ in links}.values(), [("r", "me"), ("old", "me")])
    after, gone = sync.reconcile(held, looked(spark, files, unlisted, authoritative), "")
    assert {r.provider_key for r in gone.collect()} == released
    assert {tuple(r) for r in after.links.collect()} == left
    kept = {r.rel_path: r.failed_entries for r in after.files.collect()}
    assert set(kept) == states
    if name == "partial, one lacks":
        assert kept["a"] == ["before"]
    assert {r.root_key for r in after.roots.collect()} == ({"r"} if name == "authoritative" else {"r", "old"})


def test_file_status(spark):
    rows = [("a", "a#1", None), ("a", "a#2", "bad"), ("b", "b", "no mbox"), ("c", "c#1", "bad"), ("d", "d", None)]
    known = spark.createDataFrame([("c", ["c#1"])], "path string, failed_entries array<string>")
    got = sync.file_status(spark.createDataFrame(rows, "path string, label string, error string"), known)
    assert {r.path: r.status for r in got.collect()} == {"a": "partial", "b": "unreadable", "c": "complete", "d": "complete"}
