"""One call from folders of mail files to a synced archive."""

import os

import pytest

from postlark.operators import sync
from postlark.sources.mail_files import read_files, read_mboxes
from postlark.streaming.ingest import Snapshots
from test_mail_scan import MBOX


def box(*subjects):
    return b"".join(b"From a@b.c Thu Jan  1 00:00:00 2024\nMessage-ID: <%s@x>\nSubject: %s\n\nbody\n\n" % (s, s) for s in subjects)


def test_looks_at_a_folder(spark, tmp_path):
    """New, unchanged, changed and removed files; broken, moved and repeated messages."""
    top = tmp_path / "in box"
    (top / "Work").mkdir(parents=True)
    (top / "a.mbox").write_bytes(box(b"one", b"two"))
    (top / "b.mbox").write_bytes(box(b"three"))
    (top / "empty.mbox").write_bytes(b"")
    (top / "Work/four.eml").write_bytes(b"Message-ID: <four@x>\nSubject: four\n\nbody\n")
    (top / "Work/bad.eml").write_bytes(b"\n\nno header\n")
    into = Snapshots(spark, str(tmp_path / "out"), buckets=4)
    look = lambda *a, **k: sync.sync_folder(into, [str(top)], *a, **k).first().asDict()
    pick = lambda r, *names: tuple(r[n] for n in names)
    with pytest.raises(ValueError, match="bad.eml"):
        look(strict=True)
    assert into.version() == 0
    r = look()
    assert pick(r, "added", "files", "files_read", "files_unchanged", "failures", "files_unreadable") == (4, 5, 5, 0, 1, 0)
    assert {m.account_id for m in into.read("messages").collect()} == {"in box"}
    assert {m.mailbox for m in into.read("messages").collect()} == {"a", "b", "Work"}

    (top / "a.mbox").write_bytes(box(b"one"))
    os.remove(top / "b.mbox")
    (top / "c.mbox").write_bytes(box(b"five", b"five"))
    r = look()
    assert pick(r, "added", "deleted", "unchanged", "files_read", "files_unchanged", "duplicates", "failures") == (1, 2, 1, 2, 3, 1, 1)
    assert {m.subject for m in into.read("messages").collect()} == {"one", "four", "five"}
    assert [p.kind for p in into.read("problems").collect()] == ["failed"]

    # A broken message leaves what its file held; stray bytes before the first separator do too.
    (top / "a.mbox").write_bytes(b"From a@b.c Thu Jan  1 00:00:00 2024\n\nno headers\n\n" + box(b"six"))
    (top / "c.mbox").write_bytes(b"junk\n" + box(b"five"))
    r = look()
    assert pick(r, "added", "deleted", "files_partial", "files_unreadable", "files_read") == (1, 0, 1, 1, 2)
    assert {p.kind for p in into.read("problems").collect()} == {"failed", "partial", "unreadable"}
    r = look()  # a file that could not be read is tried again
    assert pick(r, "files_read", "files_unreadable", "files_unchanged") == (1, 1, 4)


def test_account_releases_other_roots(spark, tmp_path):
    for name in ("old", "new"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.mbox").write_bytes(box(name.encode(), b"both"))
    into = Snapshots(spark, str(tmp_path / "out"), buckets=4)
    sync.sync_folder(into, [str(tmp_path / "old")], "me")
    single = sync.sync_folder(into, [str(tmp_path / "new/m.mbox")], "me").first()
    assert (single.added, single.deleted, single.unchanged) == (1, 1, 1)
    assert {m.subject for m in into.read("messages").collect()} == {"new", "both"}
    with pytest.raises(ValueError, match="cannot be read"):
        sync.sync_folder(into, [str(tmp_path / "nowhere")])


def test_only_failures_raise(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.mbox").write_bytes(b"junk\n")
    with pytest.raises(ValueError, match="no message could be read"):
        sync.sync_folder(Snapshots(spark, str(tmp_path / "out")), [str(tmp_path / "in")])


def test_blocks_of_files_equal_blocks_of_sources(spark, tmp_path):
    """Separators at, across and after the ends of blocks of every size; a missing file is a failure."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "x.mbox").write_bytes(MBOX * 2 + b"\nFrom c\nFrom: a@b.c\n\ntext\nFrom here\n\nFrom d\nSubject: t\n\nmore\n")
    (folder / "y.mbox").write_bytes(b"\nFrom c\nSubject: u\n\ntext")
    want = sorted(repr(r[1:]) for r in read_mboxes(spark, str(folder)).collect())
    assert len(want) == 4
    rows = [(str(f), folder.as_uri(), f.name, f.stat().st_size) for f in sorted(folder.iterdir())]
    rows.append((str(folder / "z.mbox"), folder.as_uri(), "z.mbox", 10))
    rows.append((str(folder / "z.eml"), folder.as_uri(), "z.eml", 10))
    files = spark.createDataFrame(rows, "path string, uri string, rel string, size long")
    for size in (5, 6, 7, 13, 64, 4096):
        got = read_files(files, size).collect()
        assert sorted(repr(r[1:]) for r in got if not r.path.startswith(str(folder / "z"))) == want, size
        assert sorted((r.label, r.error) for r in got if r.path.startswith(str(folder / "z"))) == [("z.eml", "file cannot be read"), ("z.mbox", "file cannot be read")]
