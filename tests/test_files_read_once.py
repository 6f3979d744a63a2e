"""A mailbox of one block is read and parsed by one task, once; copies are left out without a shuffle of texts; repeated headers are parsed once."""

from email import message_from_bytes, policy

from pyspark.sql import functions as F

from postlark.operators import sync
from postlark.sources import mail_files

BOX = b"From a@b.c Thu Jan  1 00:00:00 2024\nMessage-ID: <%s@x>\nSubject: %s\n\nbody\n>From here\n\n"


def table(spark, folder, names):
    return spark.createDataFrame([(str(folder / n), folder.as_uri(), n, (folder / n).stat().st_size) for n in names], "path string, uri string, rel string, size long")


def test_small_mailboxes_are_read_once(spark, tmp_path):
    (tmp_path / "a.mbox").write_bytes(BOX % (b"1", b"one") + BOX % (b"2", b"two"))
    (tmp_path / "b.mbox").write_bytes(BOX % (b"1", b"one"))
    (tmp_path / "junk.mbox").write_bytes(b"junk\n" + BOX % (b"3", b"three"))
    (tmp_path / "c.eml").write_bytes(b"Subject: four\n\nbody\n")
    (tmp_path / "empty.mbox").write_bytes(b"")
    files = table(spark, tmp_path, ["a.mbox", "b.mbox", "junk.mbox", "c.eml", "empty.mbox"])
    found = mail_files.read_files(files)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(found) == rows(mail_files.read_files(files, 64)) and len(rows(found)) == 5  # the same by blocks

    again = sync.repeated(found, "in")
    assert [(r.path.rsplit("/", 1)[-1], r.number) for r in again.collect()] == [("b.mbox", 1)]
    mail = sync.from_files(found, "me", "in", F.broadcast(again))
    last = mail._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in last and rows(mail) == rows(sync.from_files(found, "me", "in"))


def test_headers_are_parsed_once(monkeypatch):
    seen = []
    fetch = policy.EmailPolicy.header_fetch_parse
    monkeypatch.setattr(policy.EmailPolicy, "header_fetch_parse", lambda self, name, value: seen.append(name.lower()) or fetch(self, name, value))
    raw = b'Subject: s\nFrom: A <a@x>\nContent-Type: multipart/mixed; boundary="once"\n\n--once\nContent-Type: text/plain; charset=utf-8; x=once\n\nbody\n--once\nContent-Type: text/plain; name="o.txt"\nContent-Disposition: attachment; filename="o.txt"\n\nheld\n--once--\n'
    row = mail_files.parse("p/a.eml", "a.eml", raw)
    assert seen.count("content-type") == 3, seen
    held = message_from_bytes(raw, policy=policy.default)
    assert (row[5], row[6], row[10]) == (held["subject"], "a@x", held.get_body().get_content()) and row[12][0][0] == "o.txt"
