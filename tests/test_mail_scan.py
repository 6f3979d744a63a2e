"""Which files of a folder are mail files."""

import random

from postlark.sources.mail_files import read_folder, read_mail, scan

MBOX = b"From a@b.c Thu Jan  1 00:00:00 2024\nFrom: a@b.c\nSubject: s\n\nbody\n"


def test_scan_finds_bundles_and_any_case(spark, tmp_path):
    for name in ("Inbox.mbox/mbox", "Old.MBox/mbox", "plain/mbox", "a.Eml", "b.MbX", "c.mbox", "d.txt", "mbox"):
        file = tmp_path / "in" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(MBOX.split(b"\n", 1)[1] if name == "a.Eml" else MBOX)
    rows = read_mail(scan(spark, str(tmp_path / "in"))).collect()
    assert {r.path.split("/in/")[1] for r in rows} == {"Inbox.mbox/mbox", "Old.MBox/mbox", "a.Eml", "b.MbX", "c.mbox"}
    assert all(r.error is None and r.subject == "s" for r in rows)


def test_mailboxes_by_blocks_equal_whole_ones(spark, tmp_path):
    """Random mailboxes with separators, half separators, escapes and odd starts, in blocks of a few bytes."""
    rng = random.Random(7)
    lines = [b"From a@b.c Thu Jan  1 00:00:00 2024\n", b"From \n", b"\n", b"\n", b"\r\n", b"Subject: s\n", b"Subject: t\n\nlong body \xff\n", b">From x\n", b">>From y\r\n", b"body", b"text\n", b"From: a@b.c\n\n", *[b"\n\nFrom a\nSubject: u\n\nbody\n"] * 3]
    for i in range(40):
        start = rng.choice((b"", b"\xef\xbb\xbf", b"\n", b"\r\n", b"junk\n", *lines[:1] * 6))
        file = tmp_path / "in" / f"m+ {i}%.mbox"
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(start + b"".join(rng.choices(lines, k=rng.choice((0, 1, 4, 30, 120)))))
    (tmp_path / "in/x.mbox").write_bytes(MBOX * 3)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "0")
    try:
        got = sorted(map(repr, read_folder(spark, str(tmp_path / "in")).collect()))
    finally:
        for n in names:
            spark.conf.unset(n)
    want = read_mail(scan(spark, str(tmp_path / "in"))).collect()
    assert got == sorted(map(repr, want))
    assert len(want) > 150 and sum(r.error is None for r in want) > 50
