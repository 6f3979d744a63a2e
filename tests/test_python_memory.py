"""Tasks hold a few parsed rows as Python's objects, not a whole batch."""

import tracemalloc

import pyarrow as pa

from postlark.operators import sync
from postlark.sources import mail_files


def peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_pages_are_parsed_by_slices(spark):
    pages = pa.array([f"<p>page {i}</p><p>{'words of it ' * 100}</p>" for i in range(3000)] + [None, ""])
    got, held = peak(lambda: mail_files.html_to_text.func(pages))
    assert got.to_pylist() == [mail_files.html_text(p) for p in pages.to_pylist()] and got.type == pa.string()
    assert held < 2 << 20  # all texts take 3.6 MB
    assert mail_files.html_to_text.func(pages[:0]).to_pylist() == []
    rows = spark.createDataFrame([("<p>a</p>b",), (None,)], "html string").select(mail_files.html_to_text("html").alias("t")).collect()
    assert [r.t for r in rows] == ["a\nb", ""]


def test_raw_messages_are_parsed_by_slices():
    raw = pa.array([f"Subject: {i}\n\n{'words of it ' * 100}" for i in range(3000)] + [None])
    got, held = peak(lambda: sync._mime.func(raw))
    assert held < 3 << 20  # all texts take 3.6 MB
    assert got[7].as_py() == {"text": "words of it " * 100, "attachments": []} and got[3000].as_py() == {"text": None, "attachments": None}


def test_attachments_of_raw_messages(spark):
    raw = 'Content-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/plain\n\nbody\n--b\nContent-Type: text/plain\nContent-Disposition: attachment; filename="a.txt"\n\nheld\n--b--\n'
    got = spark.createDataFrame([(raw,), (None,)], "raw string").select(sync._mime("raw").alias("m")).collect()
    assert got[0].m.text == "body" and [(a.name, a.mimeType, a.size, a.text) for a in got[0].m.attachments] == [("a.txt", "text/plain", 4, "held")]
    assert got[1].m.text is None and got[1].m.attachments is None
