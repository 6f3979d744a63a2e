"""Original records from the archive, byte for byte."""

import pathlib

from postlark.llm import warc

PAGES = [(1, "http://a.com/1", "<p>é漢字</p>"), (2, "http://a.com/2", None), (3, "http://a.com/3", ""), (4, "http://a.com/é", "<p>é漢字</p>"), (5, None, "a\r\n\r\nb\r\n\r\n"), (6, "http://a.com/6", "plain")]
REVISITS = {4: 1, 3: 2}


def expected(page_id, url, html, digest):
    payload = (html or "").encode()
    of = REVISITS.get(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if of else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {url or ''}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if of:
        lines += [f"WARC-Refers-To: <urn:page:{of}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode(), payload


def test_records_come_back_byte_for_byte(spark, tmp_path):
    import base64
    import hashlib

    path = warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    got = {r.id: r for r in warc.parse_records(warc.reconstruct(spark, path)).collect()}
    assert len(got) == len(PAGES)
    records = []
    for page in PAGES:
        head, payload = expected(*page, base64.b32encode(hashlib.sha1((page[2] or "").encode()).digest()).decode())
        r = got[page[0]]
        assert (bytes(r.header), bytes(r.payload)) == (head, payload)
        records.append(head + payload + b"\r\n\r\n")
        assert bytes(r.record) == records[-1]
    warc.write_files(spark, path, str(tmp_path / "out"))
    files = b"".join(f.read_bytes() for f in pathlib.Path(tmp_path, "out").glob("part-*"))
    assert len(files) == sum(map(len, records)) and all(r in files for r in records)
