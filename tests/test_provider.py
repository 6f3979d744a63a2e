"""Pages of a provider as a data source, reads in rounds, dead letters, looks."""

import json

import pytest

from postlark.operators import search, sync
from postlark.plans import mail
from postlark.sources import provider
from postlark.streaming.ingest import Snapshots


def folder(tmp_path, pages, raw):
    for name, text in [*((f"pages/{k}", v) for k, v in pages.items()), *((f"messages/{k}", v) for k, v in raw.items())]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def page(*keys, **more):
    return json.dumps({"envelopes": [{"id": k} | more for k in keys]}) + "\n"


def test_pages(spark, tmp_path):
    uri = folder(tmp_path, {"a": page("1") + page("2"), "b": page("3"), "_c": page("4"), "d": ""}, {})
    rows = lambda df: sorted((r.file, r.page, r.value) for r in df.collect())
    want = [("a", 0, page("1").strip()), ("a", 1, page("2").strip()), ("b", 0, page("3").strip())]
    assert rows(provider.pages(spark, uri)) == rows(provider.pages(spark, uri, per_task=1)) == want
    assert provider.pages(spark, uri, per_task=1).rdd.getNumPartitions() == 3
    assert rows(provider.pages(spark, uri, limit=1)) == [want[0], want[2]]
    one = provider.pages(spark, uri, per_task=1, files=["b", "x"])
    assert rows(one) == [want[2]] and one.rdd.getNumPartitions() == 1 and provider.pages(spark, uri, files=[]).count() == 0
    with pytest.raises(Exception, match="limit"):
        provider.pages(spark, uri, limit=-1).collect()


def test_rounds(spark, tmp_path):
    uri = folder(tmp_path, {}, {"1": "one", "a%2Fb": "two"})
    wanted = spark.createDataFrame([("1",), ("a/b",), ("gone",), (None,)], "provider_key string")
    got = {r.provider_key: (r.raw, r.attempts, r.error) for r in provider.fetch(wanted, uri, attempts=2, delay_ms=0).collect()}
    assert got == {"1": ("one", 1, None), "a/b": ("two", 1, None), "gone": (None, 2, "message read failed: FileNotFoundError"), None: (None, 0, "the envelope has no key")}
    assert provider.fetch(wanted.limit(0), uri).count() == 0


def test_looks(spark, tmp_path):
    uri = folder(tmp_path / "in", {"a": page("1", "2", subject="s") + page("1", subject="later"), "b": page("3") + "no json\n"}, {"1": "Subject: s\n\nfirst words\n", "2": "Subject: s\n\nsecond words\n"})
    into = Snapshots(spark, str(tmp_path / "mail"), buckets=4)
    look = lambda **how: sync.sync_provider(into, uri, "me", delay_ms=0, **how).select("listed", "read", "skipped", "failures", "added", "updated", "unchanged").first()
    with pytest.raises(ValueError, match="after 3 attempts"):
        look(strict=True)
    assert into.version() == 0
    assert tuple(look()) == (3, 3, 0, 1, 2, 0, 0)
    assert [tuple(r) for r in into.read("dead_letters").collect()] == [("3", 3, "message read failed: FileNotFoundError")]
    assert {r.subject for r in into.read("messages").collect()} == {"s"} and search.Index.of(into).search("second").count() == 1
    folder(tmp_path / "in", {"b": page("3", flags=["seen"])}, {"3": "Subject: t\n\nthird words\n"})
    assert tuple(look()) == (3, 1, 2, 0, 1, 0, 0) and into.read("dead_letters").count() == 0
    assert tuple(look(policy=("spam",))) == (3, 3, 0, 0, 0, 0, 3)
    nothing = folder(tmp_path / "none", {"a": page("9")}, {})
    with pytest.raises(ValueError, match="no message could be read; 1"):
        sync.sync_provider(Snapshots(spark, str(tmp_path / "other")), nothing, "me", delay_ms=0)


def test_query(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = mail.QUERIES["provider_looks"](spark, sf_dir)
    want = con.execute(mail.SQL["provider_looks"]).fetchdf().iloc[0].to_dict()
    assert {c: int(v) for c, v in want.items()} == got.first().asDict() and set(got.columns) == set(want)
