"""Searches that skip blocks of long lists give what full scoring gives."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from postlark.operators import search
from postlark.streaming.ingest import Snapshots


def held(spark, rows):
    shown = {c: F.lit("") for c in search.SHOWN if c not in ("to_addresses", "mailbox")} | {"to_addresses": F.array(F.lit("")), "content_hash": F.lit("")}
    return spark.createDataFrame(rows, "chunk_id string, mailbox string, text string").withColumns(shown)


def texts(rng, ids):
    """Texts of 1 to 300 words, the most frequent in nearly all; many are alike."""
    words = [f"w{i}" for i in range(40)]
    return [(f"c{i}", rng.choice("ab"), " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.choice((1, 2, 5, 30, 300))))) for i in ids]


def test_blocks_equal_full_scoring(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "_LONG", 40)
    monkeypatch.setattr(search, "_FIRST", 1)
    rng = random.Random(3)
    into = Snapshots(spark, str(tmp_path / "i"), buckets=2)
    into.publish(search.changes(into, 0, held(spark, texts(rng, range(600))), None, ("text",)))
    into.publish(search.changes(into, 1, held(spark, texts(rng, range(500, 900))), spark.range(60).select(F.concat(F.lit("c"), "id").alias("chunk_id")), ("text",)))

    def compare():
        index = search.Index.of(into)
        fewer = 0
        for wanted in ([["w0"]], [["w1"]], [["w0"], ["w1"]], [["w0"], ["w30"]], [["w39"]], [["w2"], ["w2"]], [["w0"], ["none"]], [["w0", "w1"]]):
            for filters in (None, search.Filters(mailbox="a")) if len(wanted) == 1 else (None,):
                got, want = (x.top("all", wanted, 5, filters).select("chunk_id", F.round("score", 9), "rank").collect() for x in (index, replace(index, blocks=None)))
                assert sorted(got, key=lambda r: r.rank) == sorted(want, key=lambda r: r.rank), wanted
            read = index.reading("all", wanted, 5)[0].count()
            every = replace(index, blocks=None).reading("all", wanted, 5)[0].count()
            assert read <= every
            fewer += read < every * 0.9
        return index, fewer

    index, fewer = compare()
    assert fewer >= 4 and index.blocks.select("seg").distinct().count() == 2
    search.merge_segments(into, 2)
    index, fewer = compare()
    assert fewer >= 4 and index.blocks.select("seg").distinct().count() == 1
    n = index.blocks.where("lang = 'all' AND term = 'w0'").agg(F.sum("n")).first()[0]
    assert n == index.of_terms("all", ["w0"]).count()
