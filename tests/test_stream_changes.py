"""Counters of a stream do not depend on its batches."""

import random

import pytest

from postlark.streaming.changes import CHANGES, changes, counters, follow
from postlark.streaming.ingest import Snapshots

ROW = "k string, at string, h string, t string, extra string"


def expected(rows, stored):
    last, n = {}, {}
    for k, at, h, t, _ in rows:
        if k is not None and at is not None:
            n[k] = n.get(k, 0) + 1
            best = (at, h is not None, h or "", t or "")
            if k not in last or best > last[k][0]:
                last[k] = best, h, t
    kind = {k: "added" if k not in stored else "unchanged" if stored[k] == v[1] else "updated" for k, v in last.items()}
    threads = {v[2] for k, v in last.items() if kind[k] != "unchanged" and v[2] is not None}
    count = list(kind.values()).count
    return count("added"), count("updated"), count("unchanged"), sum(n.values()) - len(n), len(threads)


@pytest.mark.parametrize("parts", [1, 3])
def test_any_number_of_batches(spark, tmp_path, parts):
    rng = random.Random(3)
    rows = [(rng.choice(("hot", *"abcdefgh", None)), rng.choice((None, *"0123456789")), rng.choice((None, "x", "y")), rng.choice((None, "t1", "t2", "t3")), "e") for _ in range(200)]
    rows += [("hot", "5", "x", "t1", None)] * 100
    stored = {"a": "x", "b": "y", "hot": "y", "unseen": "x"}
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    known = spark.createDataFrame(list(stored.items()), "k string, h string")
    into = Snapshots(spark, str(tmp_path / "out"), buckets=4)
    streamed = changes(source, key="k", order="at", hash_col="h", thread="t", stored=known)
    for _ in range(2):  # started again, it has nothing to do
        follow(streamed, into, str(tmp_path / "check")).awaitTermination()
    assert into.version() == parts
    assert tuple(counters(into.read(CHANGES)).first()) == expected(rows, stored)


def test_nothing_streamed(spark, tmp_path):
    empty = spark.createDataFrame([], "key string, change string, thread string, first string, last string, n long")
    assert tuple(counters(empty).first()) == (0, 0, 0, 0, 0)


def test_a_key_advances_without_operations_on_frames(monkeypatch):
    """A stream of many keys with few rows each spent its time on frames of one row."""
    import pandas as pd

    from postlark.streaming import changes as module

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    monkeypatch.setattr(module, "_combine", lambda rows: pytest.fail("a frame was combined"))
    batch = lambda *rows: pd.DataFrame([("k", *r) for r in rows], columns=["key", "first", "last", "hash", "thread", "n", "base"])
    state = State()
    advance = lambda *batches: next(module._advance(("k",), iter(batches), state)).iloc[0].to_dict()
    assert advance(batch(("2", "5", None, "t", 2, "x"), ("3", "5", "x", None, 1, "x")), batch(("4", "4", "z", "u", 1, "x"))) == {"key": "k", "change": "unchanged", "thread": None, "first": "2", "last": "5", "n": 4}
    assert advance(batch(("1", "1", "y", "u", 1, "x"))) == {"key": "k", "change": "unchanged", "thread": None, "first": "1", "last": "5", "n": 5}
    assert advance(batch(("5", "5", "x", "v", 3, "x"))) == {"key": "k", "change": "unchanged", "thread": "v", "first": "1", "last": "5", "n": 8}
    assert advance(batch(("6", "6", None, None, 1, "x")))["change"] == "updated" and state.get == ("1", "6", None, None, 9, "x")
