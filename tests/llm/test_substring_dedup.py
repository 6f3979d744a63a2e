"""Substring deduplication with split buckets, repeated rows, null ids and columns of any name."""

import random

import pytest
from test_llm import brute_substrings

from postlark.llm import substring_dedup

SCHEMA = "doc_id long, text string"


def passages(n, seed):
    """Texts with passages that many share, at all distances from their ends; some repeat one passage."""
    draw = random.Random(seed)
    shared = [" ".join(f"s{i}w{draw.randrange(40)}" for _ in range(size)) for i, size in enumerate((49, 50, 55, 70, 120))]
    for i in range(n):
        own = lambda: " ".join(f"o{i}w{draw.randrange(500)}" for _ in range(draw.randrange(70)))
        parts = [own(), draw.choice(shared), own()] + ([shared[3]] * 9 if i % 11 == 0 else [])
        yield i, draw.choice([" ", "\t", "\n "]).join(parts)


@pytest.mark.parametrize("hot", [2000, 3])
def test_shared_passages(spark, hot):
    rows = list(passages(120, 2))
    got = substring_dedup.digests(spark.createDataFrame(rows, SCHEMA).repartition(4), hot=hot)
    want = sorted(brute_substrings(rows))
    assert sorted(map(tuple, got.collect())) == want
    assert sum(n for _, _, n, _ in want) > 2000


def test_dedup_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(4, text, 1, "a", 1), (4, text, 1, "a", 1), (7, text + " more", 2, "b", 2), (9, text, 3, "c", 3), (None, text, 4, "d", 4), (2, None, 5, "e", 5), (3, "x  y", 6, "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, whole int, gone string, R1 int")
    got = substring_dedup.dedup(docs)
    assert got.columns == docs.columns
    want = [rows[0], rows[1], (7, "more", 2, "b", 2), rows[4], rows[5], rows[6]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
