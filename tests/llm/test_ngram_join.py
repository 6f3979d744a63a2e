"""The n-gram join on texts made of few phrases, split lists and small blocks, and odd rows."""

import random

import pytest
from test_llm import brute_join, words

from postlark.llm import ngram_join

SCHEMA = "doc_id long, text string"


def templates(n, seed):
    """Texts of a few phrases with edits: frequent shingles, chains of links, groups whose members do not all link."""
    draw = random.Random(seed)
    phrases = [" ".join(f"p{i}w{j}" for j in range(draw.randrange(4, 14))) for i in range(7)]
    rows = []
    for i in range(n):
        if i % 3 == 0 or not rows:
            text = " ".join(draw.choice(phrases) for _ in range(draw.randrange(1, 12))) + (f" x{i}" if i % 2 else "")
        else:
            w = draw.choice(rows)[1].split()
            w[draw.randrange(len(w))] = f"e{draw.randrange(9)}"
            text = " ".join(w)
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("options", [{}, {"list_rows": 3, "block": 2, "bucket_rows": 50}])
def test_components_of_templates(spark, options):
    rows = templates(260, 4)
    got = ngram_join.similar(spark.createDataFrame(rows, SCHEMA).repartition(5), **options)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_join(rows)


@pytest.mark.parametrize("options", [{}, {"list_rows": 3, "block": 2, "bucket_rows": 50}])
def test_every_link_once(spark, options):
    rows = templates(160, 9)
    member, pairs = ngram_join.links(spark.createDataFrame(rows, SCHEMA).repartition(5), **options)
    of = {}
    for r in member.collect():
        of.setdefault((r.c1, r.c2), []).append(r.doc_id)
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for d, t in rows for w in [words(t)]}
    reps = sorted(min(ids) for ids in of.values())
    want = [(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = [tuple(sorted((min(of[r.a1, r.a2]), min(of[r.b1, r.b2])))) for r in pairs.collect()]
    assert sorted(got) == want and len(want) > 50


def test_dedup_keeps_columns_of_any_name(spark):
    text = "a b c d e f g h i j"
    rows = [(5, text, 1, 2, "x"), (2, text, 3, 4, "y"), (2, text, 3, 4, "y"), (None, text, 5, 6, "z"), (None, "other words that link with nothing", 7, 8, "w"), (9, None, 9, 9, "v"), (9, None, 9, 9, "v"), (8, "", 0, 0, "u"), (None, None, 1, 1, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, r1 int, R2 int, again string")
    got = ngram_join.dedup(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[4], rows[5], rows[7], rows[8]], key=str)
