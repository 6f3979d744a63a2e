"""Phrase collocations against brute force."""

import re
from collections import Counter

import pytest

from postlark.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, share, top, max_n=4):
    f = {}
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, max_n + 1):
                for i in range(len(ws) - k + 1):
                    f.setdefault(lang or "und", Counter())[tuple(ws[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        often = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, w.decode(), -a, left, right, n, -s) for i, (s, a, w, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


DOCS = [
    ("New York is big. new york, New York! york new", "en"),
    ("of the new york of the\tnew  york of the new york\nof the", "en"),
    ("a a a a a a a a. a a", "en"),
    ("x y z x y z É É é x\x00 x\x00 b", "en"),
    ("new york new york of the new york", None),
    ("new york", "und"),
    ("  \n,,; ", "de"),
    ("", "de"),
    (None, "de"),
    ("契約 更新 契約 更新 契約 更新 ü", "ja"),
    ("big words " * 3000 + "end", "long"),
] * 2


@pytest.mark.parametrize(("least", "share", "top"), [(2, 80, 2000), (4, 50, 3), (1, 100, 2000)])
def test_brute_force(spark, monkeypatch, least, share, top):
    monkeypatch.setattr(collocations, "_CHUNK", 1)
    docs = spark.createDataFrame([(t, x, "clash") for t, x in DOCS], "text string, lang string, phrase string").repartition(5)
    got = collocations.mine(docs, least=least, share=share, top=top).collect()
    assert sorted(map(tuple, got)) == brute(DOCS, least, share, top)


def test_a_full_set_of_bits_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_CHUNK", 1)
    docs = spark.createDataFrame(DOCS, "text string, lang string")
    levels = [sorted(map(tuple, x.collect()), key=str) for x in collocations.frequent(docs, least=3, most_bits=8)]
    assert levels == [sorted(map(tuple, x.collect()), key=str) for x in collocations.frequent(docs, least=3)]


def test_empty(spark):
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [("x", "a b", 9 * 10**17 + 1, 2), ("x", "a", 9 * 10**17 + 1, 1), ("x", "b", 10**18, 1), ("x", None, 3 * 10**18, 1)]
    level = spark.createDataFrame(rows, "lang string, phrase string, f long, words int")
    (row,) = collocations.scored([level.where("words = 1"), level.where("words = 2")]).collect()
    assert row.score == 2000000 * (9 * 10**17 + 1) // (9 * 10**17 + 1 + 10**18)
