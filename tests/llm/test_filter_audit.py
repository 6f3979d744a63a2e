"""The filter audit against brute force; duplicates over the borders of tasks."""

import re
from collections import defaultdict
from itertools import permutations

import pytest

from postlark.llm import filter_audit


def fails(docs):
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and least[t] < d]
        yield d, part or "", frozenset(x for x, f in zip("ABCDE", at, strict=True) if f)


def brute(docs, labels):
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    rows = list(fails(docs))
    out, shapley = {}, defaultdict(int)
    for order in map("".join, permutations("ABCDE")):
        for part in {p for _, p, _ in rows}:
            for i, x in enumerate(order):
                before = set(order[:i])
                mine = [(d, f) for d, p, f in rows if p == part]
                removed = [d for d, f in mine if x in f and not f & before]
                shapley[part, x] += len(removed)
                out[part, order, i + 1] = [sum(not f & (before | {x}) for _, f in mine), len(removed), sum(x in f and bool(f & before) for _, f in mine), sum(f == {x} for _, f in mine), sum(d in good for d in removed), sum(d in toxic for d in removed)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LONG = " ".join(f"word{i}" for i in range(120))
DOCS = [(i, "same old text", "en") for i in range(60)] + [(5, "same old text", "de")] * 3 + [(None, "same old text", None)] * 4
DOCS += [(100, None, "en"), (101, "", ""), (100, "", None), (102, LONG, "en"), (103, LONG, "fr"), (103, LONG, "fr"), (101, LONG.upper(), "fr"), (104, LONG + " #", "en"), (105, "a b " * 300, "de"), (106, "É" * 9 + "AB", "de"), (107, "never ending words " * 5000, "de"), (108, " \t\n", "en")]
LABELS = [(102, 1, 0), (102, 0, 1), (103, 0, 1), (5, 1, None), (None, 1, 1), (7, None, 1), (999, 1, 1)]


@pytest.mark.parametrize("tasks", [1, 7, 40])
def test_brute_force(spark, tasks):
    docs = spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id long, text string, lang string, mask string").repartition(3)
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert got == brute(DOCS, LABELS)


def test_small_batches(spark):
    """A run goes on from batch to batch within a task."""
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        rows = filter_audit.masks(spark.createDataFrame(DOCS, "doc_id long, text string, lang string")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    of = lambda f: sum(1 << "ABCDE".index(x) for x in f)
    assert sorted(map(str, map(tuple, rows))) == sorted(str((d, p, of(f))) for d, p, f in fails(DOCS))


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    """With one fingerprint for all texts, texts alone tell copies; every task goes on with the one before."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    rows = filter_audit.masks(spark.createDataFrame(DOCS, "doc_id long, text string, lang string")).collect()
    of = lambda f: sum(1 << "ABCDE".index(x) for x in f)
    assert sorted(map(str, map(tuple, rows))) == sorted(str((d, p, of(f))) for d, p, f in fails(DOCS))


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    assert filter_audit.audit(spark.createDataFrame(DOCS[:3], "doc_id long, text string, lang string"), labels).count() == 600
