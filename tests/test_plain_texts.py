"""Plain texts (Latin letters and punctuation) are taken apart over Arrow batches, with the tokens that Spark's functions make; texts are looked at once."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from postlark.functions import text as T
from postlark.operators import search
from postlark.session import ship

PLAIN = [chr(c) for a, b in T._PLAIN for c in range(a, b)]


def test_tokens_of_plain_texts(spark):
    """Each character alone, between letters and after itself, and mixed texts; others are left to Spark."""
    ship(spark)
    rng = random.Random(1)
    texts = PLAIN + [f"a{c}b{c}{c}" for c in PLAIN] + [None, "", " ", "İİx"] + ["".join(rng.choices([*PLAIN, *"aB " * 400], k=rng.randint(0, 60))) for _ in range(500)]
    odd = ["ẞ", "á", "한 x", "ΑΣ", "😀"]
    df = spark.createDataFrame(list(enumerate(texts + odd)), "i int, t string")
    df = df.select("i", "t", T.tokens(F.coalesce("t", F.lit(""))).alias("want"), T.plain(F.col("t")).alias("plain"), T.plain_sizes(F.when(T.plain(F.col("t")), F.col("t")), F.lit("x y")).alias("n"))
    rows = sorted(df.collect())
    assert [r.plain for r in rows] == [True] * len(texts) + [False] * len(odd)
    counts, tokens = T.plain_tokens(pa.array(["cut", *texts])[1:])
    tokens, at = tokens.to_pylist(), 0
    for r, n in zip(rows, counts, strict=False):
        assert (tokens[at : at + n], r.n) == (r.want, n + 2), repr(r.t)
        at += n
    assert at == len(tokens)


def test_postings_of_plain_and_other_texts(spark):
    ship(spark)
    rows = [("c1", "One two two", "Été one"), ("c2", None, "two"), ("c3", "Ünë ΑΣ", "한국 one one"), ("c4", "", " "), ("c5", "One two two", "x")]
    docs = spark.createDataFrame(rows, "chunk_id string, subject string, text string")
    slow = lambda c: T.tokens(c)  # noqa: E731  (another function, so that Spark takes all texts apart)
    rows = lambda df: sorted((r.chunk_id, r.term, r.tf, r.dl, r.positions) for r in df.collect())
    want = rows(search.postings(docs, ("subject", "text"), analyze=slow))
    assert rows(search.postings(docs, ("subject", "text"))) == want and ("c1", "two", 2, 5, [1, 2]) in want
    assert "_0" in search._sorted_list(docs, ("subject", "text"))._jdf.queryExecution().executedPlan().toString()
    assert rows(search._sorted_list(docs, ("subject", "text"))) == want
    held = search.measured(docs, ("subject", "text"))
    assert {r.chunk_id: r.lens for r in held.collect()} == {"c1": {"all": 5}, "c2": {"all": 1}, "c3": {"all": 5, "ko": 5}, "c4": {"all": 0}, "c5": {"all": 4}}
    plan = held._jdf.queryExecution().executedPlan().toString()
    evaluated = re.findall(r"ArrowEvalPython \[(.*?)\], \[", plan)
    assert 0 < sum(x.count("nfkc(") for x in evaluated) <= 2, evaluated  # a column, not a column and language


def test_paragraphs_and_quotes(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(["a", "bc ", "\n", "\n", " ", "\t", "\r\n", " ", "> q\n", "On x wrote:\n", "--- Original message ---\n", "On x WROTE: y"], k=rng.randint(0, 14))) for _ in range(500)] + [None]
    a, b = T.split_quoted(F.col("t"))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.split_text(F.coalesce("t", F.lit(""))).alias("ps"), a.alias("latest"), b.alias("quoted"))
    blank = T._BLANKS
    for r in df.collect():
        want = re.split(rf"[{blank}]*\n[{blank}]*\n[{blank}]*", (r.t or "").strip(blank))
        assert r.ps == [p for p in want if p], repr(r.t)
        if r.t is None:
            assert (r.latest, r.quoted) == (None, None)
            continue
        raw = r.t.split("\n")
        at = next((i for i, x in enumerate(raw) if re.match(r"(?i)(?:On .+ wrote:|>|[- ]*Original Message[- ]*$)", x.removesuffix("\r").strip(blank))), len(raw))
        assert (r.latest, r.quoted) == ("\n".join(raw[:at]).strip(blank), "\n".join(x.removesuffix("\r") for x in raw[at:]).strip(blank)), repr(r.t)
