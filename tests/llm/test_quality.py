"""The quality classifier on planted texts: what n-grams see, and labels it was not fitted on."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlark.llm import quality

HAN = [chr(0x4E00 + i) for i in range(400)]


def grams(text):
    return set(quality._grams(pa.array([text]))[1].tolist())


@pytest.mark.parametrize(
    ("one", "other"),
    [("a big old cat", "a big bad cat"), ("harmless", "harmlessly"), ("good day not bad", "bad day not good"), ("天气很好" * 300, "天气很好" * 300 + "坏词")],
)
def test_ngrams_cover_the_whole_text(one, other):
    assert grams(one) != grams(other)


def planted(n, seed):
    """Rows (doc_id, text, good): a tenth holds one of some bad words; by turns in blanks and in none."""
    draw = random.Random(seed)
    for i in range(n):
        bad = i % 10 == 0
        if i % 20 < 10:
            text = [f"word{draw.randrange(300)}" for _ in range(60)]
            text[30:30] = ["contentwise", "ass"] if bad else ["contented", "as"]
            yield i, " ".join(text), not bad
        else:
            text = [draw.choice(HAN) for _ in range(90)]
            text[60:60] = "坏词坏" if bad else ""
            yield i, "".join(text), not bad


@pytest.mark.parametrize("n", [600, 4000])
@pytest.mark.parametrize("unlabelled", [0, 4])
def test_held_out_bad_documents_go_at_every_size(spark, n, unlabelled):
    rows = list(planted(n, 1))
    known = [r for r in rows if r[0] // 20 % (2 + unlabelled) == 0]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in known], "doc_id long, quality long, toxic long")
    kept = {r.doc_id for r in quality.resample(docs, quality.fit(docs, labels), keep={"doc_id": F.col("doc_id")}).where("selected").collect()}
    held = [r for r in rows if r not in known]
    good, bad = [r for r in held if r[2]], [r for r in held if not r[2]]
    assert sum(r[0] in kept for r in good) >= 0.98 * len(good)
    assert sum(r[0] in kept for r in bad) <= 0.05 * len(bad)
