"""Decontamination where one prefix token has very many places."""

from pyspark.sql import functions as F

from postlark.llm import decontaminate as dec
from test_llm import brute_decontaminate


def test_hot_prefix_token(spark):
    """Items of one and two common words; their places are dealt to many groups, also those of one long text."""
    items = [("a", "the"), ("b", "of the"), ("c", "The"), ("d", "of the people by the people for the people shall not"), ("e", None)]
    texts = ["the " * 400, "of the " * 90, "it is of the people by the people for the people shall not perish", "", None, "of", *["so of the road"] * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = sorted(map(str, brute_decontaminate(list(enumerate(texts)), [i for i in items if i[1]])))
    for rows in (7, dec.PLACE_ROWS):
        got = dec.decontaminate(docs, bench, block=0, place_rows=rows)
        got = got.select("doc_id", "n_words", dec.n_hit(), F.size("items").cast("long"), F.sha2(F.concat_ws(",", "items"), 256), dec.n_hit() > 0)
        assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_groups_of_a_hot_token_are_many(spark):
    """No group of places has much more than its share."""
    docs = spark.createDataFrame([(i, i, "the " * 50) for i in range(40)], "r1 long, r2 long, text string")
    counts = spark.sparkContext.broadcast(dec._bucket_counts(docs, [1]))
    bits = spark.sparkContext.broadcast(dec.np.full(1024, -1, dec.np.int64).view(dec.U64))
    held = dec._places(docs, bits, 1 << 16, [1], 10, counts, 100).groupBy("group").count().collect()
    assert sum(r["count"] for r in held) == 2000 and len(held) == 20 and max(r["count"] for r in held) < 200
