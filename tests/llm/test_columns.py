"""Columns of any name, null ids, repeated rows and one long text, for every operator and every stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postlark.llm import decontaminate, langid, neighbours, packing, quality, toolcalls, url_filter, warc
from postlark.llm.shared import table, tokenizer

EXTRA = "whole gone items spans selected text2 __row r1 r2 again kept n_words log_weight gumbel_key lang_pred score k0 vec_id part bucket".split()


def widened(df):
    """df with a repeated row, a row with a null id, one long text, and columns that have the operators' own names."""
    rows = df.limit(40)
    first = rows.limit(1)
    odd = first.withColumn(df.columns[0], F.lit(None).cast("long"))
    out = rows.unionByName(first).unionByName(odd)
    if "text" in df.columns:
        out = out.unionByName(first.withColumn("text", F.repeat(F.lit("never ending words "), 20_000)))
    return out.withColumns({c: F.lit(f"x{i}") for i, c in enumerate(EXTRA) if c not in df.columns})


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, sf_dir, stage):
    docs = widened(table(spark, sf_dir, "documents"))
    out = stage[1](spark, docs, sf_dir)
    if stage is not corpus_pipeline.STAGES[-1]:
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select(*[c for c in EXTRA if c in docs.columns]).distinct().collect()} == {tuple(f"x{i}" for i, c in enumerate(EXTRA))}
    assert out.count() > 0


def test_operators(spark, sf_dir):
    docs, pages = widened(table(spark, sf_dir, "documents")), widened(table(spark, sf_dir, "pages"))
    n = docs.count()
    keep = {c: F.col(c) for c in docs.columns}
    found = langid.predict(docs, langid.fit(docs), keep=keep)
    assert found.count() == n and found.columns == [*docs.columns, "_lang_pred", "_score"]
    assert decontaminate.decontaminate(docs, widened(table(spark, sf_dir, "benchmark")), keep=tuple(docs.columns)).count() == n
    assert quality.resample(docs, quality.fit(docs, widened(table(spark, sf_dir, "labels"))), keep=keep).columns[-3:] == ["_log_weight", "_gumbel_key", "_selected"]
    assert packing.pack(docs, tokenizer()).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert warc.round_trip(pages).count() == url_filter.filter_urls(pages).count() == pages.count()
    assert toolcalls.link(*toolcalls.from_conversations(widened(table(spark, sf_dir, "conversations"))), toolcalls.TURN_SCHEMAS).count() > 0
    near = neighbours.neighbours(widened(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 10 == 0)
    assert near.where("rank = 1").count() == near.select("query_id").distinct().count() == 4


def test_lengths_are_searched_by_themselves(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 1.0]), (4, [9.0])]
    got = neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True))
    assert sorted((r.query_id, r.vec_id) for r in got.collect()) == [(0, 1), (1, 0), (2, 3), (3, 2)]


def test_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Bad", True), ("bad", False), ("soft", False), ("", True), (None, True), ("mild", None)], "term string, strict boolean")
    strict, soft = url_filter.vocabulary(terms)
    assert (strict, soft) == (("bad",), ("mild", "soft"))
    pages = spark.createDataFrame([(1, "http://a.b/BAD"), (2, "http://a.b/soft"), (3, "http://a.b/soft-mild"), (4, "http://a.b/badly")], "page_id long, url string")
    got = url_filter.filter_urls(pages, strict=strict, soft=soft).collect()
    assert [r.verdict for r in sorted(got, key=lambda r: r.page_id)] == ["block", "allow", "block", "allow"]
    with pytest.raises(ValueError, match="more than 2 terms"):
        url_filter.vocabulary(terms, most=2)
