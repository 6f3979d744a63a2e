"""A training-corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.

In every stage null and empty texts are rows like others that nothing but the first
stage can reject, null ids and columns of any name are allowed, and an empty table
gives no rows. Rows with equal ids and texts share every decision; the second stage
leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlark.llm import decontaminate, ngram_join, packing, quality, substring_dedup
from postlark.llm.shared import discard, stored, table, tokenizer
from postlark.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling selects."""
    return quality.select(docs, quality.fit(docs, table(ship(spark), sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    ship(spark)
    return ngram_join.dedup(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words or more out of all but the first document with them."""
    ship(spark)
    n = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return substring_dedup.dedup(docs).withColumn("n_chars", n).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of a benchmark item."""
    return decontaminate.clean(docs, table(ship(spark), sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row for each piece."""
    ship(spark)
    return packing.pack(docs, tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup_stage),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The quality and packing stages have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of sf_dir; what a stage kept goes when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
            if before is not None:
                discard(before)
            before = docs
    return docs
