"""Places and settings that the jobs of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); without one nothing can be stored."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    This cuts the lineage: what reads the result depends on files that outlive
    executors, and what df was computed from is not computed again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Deletes the files of frames that stored() gave and nothing reads any more."""
    for df in dfs:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The path of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh(columns: Iterable[str], *wanted: str) -> tuple[str, ...]:
    """The wanted names, each with so many underscores in front that no column has it."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """A 128-bit hash of a row's id and text as two longs; equal for repeated rows alone."""
    held = [F.col(id_col).cast("long"), F.col(text_col).cast("string")]
    kind = F.when(held[0].isNull(), 1).otherwise(0) + F.when(held[1].isNull(), 2).otherwise(0)  # a null hashes as nothing
    return F.xxhash64(kind, *held), F.xxhash64(F.lit(7), kind, *held)


def total_counts(chunks: DataFrame, buckets: int, size: int) -> np.ndarray:
    """Sums rows (chunk, counts: `size` packed 32-bit integers) to one array of `buckets` 64-bit counts.

    A task gives a row a chunk at most; a group adds them up one after another. The
    driver gets `buckets` numbers.
    """

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("counts"):
                got += np.frombuffer(x.as_buffer(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([got.tobytes()], pa.binary())], names=["chunk", "counts"])

    got = chunks.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").toArrow()
    out = np.zeros(buckets, np.int64)
    for at, x in zip(got["chunk"].to_pylist(), got["counts"].to_pylist(), strict=True):
        out[at * size : (at + 1) * size] = np.frombuffer(x, np.int64)
    return out


def packed_counts(counts: np.ndarray, size: int) -> tuple[list[int], list[bytes]]:
    """The chunks of `size` counts that are not all 0, as total_counts() takes them."""
    parts = counts.reshape(-1, size)
    at = np.flatnonzero(parts.any(1)).tolist()
    return at, [parts[i].astype(np.int32).tobytes() for i in at]
