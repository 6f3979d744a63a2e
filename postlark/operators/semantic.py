"""Vectors beside the archive: upserts, embedder identity, import of older vectors, health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.operators import archive


@dataclass(frozen=True)
class Identity:
    """Which embedder made the vectors, of which archive revision, what stands before queries and passages, and by which build."""

    provider: str
    model: str
    dimension: int
    revision: str | None = None
    query_prefix: str | None = None
    passage_prefix: str | None = None
    build: str | None = None

    def space(self) -> tuple[str, str, int, str, str]:
        """What vectors must share to be compared; neither revision nor build; no prefix is an empty one."""
        return self.provider, self.model, self.dimension, self.query_prefix or "", self.passage_prefix or ""

    def same_embedder(self, other: Identity) -> bool:
        return self.space() == other.space()

    def label(self) -> str:
        return f"{self.provider}:{self.model}:{self.dimension}"

    def require(self, other: Identity) -> None:
        """Queries by another embedder would compare unlike vectors."""
        if not self.same_embedder(other):
            raise ValueError(f"vectors are by {self.label()}; rebuild them for {other.label()}" + ("" if self.label() != other.label() else ", whose prefixes differ"))


def upsert(vectors: DataFrame, new: DataFrame, dimension: int) -> DataFrame:
    """The snapshot after an upsert by chunk_id; a vector of another length fails the job."""
    fits = F.size("vector") == dimension
    checked = new.withColumn("vector", F.when(fits, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("wrong dimension: "), F.col("chunk_id"))).cast(new.schema["vector"].dataType)))
    return archive.merge(vectors, checked, ["chunk_id"])


def delete(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """The snapshot without the vectors of some chunks (chunk_id)."""
    return archive.remove(vectors, gone, ["chunk_id"])


def import_vectors(older: DataFrame, chunked: DataFrame) -> DataFrame:
    """Vectors kept as JSON whose chunk still has the content they were made of.

    older: chunk_id, content_hash, vector. JSON that is no array of numbers drops out.
    """
    parsed = older.select("chunk_id", "content_hash", F.from_json("vector", "array<double>").alias("vector")).where((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull()))
    return parsed.join(chunked.select("chunk_id", "content_hash", "account_id", "mailbox", "thread_id", "message_id"), ["chunk_id", "content_hash"])


def health(chunked: DataFrame, vectors: DataFrame, held: Identity | None, wanted: Identity, revision: str | None = None) -> DataFrame:
    """One row: status, stored (vectors), complete and backlog (chunks with and without one).

    held is the identity beside the vectors, wanted the embedder in use, revision
    the archive's now.
    """
    stored = vectors.agg(F.count("*").alias("stored"))
    chunk = chunked.select("chunk_id", "content_hash").join(vectors.select("chunk_id", "content_hash").withColumn("has", F.lit(True)), ["chunk_id", "content_hash"], "left")
    queue = chunk.agg(F.count("has").alias("complete"), (F.count("*") - F.count("has")).alias("backlog"))
    if held is None:
        waiting = F.when(F.col("complete") > 0, "interrupted").otherwise("never-completed")
        status = F.when(F.col("stored") > 0, "rebuild-required").when(F.col("backlog") > 0, waiting).otherwise("missing")
    elif not held.same_embedder(wanted):
        status = F.lit("rebuild-required")
    else:
        stale = held.revision is not None and revision is not None and held.revision != revision
        status = F.when(F.col("backlog") > 0, "interrupted").when(F.col("stored") != F.col("complete"), "corrupt").otherwise("stale" if stale else "healthy")
    return stored.join(queue).select(status.alias("status"), "stored", "complete", "backlog")  # one row each
