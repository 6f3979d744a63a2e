"""Upkeep of an archive: vectors of chunks with their rebuilds, status, advice and repair."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import astuple, dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.functions.embed import DIM, hash_embed, hash_vector
from postlark.functions.text import redacted
from postlark.operators import archive, semantic, sync
from postlark.operators.search import STATS, VERSION, Index, entries
from postlark.operators.semantic import Identity
from postlark.streaming.ingest import Snapshots

VECTORS, IDENTITY = "vectors", "identity"
_KEPT = ["chunk_id", "content_hash", "account_id", "mailbox", "thread_id", "message_id", "vector"]
_IDENTITY = "provider string, model string, dimension int, revision string, query_prefix string, passage_prefix string, build string"


@dataclass(frozen=True)
class Embedder:
    """Who makes vectors: `documents` of a column of texts, `query` of one text."""

    identity: Identity
    documents: Callable[[Column], Column]
    query: Callable[[str], Sequence[float]]

    def passages(self, texts: Column) -> Column:
        """Vectors of texts with the identity's prefix before each."""
        prefix = self.identity.passage_prefix
        return self.documents(F.concat(F.lit(prefix), texts) if prefix else texts)

    def asked(self, text: str) -> Sequence[float]:
        """The vector of a query with the identity's prefix before it."""
        return self.query((self.identity.query_prefix or "") + text)


EMBEDDERS = {"hash": Embedder(Identity("mock", "hash-128", DIM), hash_embed, hash_vector)}


def register(name: str, by: Embedder) -> None:
    """Makes an embedder known by name; a name stays with who took it."""
    if not name.strip() or EMBEDDERS.get(name, by) != by:
        raise ValueError(f"an embedder needs a name of its own, not {name!r}")
    EMBEDDERS[name] = by


def embedder(name: str) -> Embedder:
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name}; there are {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name]


def held_identity(store: Snapshots, version: int | None = None) -> Identity | None:
    """Whose vectors a store has; None where nothing tells."""
    held = store.read(IDENTITY, version)
    row = None if held is None else held.first()
    return row and Identity(**row.asDict())


def must_rebuild(held: Identity | None, stored: bool, wanted: Identity, asked: bool = False) -> bool:
    """Whether vectors must go: if asked to, if they are by another embedder, or if there are some and nothing tells by which."""
    return asked or (stored if held is None else not held.same_embedder(wanted))


def to_index(chunked: DataFrame, vectors: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """Vectors whose chunk still has the content they were made of, and the chunks without one."""
    if vectors is None:
        return None, chunked
    kept = vectors.join(chunked.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi")
    return kept, archive.to_embed(chunked, vectors)


def index_semantic(into: Snapshots, store: Snapshots, by: Embedder, rebuild: bool = False, older: tuple[DataFrame, Identity] | None = None) -> DataFrame:
    """Publishes a vector for each chunk of the archive; one row: embedded, reused, rebuilt, archive_revision.

    Only chunks without a vector of their content are embedded, in the tasks; vectors of
    chunks that are gone leave. older: vectors kept as JSON (see import_vectors()) and
    whose they are; they are taken over into an empty store if the embedder is the same.
    Vectors and identity become visible together.
    """
    version, at = store.version(), into.version()
    chunked = into.read("chunks", at)
    if chunked is None:
        raise ValueError("nothing was synced yet")
    held, vectors = held_identity(store, version), store.read(VECTORS, version)
    rebuilt = must_rebuild(held, vectors is not None and not vectors.isEmpty(), by.identity, rebuild)
    if rebuilt:
        vectors = None
    elif held is None and older is not None and older[1].same_embedder(by.identity):
        vectors = semantic.import_vectors(older[0], chunked)
    kept, missing = to_index(chunked, vectors)
    made = missing.withColumn("vector", by.passages(F.col("text"))).select(*_KEPT)
    reused = 0 if kept is None else kept.count()
    base = made.limit(0) if kept is None else kept.select(*_KEPT)
    revision = archive.revision(chunked).first()[0]
    mine = into.spark.createDataFrame([astuple(replace(by.identity, revision=revision))], _IDENTITY)
    done = store.publish({VECTORS: semantic.upsert(base, made, by.identity.dimension), IDENTITY: mine}, version + 1)
    embedded = store.read(VECTORS, done).count() - reused
    return into.spark.createDataFrame([(embedded, reused, rebuilt, revision)], "embedded long, reused long, rebuilt boolean, archive_revision string")


def status(into: Snapshots, store: Snapshots, by: Embedder, index: Index | None = None) -> DataFrame:
    """One row on an archive, which is only read, also where there is none.

    The keyword index, the archive's own if none is given, is healthy if it is of these
    analyzers and its entries are of the same chunks and contents, else stale. Vectors
    that cannot be read make semantic_status corrupt.
    """
    names = "present boolean, messages long, chunks long, backlog long, vectors long, archive_revision string, keyword_status string, keyword_rows long, semantic_status string"
    at = into.version()
    chunked = into.read("chunks", at)
    if chunked is None:
        return into.spark.createDataFrame([(False, 0, 0, 0, 0, None, "missing", 0, "missing")], names)
    total, revision = chunked.count(), archive.revision(chunked).first()[0]
    if index is None and into.read(STATS, at) is not None:
        index = Index.of(into, at)
    rows = 0 if index is None else index.entries.count()
    current = index is not None and index.stats.where(F.col("version") != VERSION).isEmpty() and archive.revision(index.entries).first()[0] == revision
    try:
        version = store.version()
        vectors = store.read(VECTORS, version)
        nothing = into.spark.createDataFrame([], "chunk_id string, content_hash string")
        h = semantic.health(chunked, nothing if vectors is None else vectors, held_identity(store, version), by.identity, revision).first()
        found = (h.backlog, h.stored, h.status)
    except PySparkException:
        found = (total, 0, "corrupt")
    row = (True, into.read("messages", at).count(), total, *found[:2], revision, "healthy" if current else "missing" if index is None else "stale", rows, found[2])
    return into.spark.createDataFrame([row], names)


def doctor(into: Snapshots, store: Snapshots, by: Embedder, index: Index | None = None) -> DataFrame:
    """status() with advice on what to run."""
    ready = F.col("semantic_status") == "healthy"
    return status(into, store, by, index).withColumn("recommendation", F.when(ready, "vectors are complete").otherwise("sync, then index the vectors before semantic searches"))


def repair(into: Snapshots, store: Snapshots, by: Embedder, index_path: str | None = None, vectors: bool = False, keyword: bool = False) -> dict[str, DataFrame | Index]:
    """Makes anew what is asked for: all vectors, the archive's own keyword index, or one below index_path, a new folder."""
    if not vectors and not keyword and index_path is None:
        raise ValueError("nothing to repair: ask for vectors or the keyword index, or give a path for one")
    done: dict[str, DataFrame | Index] = {}
    if vectors:
        done["vectors"] = index_semantic(into, store, by, rebuild=True)
    if index_path is not None:
        at = into.version()
        Index.write(entries(into.read("chunks", at), into.read("messages", at)), index_path)
        done["keyword"] = Index.read(into.spark, index_path)
    if keyword:
        done["keyword"] = Index.of(into, sync.reindex(into))
    return done


def drop_vectors(store: Snapshots) -> int:
    """Publishes a version without vectors and identity, so that the next index makes all anew."""
    return store.publish({}, drop=(VECTORS, IDENTITY))


def diagnosis(error: BaseException) -> str:
    """An error as JSON that may be shown: kind and message, without addresses and secrets."""
    return json.dumps({"error": redacted(str(error)), "kind": type(error).__name__}, ensure_ascii=False)


def as_json(rows: DataFrame) -> DataFrame:
    """A JSON object a row, nulls included, for output."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def require_readable(found: DataFrame, unchanged: int = 0) -> None:
    """Raises if a look at mail files (rows with `error`) gave failures alone and no file was left as it was."""
    n = found.agg(F.count("error").alias("bad"), F.count("*").alias("all")).first()
    if n.bad and n.bad == n["all"] and not unchanged:
        raise ValueError(f"no message could be read; {n.bad} failures")
