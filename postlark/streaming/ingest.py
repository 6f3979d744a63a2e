"""Incremental ingestion: micro-batches of messages merged into snapshots."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

ROWS, BATCHES = "rows", "batches"
_BUCKET = "_bucket"
_AT_ONCE = 4
_ROWS_A_FILE = 1 << 13  # of staged tables, so that tasks that read them can be of one size
_KEYS = 1 << 19  # that leave a table of texts, which one job broadcasts


def _writer(df: DataFrame) -> DataFrameWriter:
    return df.write.option("compression", "zstd")


@dataclass(frozen=True)
class Change:
    """What becomes of a table kept in hash buckets of `keys`: rows with the keys of `gone`, or of `rows`, leave and `rows` come.

    With `as_read`, for tables of texts, each task writes the buckets of the rows it has, so
    texts are not shuffled and a bucket has a file for each task and job at most: of buckets
    together with up to _KEYS keys that leave, one job broadcasts these. The keys of a
    bucket with more are joined as Spark sees fit, so a larger archive needs more buckets.
    """

    keys: tuple[str, ...]
    rows: DataFrame | None = None
    gone: DataFrame | None = None
    as_read: bool = False


@dataclass(frozen=True)
class Segment:
    """Rows that come to a table of immutable segments, in folders of the columns `by`, in place of the segments `merged`.

    A segment has the number of the version it came with, a merged one the highest of
    those it replaces, or `number` where that is given. `note` is kept with it. A segment
    that is written already has its folder in `path`.
    """

    rows: DataFrame | None
    by: tuple[str, ...]
    merged: tuple[str, ...] = ()
    note: int = 0
    number: int | None = None
    path: str | None = None


class Snapshots:
    """Versions of one or several tables below `root`, on any file system Spark writes to.

    A version is one file `v=<n>.json` that names the folders of each table: one for a
    table written whole, one for each bucket of a table that changes by key, one for each
    segment of a table that only grows. The file comes into being by a rename that fails
    if it is there, so of two writers of a version one fails; folders that a version does
    not change are shared with the one before. A table `batches` tells which batches of
    which streams a version has, so it is published with their rows.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._never_over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self._lease: tuple[str, float] | None = None
        self._staging: list[str] = []

    # Small files of the driver.

    def _names(self, folder: str = "") -> list[str]:
        top = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, value: dict, over: bool = False) -> None:
        stream = self._fs.create(self._path(f"{self.root}/{name}"), over)
        stream.write(bytearray(json.dumps(value), "utf-8"))
        stream.close()

    def _put(self, name: str, value: dict) -> bool:
        """Makes a small file with its content at once; False if it is there."""
        new = f"_new-{uuid.uuid4().hex}"
        self._write(new, value)
        try:
            return self._moved(new, name)
        finally:
            self._fs.delete(self._path(f"{self.root}/{new}"), True)

    def _moved(self, name: str, to: str) -> bool:
        """Renames a file; False if the target is there or the source is gone. Any other failure raises."""
        try:
            self._files.rename(self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{to}"), self._never_over)
        except Py4JJavaError as e:
            if any(x in e.java_exception.getClass().getName() for x in ("FileAlreadyExists", "FileNotFound")):
                return False
            raise
        return True

    # Writers.

    @contextmanager
    def lease(self, seconds: float = 900.0) -> Iterator[Snapshots]:
        """Holds the right to write; each publish prolongs it, and raises if it was lost.

        A lease that has ended, as its writer died, is taken over. Clocks of writers
        should agree to well below `seconds`.
        """
        owner = uuid.uuid4().hex
        mine = {"owner": owner, "until": time.time() + seconds}
        if not self._put("_lease", mine):
            held = self._load("_lease")
            if held["until"] > time.time():
                raise RuntimeError(f"another writer holds the archive until {held['until']:.0f}")
            ended = f"_ended-{uuid.uuid4().hex}"
            if self._moved("_lease", ended) and self._load(ended)["owner"] != held["owner"]:
                self._moved(ended, "_lease")  # a third writer was faster
            self._fs.delete(self._path(f"{self.root}/{ended}"), True)
            if not self._put("_lease", mine):
                raise RuntimeError("another writer took the archive over")
        self._lease = owner, seconds
        try:
            yield self
        finally:
            self._lease = None
            if "_lease" in self._names() and self._load("_lease")["owner"] == owner:
                self._fs.delete(self._path(f"{self.root}/_lease"), True)

    def _prolong(self) -> None:
        if self._lease:
            owner, seconds = self._lease
            if "_lease" not in self._names() or self._load("_lease")["owner"] != owner:
                raise RuntimeError("the lease has ended and another writer took over")
            self._write("_lease", {"owner": owner, "until": time.time() + seconds}, over=True)

    # Versions and tables.

    def version(self) -> int:
        return max((int(n[2:-5]) for n in self._names() if n.startswith("v=") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What each table of a version consists of."""
        v = self.version() if version is None else version
        return self._load(f"v={v}.json") if v else {}

    def bucket(self, keys: Sequence[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    def _of(self, name: str, table: dict, parts: list[dict]) -> DataFrame:
        schema = StructType.fromJson(json.loads(table["schema"]))
        if not parts:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        if "segment" in parts[0]:
            reader = reader.option("basePath", f"{self.root}/data/{name}")
        return reader.parquet(*(f"{self.root}/{p['path']}" for p in parts))

    def read(self, table: str = ROWS, version: int | None = None, near: DataFrame | None = None) -> DataFrame | None:
        """A table of a version (the newest), or None where it is not there.

        With `near`, of a table in buckets only the buckets of its keys are read.
        """
        held = self.manifest(version).get(table)
        if held is None:
            return None
        parts = held["parts"]
        if near is not None and "keys" in held:
            hit = self._hit(held["keys"], held["buckets"], near)
            parts = [p for p in parts if p["bucket"] in hit]
        return self._of(table, held, parts)

    def _hit(self, keys: Sequence[str], n: int, *rows: DataFrame | None) -> set[int]:
        """The buckets of rows' keys, n at most."""
        return {r[0] for df in rows if df is not None for r in df.select(self.bucket(keys, n)).distinct().collect()}

    def staged(self, df: DataFrame) -> DataFrame:
        """Writes df below the root and reads it back, so that what is made of it several times is computed once; the next publish deletes it. Prolongs the lease."""
        path = f"{self.root}/staging/{uuid.uuid4().hex}"
        _writer(df).option("maxRecordsPerFile", _ROWS_A_FILE).parquet(path)
        self._staging.append(path)
        self._prolong()
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_at = path
        return out

    def unstaged(self, df: DataFrame) -> None:
        """Deletes the files of a frame that staged() gave and nothing reads any more, before the next publish does."""
        path = getattr(df, "staged_at", None)
        if path in self._staging:
            self._fs.delete(self._path(path), True)
            self._staging.remove(path)

    def _whole(self, name: str, df: DataFrame) -> dict:
        path = f"data/{name}/{uuid.uuid4().hex}"
        _writer(df).parquet(f"{self.root}/{path}")
        return {"schema": df.schema.json(), "parts": [{"path": path}]}

    def _changed(self, name: str, held: dict | None, c: Change) -> dict | None:
        """The table after a change; only buckets of its keys are read and written."""
        if held is None or "keys" not in held:
            if c.rows is None:
                return held
            old, parts, keys, n = None if held is None else self._of(name, held, held["parts"]), [], list(c.keys), self.buckets
            hit = set()
        else:
            keys, n = held["keys"], held["buckets"]
            if c.as_read:
                return self._relaid(name, held, c)
            hit = self._hit(keys, n, c.rows, c.gone)
            if not hit:
                return held
            old, parts = self._of(name, held, [p for p in held["parts"] if p["bucket"] in hit]), [p for p in held["parts"] if p["bucket"] not in hit]
        out = c.rows
        if old is not None:
            for gone in (c.rows, c.gone):
                old = old if gone is None else old.join(gone.select(*c.keys).distinct(), list(c.keys), "left_anti").select(*old.columns)
            out = old if out is None else old.unionByName(out, allowMissingColumns=True)
        path = f"data/{name}/{uuid.uuid4().hex}"
        dealt = out.withColumn(_BUCKET, self.bucket(keys, n))
        _writer(dealt if c.as_read else dealt.hint("rebalance", _BUCKET)).partitionBy(_BUCKET).parquet(f"{self.root}/{path}")
        made = [{"path": f"{path}/{x}", "bucket": int(x.split("=")[1])} for x in self._names(path) if x.startswith(_BUCKET)]
        return {"schema": out.schema.json(), "keys": keys, "buckets": n, "parts": parts + made}

    def _relaid(self, name: str, held: dict, c: Change) -> dict:
        """The table of texts after a change; a job for each few buckets keeps their rows without a shuffle and writes what comes to them."""
        keys, n = held["keys"], held["buckets"]
        leave = [x.select(*keys) for x in (c.rows, c.gone) if x is not None]
        if not leave:
            return held
        ids = reduce(DataFrame.unionByName, leave).withColumn(_BUCKET, self.bucket(keys, n))
        counts = dict(map(tuple, ids.groupBy(_BUCKET).count().collect()))  # a row a bucket
        if not counts:
            return held
        groups: list[list[int]] = []
        room = 0
        for b, many in sorted(counts.items()):
            if not groups or many > room:
                groups.append([])
                room = _KEYS
            groups[-1].append(b)
            room -= many
        path = f"data/{name}/{uuid.uuid4().hex}"

        def put(df: DataFrame) -> DataFrame:
            _writer(df.withColumn(_BUCKET, self.bucket(keys, n))).mode("append").partitionBy(_BUCKET).parquet(f"{self.root}/{path}")
            return df

        come = self._of(name, held, []) if c.rows is None else self._of(name, held, []).unionByName(c.rows, allowMissingColumns=True)
        if len(groups) > 1:  # keys by bucket, so that a group reads its own; rows that come are read once
            place = f"{self.root}/staging/{uuid.uuid4().hex}"
            _writer(ids).partitionBy(_BUCKET).parquet(place)
            self._staging.append(place)
            ids = self.spark.read.schema(ids.schema).parquet(place)
            put(come)
            come = come.limit(0)
        for some in groups:
            parts = [p for p in held["parts"] if p["bucket"] in some]
            old = self._of(name, held, parts)
            if parts:
                mine = ids.where(F.col(_BUCKET).isin(some)).select(*keys).distinct()
                old = old.join(F.broadcast(mine) if sum(counts[b] for b in some) <= _KEYS else mine, keys, "left_anti").select(*old.columns)  # _KEYS rows at most
            out = put(old.unionByName(come, allowMissingColumns=True))
        made = [{"path": f"{path}/{x}", "bucket": int(x.split("=")[1])} for x in self._names(path) if x.startswith(_BUCKET)]
        return {"schema": out.schema.json(), "keys": keys, "buckets": n, "parts": [p for p in held["parts"] if p["bucket"] not in counts] + made}

    def _number(self, name: str, held: dict | None, s: Segment, v: int) -> tuple[int, list[dict]]:
        """A segment's number, and the parts it replaces."""
        gone = [p for p in ([] if held is None else held["parts"]) if p["path"].rsplit("=", 1)[1] in s.merged]
        return s.number or max((p["segment"] for p in gone), default=v), gone

    def laid(self, name: str, by: str, rows: Mapping[str, DataFrame], s: Segment) -> Segment:
        """A segment of the next version whose rows are written at once, of each value of the column `by` as they come, and read back."""
        last = self.version()
        number = self._number(name, self.manifest(last).get(name), s, last + 1)[0]
        path = f"data/{name}/seg={number}-{uuid.uuid4().hex}"
        for value, df in rows.items():
            _writer(df).parquet(f"{self.root}/{path}/{by}={value}")
        self._prolong()
        schema = StructType([*next(iter(rows.values())).schema, *StructType.fromDDL(f"{by} string")])
        return replace(s, rows=self.spark.read.schema(schema).parquet(f"{self.root}/{path}"), path=path, number=number)

    def _grown(self, name: str, held: dict | None, s: Segment, v: int) -> dict:
        number, gone = self._number(name, held, s, v)
        path = s.path or f"data/{name}/seg={number}-{uuid.uuid4().hex}"
        if not s.path:
            _writer(s.rows).partitionBy(*s.by).parquet(f"{self.root}/{path}")
        made = [{"path": path, "segment": number, "note": s.note}] if any("=" in x for x in self._names(path)) else []
        schema = StructType([*(f for f in s.rows.schema if f.name not in s.by), *StructType.fromDDL("seg string"), *(s.rows.schema[c] for c in s.by)])
        return {"schema": schema.json(), "parts": [p for p in ([] if held is None else held["parts"]) if p not in gone] + made}

    def publish(self, tables: DataFrame | Mapping[str, DataFrame | Change | Segment], version: int | None = None, drop: Sequence[str] = ()) -> int:
        """Writes the next version (or `version`, which must not exist) and makes it visible.

        Tables that are neither given nor dropped stay as they are. What a writer that
        fails has written is no part of any version, until sweep() deletes it.
        """
        given = {ROWS: tables} if isinstance(tables, DataFrame) else dict(tables)
        last = self.version()
        v = version or last + 1
        taken = RuntimeError(f"version {v} was published by another writer")
        if v <= last:
            raise taken
        self._prolong()
        held = {k: t for k, t in self.manifest(last).items() if k not in drop}

        def made(name: str) -> dict | None:
            what = given[name]
            if isinstance(what, DataFrame):
                return self._whole(name, what)
            return self._grown(name, held.get(name), what, v) if isinstance(what, Segment) else self._changed(name, held.get(name), what)

        with ThreadPoolExecutor(_AT_ONCE) as pool:  # jobs of several tables
            new = dict(zip(given, pool.map(made, given), strict=True))
        held |= {k: t for k, t in new.items() if t is not None}
        self._prolong()
        self._fs.mkdirs(self._path(self.root))
        if not self._put(f"v={v}.json", held):
            raise taken
        for path in self._staging:
            self._fs.delete(self._path(path), True)
        self._staging.clear()
        return v

    def sweep(self, keep: int = 2, older: float = 86_400.0) -> int:
        """Deletes versions but the last `keep`, and files of no kept version that are `older` seconds old; how many folders went.

        `older` must exceed the time that a writer takes, as its files are in no version yet.
        """
        versions = sorted(int(n[2:-5]) for n in self._names() if n.startswith("v="))
        kept = versions[-keep:] if keep else []
        used = {p["path"] for v in kept for t in self.manifest(v).values() for p in t["parts"]}
        for v in versions[: len(versions) - len(kept)]:
            self._fs.delete(self._path(f"{self.root}/v={v}.json"), True)
        before, gone = (time.time() - older) * 1000, 0
        folders = [f"data/{t}/{x}" for t in self._names("data") for x in self._names(f"data/{t}")] + [f"staging/{x}" for x in self._names("staging")]
        for f in folders:
            inner = [f"{f}/{x}" for x in self._names(f) if x.startswith(_BUCKET)]
            for x in [f] if f in used else inner if any(i in used for i in inner) else [f]:
                path = self._path(f"{self.root}/{x}")
                if x not in used and self._fs.getFileStatus(path).getModificationTime() <= before:
                    self._fs.delete(path, True)
                    gone += 1
        return gone

    def rebucket(self, table: str, n: int) -> int:
        """Publishes a table in n buckets, as it has grown; the one job that rewrites it whole."""
        held = self.manifest()[table]
        kept, self.buckets = self.buckets, n
        try:
            return self.publish({table: Change(tuple(held["keys"]), self.read(table))}, drop=(table,))
        finally:
            self.buckets = kept

    def migrate(self, schemas: Mapping[str, str]) -> int:
        """Publishes tables of an older layout with the columns that their schema (DDL) adds, null, and in its types.

        Columns that a schema does not name stay; a value that does not fit a new type
        fails the job. Does nothing if all tables have their columns.
        """
        v, changed, every = self.version(), {}, self.manifest()
        for name, ddl in schemas.items():
            df = self.read(name, v)
            if df is None:
                continue
            held = {f.name: f.dataType for f in df.schema}
            wanted = {f.name: f.dataType for f in StructType.fromDDL(ddl)}
            if any(held.get(c) != t for c, t in wanted.items()):
                new = df.select(*(F.col(c).cast(wanted.get(c, t)).alias(c) for c, t in held.items()), *(F.lit(None).cast(t).alias(c) for c, t in wanted.items() if c not in held))
                changed[name] = Change(tuple(every[name]["keys"]), new) if "keys" in every[name] else new
        return self.publish(changed, v + 1, drop=tuple(changed)) if changed else v

    def upsert(self, new: DataFrame, keys: Sequence[str], batch: int | None = None, stream: str = "", order: Sequence[str] = ()) -> int:
        """Merges `new`; a batch of a stream that a version has already does nothing.

        Of several rows with one key the last by `order` stays, then by all columns. Only
        buckets with a key of `new` are rewritten.
        """
        v = self.version()
        done = self.read(BATCHES, v) if batch is not None else None
        if done is not None and not done.where((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty():
            return v
        rest = [c for c in new.columns if c not in keys and c not in order]
        best = new.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_best"))
        last = best.select(*keys, "_best.*").select(*new.columns)
        tables: dict[str, DataFrame | Change] = {ROWS: Change(tuple(keys), last)}
        if batch is not None:
            mine = self.spark.createDataFrame([(stream, batch)], "stream string, batch long")
            tables[BATCHES] = mine if done is None else done.where(F.col("stream") != stream).unionByName(mine)
        return self.publish(tables, v + 1)


def stream(source: DataFrame, into: Snapshots, keys: Sequence[str], checkpoint: str, order: Sequence[str] = ()) -> StreamingQuery:
    """Starts merging a stream of rows into snapshots, exactly once for each batch of its checkpoint."""
    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: into.upsert(df, keys, i, checkpoint, order) and None).trigger(availableNow=True).start()
