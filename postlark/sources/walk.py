"""Folders of mail files, listed in tasks a level at a time; what cannot be listed is a row."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Mapping
from urllib.parse import unquote, urlsplit

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyarrow import ArrowException
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlark.sources.mail_files import bundled

_ENTRY = "root_key string, uri string, rel_path string, kind string, size long, mtime_ms double"


def resolve_root(spark: SparkSession, root: str) -> str:
    """The URI of a folder or file that is there; else an error that does not name it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    try:
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(path).toUri().toString()
    except Py4JJavaError:
        raise ValueError("a root of mail files cannot be read") from None


def _local(path: str) -> Iterator[tuple]:
    """name, kind, size, mtime_ms of a local folder; links to files are followed, links to folders are left out."""
    if os.path.isfile(path):
        held = os.stat(path)
        yield "", "file", held.st_size, held.st_mtime * 1000
        return
    with os.scandir(path) as entries:
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                yield e.name, "folder", None, None
            elif e.is_file():
                held = e.stat()
                yield e.name, "file", held.st_size, held.st_mtime * 1000


def _remote(uri: str) -> Iterator[tuple]:
    system, path = arrow_fs.FileSystem.from_uri(uri)
    for e in system.get_file_info(arrow_fs.FileSelector(path)):
        kind = "folder" if e.type == arrow_fs.FileType.Directory else "file"
        yield e.base_name, kind, e.size, e.mtime and e.mtime.timestamp() * 1000


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for root, uri, rel in zip(b["root_key"], b["uri"], b["rel_path"], strict=True):
            where = urlsplit(uri)
            base = unquote(where.path)
            full = f"{base.rstrip('/')}/{rel}" if rel else base
            try:
                held = list(_local(full) if where.scheme in ("", "file") else _remote(where._replace(path=full).geturl()))
                for name, kind, size, mtime in held:
                    child = "/".join(x for x in (rel, name or base.rsplit("/", 1)[-1]) if x)
                    out.append((root, uri, child, kind, size, mtime))
            except (OSError, ArrowException):
                out.append((root, uri, rel, "unlisted", None, None))
        yield pd.DataFrame(out, columns=["root_key", "uri", "rel_path", "kind", "size", "mtime_ms"]).astype({"size": "Int64", "mtime_ms": "Float64"})


def walk(spark: SparkSession, roots: Mapping[str, str]) -> DataFrame:
    """root_key, rel_path, kind (file or unlisted), size, mtime_ms below roots (root_key to URI).

    Files are mail files by their names. Each level of folders is one job over the folders
    found before, kept in spark.checkpoint.dir, so the driver sees neither files nor folders.
    """
    kept = spark.conf.get("spark.checkpoint.dir", None)
    if not kept:
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    base = f"{kept}/walk-{uuid.uuid4().hex}"
    level = spark.createDataFrame(list(roots.items()), "root_key string, uri string").withColumn("rel_path", F.lit(""))
    depth = 0
    while not level.isEmpty():
        dealt = level.repartition(spark.sparkContext.defaultParallelism)
        dealt.mapInPandas(_listed, _ENTRY).write.parquet(f"{base}/depth={depth}")
        level = spark.read.schema(_ENTRY).parquet(f"{base}/depth={depth}").where("kind = 'folder'").select("root_key", "uri", "rel_path")
        depth += 1
    found = spark.read.schema(_ENTRY).parquet(*(f"{base}/depth={i}" for i in range(depth))).where("kind != 'folder'") if depth else level.select("*", F.lit("").alias("kind"), F.lit(0).alias("size"), F.lit(0.0).alias("mtime_ms"))
    name = F.element_at(F.split(F.col("rel_path"), "/"), -1)
    mail = name.rlike(r"(?i)\.(eml|mbox|mbx)$") | ((name == "mbox") & bundled(F.concat(F.lit("/"), "rel_path")))
    return found.where((F.col("kind") == "unlisted") | mail).select("root_key", "rel_path", "kind", "size", "mtime_ms")
