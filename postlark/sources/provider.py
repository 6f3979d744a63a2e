"""A mail provider as a folder: pages of envelopes as a data source, raw messages read in tasks.

Below the folder `pages` holds files of which each line is a page (a list of envelopes, or
an object with a list `envelopes`), and `messages` a file for each raw message, named by its
provider key, percent-encoded.
"""

from __future__ import annotations

import io
import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from postlark.sources.mail_files import _open

PAGE = "file string, page long, value string"
#: Rows whose raw messages are held at once.
_AT_ONCE = 32


def _system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    where = urlsplit(uri)
    return (arrow_fs.LocalFileSystem(), unquote(where.path)) if where.scheme in ("", "file") else arrow_fs.FileSystem.from_uri(uri)


@dataclass
class Part(InputPartition):
    """Files of pages that one task reads; the last of them up to a page, or whole."""

    files: list[str]


class Pages(DataSource):
    """spark.read.format("provider_pages").option("path", folder): a row for each page.

    Options: `limit`, the pages of a file that are read (all); `per_task`, the files that one
    task reads (8); `files`, a JSON list of the files that are opened (all).
    """

    @classmethod
    def name(cls) -> str:
        return "provider_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema: object) -> PagesReader:
        return PagesReader(self.options["path"], int(self.options.get("limit", 0)), int(self.options.get("per_task", 8)), json.loads(self.options.get("files", "null")))


class PagesReader(DataSourceReader):
    def __init__(self, uri: str, limit: int, per_task: int, only: list[str] | None):
        if limit < 0 or per_task < 1:
            raise ValueError("limit and per_task must be positive")
        self.uri, self.limit, self.per_task = uri, limit, per_task
        self.only = only

    def partitions(self) -> list[Part]:
        system, path = _system(self.uri)
        held = system.get_file_info(arrow_fs.FileSelector(f"{path.rstrip('/')}/pages"))
        files = sorted(x.base_name for x in held if x.type == arrow_fs.FileType.File and not x.base_name.startswith(("_", ".")))
        files = [f for f in files if self.only is None or f in self.only]
        return [Part(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple[str, int, str]]:
        for file in partition.files:
            with _open(self.uri, f"pages/{file}") as f:
                for i, line in enumerate(io.TextIOWrapper(f, "utf-8", "replace", newline="\n")):
                    if self.limit and i >= self.limit:
                        break
                    yield file, i, line.rstrip("\r\n")


def pages(spark: SparkSession, uri: str, *, limit: int | None = None, per_task: int = 8, files: Sequence[str] | None = None) -> DataFrame:
    """Pages of a provider's folder: file, page (from 0), value. An error if there is no folder of pages."""
    spark.dataSource.register(Pages)
    return spark.read.format("provider_pages").options(path=uri, limit=limit or 0, per_task=per_task, files=json.dumps(None if files is None else list(files))).load()


def fetch(wanted: DataFrame, uri: str, *, key_col: str = "provider_key", attempts: int = 3, delay_ms: float = 250.0) -> DataFrame:
    """provider_key, raw, attempts and error of each row; raw is null where all attempts failed.

    What fails is tried again in rounds, after all others of its batch, with a delay that
    doubles. Null keys fail without an attempt. The error names the kind of failure, no path.
    """
    tries = max(1, int(attempts))

    def rounds(keys: list[str | None]) -> tuple[list, list, list]:
        raw, error, n = [None] * len(keys), [None if k is not None else "the envelope has no key" for k in keys], [0] * len(keys)
        pending = [i for i, k in enumerate(keys) if k is not None]
        for attempt in range(1, tries + 1):
            if not pending:
                break
            if attempt > 1:
                time.sleep(max(0.0, delay_ms) * 2 ** (attempt - 2) / 1000)
            failed = []
            for i in pending:
                n[i] = attempt
                try:
                    with _open(uri, f"messages/{quote(keys[i], safe='')}") as f:
                        raw[i], error[i] = f.read().decode("utf-8", "replace"), None
                except (OSError, pa.ArrowException) as e:
                    error[i] = f"message read failed: {type(e).__name__}"
                    failed.append(i)
            pending = failed
        return raw, n, error

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _AT_ONCE):
                b = whole.slice(at, _AT_ONCE)
                raw, n, error = rounds(b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.string()), pa.array(n, pa.int32()), pa.array(error, pa.string())], names=["provider_key", "raw", "attempts", "error"])

    return wanted.select(F.col(key_col).cast("string").alias("provider_key")).mapInArrow(read, "provider_key string, raw string, attempts int, error string")


def write_raw(rows: DataFrame, uri: str) -> None:
    """Writes raw messages (provider_key, raw) to a provider's folder, a file each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _system(uri)
        system.create_dir(f"{path.rstrip('/')}/messages", recursive=True)
        for b in batches:
            for key, raw in zip(b.column(0), b.column(1), strict=True):  # one at a time is an object of Python
                with system.open_output_stream(f"{path.rstrip('/')}/messages/{quote(key.as_py(), safe='')}") as f:
                    f.write(raw.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows.select("provider_key", "raw").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
