"""Makes this package importable on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_NAME = "postlark.zip"


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once for each application."""
    sc = spark.sparkContext
    if not any(str(f).endswith(_NAME) for f in sc._python_includes):
        here = os.path.dirname(os.path.abspath(__file__))
        with tempfile.TemporaryDirectory() as tmp:
            shutil.copytree(here, f"{tmp}/zip/postlark", ignore=shutil.ignore_patterns("__pycache__"))
            held = tempfile.mkdtemp(prefix="postlark-py-")  # Spark's file server reads it as executors come
            sc.addPyFile(shutil.make_archive(f"{held}/{_NAME[:-4]}", "zip", f"{tmp}/zip"))
    return spark
