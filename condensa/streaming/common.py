"""Helpers shared by the streaming jobs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from ..session import ensure_checkpoint_dir


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's checkpoint folder (``spark.checkpoint.dir``)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 1):
    """Parquet file source: every file matching ``path`` becomes stream input.

    A path naming one file is turned into a one-file glob (the file source takes
    folders or globs).
    """
    if os.path.isfile(path):
        d, f = os.path.split(path)
        path = os.path.join(d, f"[{f[0]}]{f[1:]}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
