"""Scans of the input tables (parquet, one folder per table name)."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table. Column pruning and filters reach the scan through Catalyst."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Names the state of all input files: their paths, lengths and times of change (no file is opened)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
             .load(sf_dir))
    state = F.xxhash64("path", F.col("modificationTime").cast("string"), "length")
    n, mark = files.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(state), F.lit(0))).first()
    return f"{n}-{mark & 0xFFFFFFFFFFFFFFFF:016x}"


def on_cluster(spark: SparkSession) -> bool:
    """Whether executors run in processes of their own."""
    return re.match(r"local(\[|$)", spark.sparkContext.master) is None


def spread(df: DataFrame, *keys: str, factor: int = 2) -> DataFrame:
    """Spread rows over the cluster before a heavy per-row stage.

    A small table stored as one file arrives as one partition; the heavy per-row stages
    (chunking, ranking, rendering) would then run on one core. On a local master rows are
    dealt evenly; on a cluster, where tables are many files, the scan's own split stands.
    """
    context = df.sparkSession.sparkContext
    if not context.master.startswith("local"):
        return df
    return df.repartition(max(context.defaultParallelism * factor, 1))
