"""Helpers shared by the operators of this subpackage.

* ``stage``: write a table below the cluster's shared checkpoint folder and read it
  back. It cuts lineage, is seen by every executor, and survives lost executors.
* ``join_small``: join a side that is small as a rule: broadcast only when its row count
  (checked) is within a fixed bound, salted shuffle join beyond it. Same rows either way.
  The planner is told so by a hint: it would go by the compressed bytes of the staged files.
* ``prefix_scan``: running sums over a range-sorted table without a single-task window.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from condensa.session import ensure_checkpoint_dir

#: Characters that separate words, as a regex class body (space, tab, LF, VT, FF, CR).
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"

#: A side of a join is broadcast only if it has no more rows than this.
MAX_BROADCAST_ROWS = 20_000
#: Ways a hot key of the large side is spread when the small side is not broadcast.
SALT = 16


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder (never a local one on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/condensa-llm/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return the table read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of an Arrow batch for the jobs that run inside; wide rows need smaller batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def null_key(col: Column) -> Column:
    """A non-null text key for a nullable text column: values keep apart from NULL."""
    return F.coalesce(F.concat(F.lit("v"), col.cast("string")), F.lit("n"))


def join_small(large: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """Join ``small`` (a staged table, unique on ``keys``) to ``large``.

    Up to MAX_BROADCAST_ROWS rows (counted first) the small side is broadcast. Beyond
    that both sides are hashed on (keys, salt): the rows of one hot key are dealt by
    ``spread`` over SALT tasks, for which the small side is repeated SALT times. The planner takes
    the repeated side for as small as its files, so a hint keeps it from broadcasting it.
    """
    if small.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        return large.join(F.broadcast(small), keys, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int"))
    return dealt.join(salted.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def prefix_scan(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Add inclusive running sums (``sums``: new column -> summed expression) in ``order``.

    Rows are range-partitioned by ``order`` (rows of equal keys stay together), each range
    is summed, the range totals (one row per range) are summed up, and a window per range
    adds its own rows. No task sees more than one range.
    """
    placed = stage(df.repartitionByRange(partitions(df.sparkSession), *order)
                   .withColumn("_range", F.spark_partition_id()), name)
    totals = placed.groupBy("_range").agg(*[F.sum(e).alias(f"_t_{c}") for c, e in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(F.broadcast(bases), "_range")
    out = out.withColumns({c: F.col(f"_b_{c}") + F.sum(e).over(inside) for c, e in sums.items()})
    return out.drop("_range", *[f"_b_{c}" for c in sums])
