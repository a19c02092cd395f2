"""Event log (S5): batches appended exactly once, kept by day, merged in levels; reports scan it.

Layout below the log's folder:

``data/folder=<id>/day=<date>/``
    the events of one batch, or of several merged ones
``ledger/``
    one row per folder that counts: its batch, level, rows, the milliseconds its batch took, the folders it replaces

A folder counts only once the ledger names it. A ledger row is one file that the committer moves into
place, so a batch is seen whole or not at all: what a lost driver or a failed attempt leaves
is never read, and a batch that the ledger has is not written again. One job writes to a log at a time
(``foreachBatch`` and the queries do); any number may read.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = ("ts timestamp, tool string, result_id string, strategy string, before bigint, after bigint, "
                "reduction string, content_type string, action string, errors int, tool_input string")
EVENT_NAMES = [part.split()[0] for part in EVENT_SCHEMA.split(", ")]
LEDGER_SCHEMA = ("folder string, batch string, level int, rows bigint, duration_ms bigint, replaces array<string>")

# Folders of one level that are merged into one of the next: at most FAN_IN - 1 a level stay, so a log of
# n batches is read from about FAN_IN * log(n) / log(FAN_IN) folders.
FAN_IN = 16


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """All ledger rows; none for a log that nobody has written to."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(f"{root}/ledger")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def live(spark: SparkSession, root: str) -> DataFrame:
    """The ledger rows of the folders that count now: those that no merged folder replaces."""
    rows = ledger(spark, root)
    gone = rows.select(F.explode("replaces").alias("folder"))
    return rows.join(gone, "folder", "left_anti").filter("rows > 0")


def _record(spark: SparkSession, root: str, *row) -> None:
    spark.createDataFrame([row], LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/ledger")


def _write(events: DataFrame, root: str) -> tuple[str, int]:
    folder = uuid.uuid4().hex
    path = f"{root}/data/folder={folder}"
    events.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    back = events.sparkSession.read.schema("ts timestamp").parquet(path)  # rows from the footers
    return folder, back.count()


def has(spark: SparkSession, root: str, batch: str) -> bool:
    """Whether the log has the batch, also if it has been merged since."""
    return not ledger(spark, root).filter(F.col("batch") == batch).isEmpty()


def append(events: DataFrame, root: str, batch: str, started: float | None = None) -> bool:
    """Append the events of a batch (columns of EVENT_SCHEMA, others are left out) unless the log has that batch.

    The milliseconds from ``started`` (now, if not given) to the end of the write are measured and count as
    the duration of each of its events: that long a caller waited for the batch. Returns whether it was written.
    """
    spark = events.sparkSession
    if has(spark, root, batch):
        return False
    started = time.time() if started is None else started
    folder, rows = _write(events.select(*EVENT_NAMES), root)
    _record(spark, root, folder, batch, 0, rows, int((time.time() - started) * 1000), [])
    return True


def _read_folders(spark: SparkSession, root: str, rows: list) -> DataFrame:
    """Events of some live folders, with ``day``; a batch's own folder takes its duration from the ledger."""
    schema = f"{EVENT_SCHEMA}, duration_ms bigint, folder string, day date"
    if not rows:
        return spark.createDataFrame([], schema).drop("folder")
    ev = (spark.read.schema(schema).option("basePath", f"{root}/data")
          .parquet(*[f"{root}/data/folder={r['folder']}" for r in rows]))
    took = spark.createDataFrame([(r["folder"], r["duration_ms"]) for r in rows], "folder string, _ms bigint")
    # One row per live folder, see FAN_IN.
    return (ev.join(F.broadcast(took), "folder")
            .withColumn("duration_ms", F.coalesce("duration_ms", "_ms")).drop("folder", "_ms"))


def read(spark: SparkSession, root: str) -> DataFrame:
    """All events once: EVENT_SCHEMA, ``duration_ms`` and ``day``. A filter on ``day`` prunes folders."""
    return _read_folders(spark, root, live(spark, root).select("folder", "duration_ms").collect())


def merge(spark: SparkSession, root: str, fan_in: int = FAN_IN) -> int:
    """Merge the folders of each level that has ``fan_in`` or more into one of the next; returns the number of merges.

    An event is thus rewritten once a level. Rows go to files by day and time, so a busy day spans several tasks.
    Replaced folders stay for readers that began before; ``replaced`` names them for removal.
    """
    merged = level = 0
    while True:
        rows = live(spark, root).select("folder", "level", "duration_ms").collect()
        if level > max((r["level"] for r in rows), default=-1):
            return merged
        old = [r for r in rows if r["level"] == level]
        if len(old) >= fan_in:
            ev = _read_folders(spark, root, old).select(*EVENT_NAMES, "duration_ms", "day")
            folder, n = _write(ev.repartitionByRange("day", "ts").drop("day"), root)
            _record(spark, root, folder, None, level + 1, n, None, [r["folder"] for r in old])
            merged += 1
        level += 1


def replaced(spark: SparkSession, root: str) -> DataFrame:
    """Folders that a merged one replaces; their owner may remove them once no reader needs them."""
    return ledger(spark, root).select(F.explode("replaces").alias("folder"))
