"""Files of JSON lines as streams, split by what each line is; corrupt lines have an output of their own.

The sink is one Parquet table whose folders are the kinds of lines (the file sink's own log makes each line
count once), so the corrupt lines are the folder ``<kind>=raw`` or ``status=corrupt``. Lines are counted as
they pass by ``observe``; ``counters`` adds up what the query reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import exprs as E
from ..operators.protocol import classify_messages
from ..sources.toolcalls import parse_hook_lines

METRIC = "lines"


def line_stream(spark: SparkSession, path: str, folders: str = "", max_files: int = 100) -> DataFrame:
    """One row a line of the text files below ``path``: ``line`` and the columns that its folders name
    (``folders``: their schema, such as 'conn bigint')."""
    schema = "value string" + (f", {folders}" if folders else "")
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).text(path)
            .withColumnRenamed("value", "line"))


def _observed(lines: DataFrame, kind: str, corrupt: str) -> DataFrame:
    return lines.observe(METRIC, F.count(F.lit(1)).alias("lines"), F.count_if(F.col(kind) == "empty").alias("empty"),
                         F.count_if(F.col(kind) == corrupt).alias("corrupt"))


def messages(lines: DataFrame) -> DataFrame:
    """``classify_messages`` on trimmed lines; lines that are no JSON keep their white space, blank ones go."""
    m = classify_messages(lines.withColumn("_given", F.col("line")).withColumn("line", F.expr(E.js_trim("line"))))
    m = m.withColumn("kind", F.when(F.col("line") == "", "empty").otherwise(F.col("kind")))
    m = m.withColumn("line", F.when(F.col("kind") == "raw", F.col("_given")).otherwise(F.col("line"))).drop("_given")
    return _observed(m, "kind", "raw").filter("kind <> 'empty'")


def hook_events(lines: DataFrame) -> DataFrame:
    """``parse_hook_lines``; blank lines go, corrupt ones stay with their text and no fields."""
    return _observed(parse_hook_lines(lines), "status", "corrupt").filter("status <> 'empty'")


def write(rows: DataFrame, kind: str, out: str, checkpoint: str, trigger_once: bool = True) -> StreamingQuery:
    """Start the stream into the table at ``out`` with one folder for each value of ``kind``."""
    w = rows.writeStream.format("parquet").partitionBy(kind).option("path", out).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.outputMode("append").start()


def counters(query: StreamingQuery) -> dict[str, int]:
    """Lines, empty and corrupt lines of the micro-batches that the query still reports
    (``spark.sql.streaming.numRecentProgressUpdates``, 100 unless set)."""
    rows = [p.observedMetrics[METRIC] for p in query.recentProgress if METRIC in p.observedMetrics]
    return {name: sum(r[name] for r in rows) for name in ("lines", "empty", "corrupt")}
