"""Tool-call sources (S1) and image payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOOK_EVENT_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("transcript_path", T.StringType()),
    T.StructField("cwd", T.StringType()),
    T.StructField("hook_event_name", T.StringType()),
    T.StructField("tool_name", T.StringType()),
    T.StructField("tool_input", T.StringType()),
    T.StructField("tool_response", T.StringType()),
    T.StructField("tool_use_id", T.StringType()),
])


def parse_hook_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """S1 over a table of raw input lines: blank lines and unparsable JSON are skipped.

    ``tool_input`` and ``tool_response`` stay JSON text (open records). Adds ``status``
    ('ok' | 'empty' | 'corrupt'); callers keep the 'ok' rows and report the others.
    """
    raw = F.col(line_col)
    blank = F.trim(F.coalesce(raw, F.lit(""))) == ""
    parsed = F.from_json(raw, HOOK_EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    valid = F.expr(f"try_parse_json({line_col}) IS NOT NULL")
    return (lines.withColumn("_e", parsed)
            .withColumn("status", F.when(blank, "empty").when(~valid, "corrupt").otherwise("ok"))
            .select("*", *[F.col(f"_e.{f.name}").alias(f.name) for f in HOOK_EVENT_SCHEMA.fields]).drop("_e"))


def read_hook_events(spark: SparkSession, path: str) -> DataFrame:
    """S1 from files of JSON lines: the columns of ``parse_hook_lines``; blank and corrupt lines keep their status."""
    return parse_hook_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as blocks keyed by path (base64 payload without line breaks); the type follows the extension."""
    b = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = (F.when(ext.isin("jpg", "jpeg"), F.lit("image/jpeg")).when(ext == "svg", F.lit("image/svg+xml"))
            .when(ext.isin("gif", "webp", "bmp", "tiff"), F.concat(F.lit("image/"), ext)).otherwise(F.lit("image/png")))
    return b.select(F.col("path"), F.lit("image").alias("type"), F.translate(F.base64("content"), "\r\n", "").alias("data"), mime.alias("mime_type"))
