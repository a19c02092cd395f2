"""Streaming queries (M1-M3), run to completion with an available-now trigger.

Each returns the batch result read back from the sink."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..config import FIXTURE_CONFIG
from ..operators import event_log as EL
from ..sources import fixtures as FX
from ..sources.protocol_fixture import _LINE_SPARK, DUCK_LINES, protocol_lines
from ..sources.tables import table
from ..streaming import correlate as CO
from ..streaming import history as HI
from ..streaming import lines as LI
from ..streaming.common import file_stream, run_dir
from ..streaming.continuous import FILES_A_BATCH, reduce_stream
from .q_blocks import _HOOK_LINES_DUCK, _HOOK_LINES_SPARK
from .q_results import REDUCED
from .registry import query


def _events_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return file_stream(spark, os.path.join(sf_dir, "events.parquet"), schema)


def _lines_stream(spark, sf_dir):
    e = _events_stream(spark, sf_dir)
    return e.select(F.col("event_id").alias("seq"), (F.floor(F.col("event_id") / 2) % 5).cast("bigint").alias("conn"),
                    F.col("ts").cast("timestamp").alias("ts"), F.expr(_LINE_SPARK).alias("line"))


@query("stream_correlate", oracle=f"""
WITH l AS (SELECT *, json_valid(line) AS ok FROM {DUCK_LINES} x),
p AS (SELECT seq, conn,
        CASE WHEN ok THEN json_extract_string(line, '$.id') END AS rpc_id,
        CASE WHEN NOT ok THEN 'raw'
             WHEN json_extract_string(line, '$.method') = 'tools/call' AND json_extract_string(line, '$.params.name') IS NOT NULL AND json_extract_string(line, '$.id') IS NOT NULL THEN 'request'
             WHEN json_extract_string(line, '$.id') IS NOT NULL AND (json_extract(line, '$.result') IS NOT NULL OR json_extract(line, '$.error') IS NOT NULL) THEN 'response'
             ELSE 'other' END AS kind,
        CASE WHEN ok THEN json_extract_string(line, '$.params.name') END AS tool_name FROM l),
g AS (SELECT *, lag(seq) OVER w AS prev_seq, lag(kind) OVER w AS prev_kind, lag(tool_name) OVER w AS prev_tool
      FROM p WHERE kind IN ('request', 'response') WINDOW w AS (PARTITION BY conn, rpc_id ORDER BY seq))
SELECT conn, rpc_id, kind, CASE WHEN prev_kind = 'request' THEN prev_seq END AS request_seq, seq AS response_seq,
       CASE WHEN prev_kind = 'request' THEN prev_tool END AS tool_name FROM g WHERE kind = 'response'
UNION ALL SELECT conn, NULL, kind, NULL, seq, NULL FROM p WHERE kind NOT IN ('request', 'response')""")
def stream_correlate(spark, sf_dir):
    """M1: responses with their requests by keyed state; other lines pass through."""
    out = run_dir(spark, "correlate")
    q = (CO.correlate(_lines_stream(spark, sf_dir)).writeStream.format("parquet")
         .option("path", os.path.join(out, "data")).option("checkpointLocation", os.path.join(out, "ckpt"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return CO.settled(spark.read.parquet(os.path.join(out, "data"))).select("conn", "rpc_id", "kind", "request_seq",
                                                                "response_seq", "tool_name")


@query("stream_history", oracle="""
SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, event_type AS tool_name,
       array_to_string(list(event_type) OVER w, ',') AS recent, array_to_string(list(props) OVER w, '|') AS recent_args
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def stream_history(spark, sf_dir):
    """M2: per-session history state (last 10 calls) feeding each call's recent tools."""
    out = run_dir(spark, "history")
    calls = (_events_stream(spark, sf_dir)
             .select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"),
                     F.col("event_type").alias("tool_name"), F.col("props").cast("string").alias("args")))
    q = (HI.call_history(calls).writeStream.format("parquet").option("path", os.path.join(out, "data"))
         .option("checkpointLocation", os.path.join(out, "ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return HI.settled(spark.read.parquet(os.path.join(out, "data"))).withColumn("recent_args", F.array_join("recent_args", "|"))


@query("stream_reduce", oracle=f"""
WITH {REDUCED}
SELECT result_id, tool, CASE WHEN action = 'compressed' THEN rule_strategy ELSE 'skip' END AS strategy, total_before AS before,
       CASE WHEN action = 'compressed' THEN total_after ELSE total_before END AS after, action FROM results WHERE starts_with(result_id, 'doc:')""")
def stream_reduce(spark, sf_dir):
    """M3: continuous reduction of a stream of document results into the event log."""
    out = run_dir(spark, "reduce")
    d = table(spark, sf_dir, "documents")
    docs = file_stream(spark, os.path.join(sf_dir, "documents.parquet"), d.schema, FILES_A_BATCH)
    blocks = docs.select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("result_id"),
        F.lit("documents").alias("source"), F.lit(0).alias("pos"),
        F.lit("mcp__corpus__read_document").alias("tool_name"), FX.document_args(docs).alias("args"),
        F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("data"),
        F.lit(None).cast("string").alias("mime_type"))
    q = reduce_stream(blocks, FIXTURE_CONFIG, os.path.join(out, "log"), os.path.join(out, "ckpt"))
    q.awaitTermination()
    return EL.read(spark, os.path.join(out, "log")).select("result_id", "tool", "strategy", "before", "after",
                                                               "action")


@query("stream_protocol", oracle=f"""
WITH l AS (SELECT *, json_valid(line) AS ok FROM {DUCK_LINES} x),
p AS (SELECT conn, line, ok, CASE WHEN ok THEN json_extract_string(line, '$.id') END AS rpc_id,
        CASE WHEN ok THEN json_extract_string(line, '$.method') END AS method,
        CASE WHEN ok THEN json_extract_string(line, '$.params.name') END AS tool_name,
        CASE WHEN ok THEN json_extract(line, '$.result') IS NOT NULL OR json_extract(line, '$.error') IS NOT NULL END AS answer FROM l)
SELECT conn, line, rpc_id, tool_name,
  CASE WHEN NOT ok THEN 'raw' WHEN method = 'tools/call' AND rpc_id IS NOT NULL AND tool_name IS NOT NULL THEN 'request'
       WHEN rpc_id IS NOT NULL AND answer THEN 'response' ELSE 'other' END AS kind
FROM p""")
def stream_protocol(spark, sf_dir):
    """S4 from files of lines, one folder a connection, read as a stream and split by kind."""
    out = run_dir(spark, "protocol")
    lines = protocol_lines(spark, sf_dir)
    blank = F.when(F.col("seq") % 97 == 0, F.lit("\n  ")).otherwise(F.lit(""))  # a blank line after some
    lines.select("conn", F.concat("line", blank).alias("value")).write.partitionBy("conn").text(os.path.join(out, "in"))
    m = LI.messages(LI.line_stream(spark, os.path.join(out, "in"), "conn bigint"))
    LI.write(m.select("conn", "line", "rpc_id", "tool_name", "kind"), "kind", os.path.join(out, "data"),
             os.path.join(out, "ckpt")).awaitTermination()
    return spark.read.parquet(os.path.join(out, "data"))


@query("stream_hook_events", oracle=f"""
WITH l AS (SELECT {_HOOK_LINES_DUCK} AS line FROM events WHERE trim({_HOOK_LINES_DUCK}) <> ''),
p AS (SELECT line, json_valid(line) AS ok FROM l)
SELECT CASE WHEN ok THEN 'ok' ELSE 'corrupt' END AS status, line,
       CASE WHEN ok THEN json_extract_string(line, '$.tool_name') END AS tool_name FROM p""")
def stream_hook_events(spark, sf_dir):
    """S1 from files of lines read as a stream: tool calls, and the corrupt lines with their text."""
    out = run_dir(spark, "hooks")
    table(spark, sf_dir, "events").select(F.expr(_HOOK_LINES_SPARK).alias("value")).write.text(os.path.join(out, "in"))
    ev = LI.hook_events(LI.line_stream(spark, os.path.join(out, "in")))
    ok = F.col("status") == "ok"
    LI.write(ev.select("line", F.when(ok, F.col("tool_name")).alias("tool_name"), "status"), "status",
             os.path.join(out, "data"), os.path.join(out, "ckpt")).awaitTermination()
    return spark.read.parquet(os.path.join(out, "data"))
