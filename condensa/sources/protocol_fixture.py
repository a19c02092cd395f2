"""JSON-RPC message lines derived from ``events`` (one line per event, in event order).

Even events are ``tools/call`` requests, odd events the responses to the request just
before them (every tenth response is an error); request ids repeat within a connection,
and every fiftieth line is not JSON at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

_LINE_SPARK = """CASE WHEN event_id % 50 = 0 THEN concat('not json ', CAST(event_id AS STRING))
WHEN event_id % 2 = 0 THEN concat('{"jsonrpc": "2.0", "id": ', CAST(floor(event_id / 2) % 7 AS STRING),
  ', "method": "tools/call", "params": {"name": "', event_type, '", "arguments": ', props, '}}')
WHEN event_id % 20 = 19 THEN concat('{"jsonrpc": "2.0", "id": ', CAST(floor(event_id / 2) % 7 AS STRING),
  ', "error": {"code": -32000, "message": "failed"}}')
ELSE concat('{"jsonrpc": "2.0", "id": ', CAST(floor(event_id / 2) % 7 AS STRING),
  ', "result": {"content": [{"type": "text", "text": "value ', CAST(CAST(round(value * 100) AS BIGINT) AS STRING), '"}]}}') END"""

DUCK_LINES = """(
SELECT event_id AS seq, CAST(floor(event_id / 2) % 5 AS BIGINT) AS conn, ts,
  CASE WHEN event_id % 50 = 0 THEN 'not json ' || CAST(event_id AS VARCHAR)
  WHEN event_id % 2 = 0 THEN '{"jsonrpc": "2.0", "id": ' || CAST(CAST(floor(event_id / 2) AS BIGINT) % 7 AS VARCHAR)
    || ', "method": "tools/call", "params": {"name": "' || event_type || '", "arguments": ' || props || '}}'
  WHEN event_id % 20 = 19 THEN '{"jsonrpc": "2.0", "id": ' || CAST(CAST(floor(event_id / 2) AS BIGINT) % 7 AS VARCHAR)
    || ', "error": {"code": -32000, "message": "failed"}}'
  ELSE '{"jsonrpc": "2.0", "id": ' || CAST(CAST(floor(event_id / 2) AS BIGINT) % 7 AS VARCHAR)
    || ', "result": {"content": [{"type": "text", "text": "value ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '"}]}}' END AS line
FROM events)"""


def protocol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, conn, ts, line)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), (F.floor(F.col("event_id") / 2) % 5).cast("bigint").alias("conn"),
                    F.col("ts").cast("timestamp").alias("ts"), F.expr(_LINE_SPARK).alias("line"))
