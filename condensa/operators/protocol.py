"""Protocol stream split (S4): requests, responses and raw lines of JSON-RPC traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MESSAGE = "id string, method string, params struct<name: string, arguments: string>, result string, error string"


def classify_messages(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Adds kind ('request' | 'response' | 'raw' | 'other'), rpc_id, tool_name, tool_args,
    result, error. Unparsable lines are 'raw' and are forwarded as they are; JSON that is no object is 'other'."""
    valid = F.expr(f"try_parse_json({line_col}) IS NOT NULL")
    # A line's fields come from one parse; an array's first element is not the message.
    record = F.when(F.ltrim(line_col).startswith("{"), F.from_json(line_col, MESSAGE))
    df = lines.withColumn("_valid", valid).withColumn("_m", F.when(F.col("_valid"), record))
    df = (df.withColumn("rpc_id", F.col("_m.id")).withColumn("tool_name", F.col("_m.params.name"))
            .withColumn("tool_args", F.col("_m.params.arguments"))
            .withColumn("result", F.col("_m.result")).withColumn("error", F.col("_m.error")))
    kind = (F.when(~F.col("_valid"), F.lit("raw"))
            .when((F.col("_m.method") == "tools/call") & F.col("rpc_id").isNotNull() & F.col("tool_name").isNotNull(),
                  F.lit("request"))
            .when(F.col("rpc_id").isNotNull() & (F.col("result").isNotNull() | F.col("error").isNotNull()),
                  F.lit("response"))
            .otherwise(F.lit("other")))
    return df.withColumn("kind", kind).drop("_valid", "_m")
