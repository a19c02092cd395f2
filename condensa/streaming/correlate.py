"""M1: continuous correlation of tool-call requests and their responses.

Keyed state per (connection, request id) is the last line of the key, no more: a response belongs to the
request just before it in the order of ``seq``. A line that comes after later ones is told as late, and
``settled`` matches the lines of its key anew in batch, so no line is lost and files in any order give
the batch result. Requests are told, too (without their lines), for that repair. Responses
without a request and lines that are no call message pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.protocol import classify_messages
from ..operators.session import match_responses

OUT = ("conn BIGINT, rpc_id STRING, kind STRING, request_seq BIGINT, response_seq BIGINT, tool_name STRING, tool_args STRING, "
       "result STRING, error STRING, line STRING, late BOOLEAN")
STATE = "seq BIGINT, request BOOLEAN, tool STRING, args STRING"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _match(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # a micro-batch's lines of one key: they may come in several Arrow batches, and before or after those seen
    last = state.get if state.exists else None
    out = []
    for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
        seq, request = int(r.seq), r.kind == "request"
        late = last is not None and seq < last[0]
        if request:
            out.append((*key, r.kind, seq, None, r.tool_name, r.tool_args, None, None, None, late))
        else:
            call = (last[0], last[2], last[3]) if last is not None and not late and last[1] else (None, None, None)
            out.append((*key, r.kind, call[0], seq, *call[1:], r.result, r.error, r.line, late))
        if not late:
            last = (seq, request, *((r.tool_name, r.tool_args) if request else (None, None)))
    state.update((int(last[0]), bool(last[1]), last[2], last[3]))
    yield pd.DataFrame(out, columns=COLUMNS).astype({"request_seq": "Int64", "response_seq": "Int64"})


def correlate(lines: DataFrame) -> DataFrame:
    """lines: (seq, conn, ts, line) stream, ``seq`` once per connection → one row per response, with its request; one row per
    request (kind 'request'); one row per other line (kind 'raw' or 'other'), unchanged. ``late`` rows came
    after later lines of their key: ``settled`` matches those keys anew."""
    m = classify_messages(lines)
    keyed = m.filter(F.col("kind").isin("request", "response"))
    matched = keyed.groupBy("conn", "rpc_id").applyInPandasWithState(_match, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    passed = m.filter(~F.col("kind").isin("request", "response"))
    null = lambda kind: F.lit(None).cast(kind)
    return matched.unionByName(passed.select(
        "conn", null("string").alias("rpc_id"), "kind", null("bigint").alias("request_seq"), F.col("seq").alias("response_seq"),
        null("string").alias("tool_name"), null("string").alias("tool_args"), null("string").alias("result"), null("string").alias("error"), "line",
        F.lit(False).alias("late")))


def settled(rows: DataFrame) -> DataFrame:
    """The written rows of ``correlate`` without the requests, every response with the request that all lines give it."""
    key = ["conn", "rpc_id"]
    late = rows.filter("late").select(*key).distinct()
    rest = rows.filter("kind <> 'request'").join(late, key, "left_anti").drop("late")
    lines = rows.join(late, key, "left_semi").withColumn("seq", F.when(F.col("kind") == "request", F.col("request_seq")).otherwise(F.col("response_seq")))
    found = match_responses(lines.select(*key, "seq", "kind", "result", "error", "line"), key, "seq", "kind").filter("kind = 'response'")
    calls = lines.filter("kind = 'request'").select(*key, F.col("seq").alias("request_seq"), "tool_name", "tool_args")
    found = found.withColumn("request_seq", F.when(F.col("prev_kind") == "request", F.col("prev_seq"))).withColumnRenamed("seq", "response_seq")
    return rest.unionByName(found.join(calls, [*key, "request_seq"], "left").select(*rest.columns))
