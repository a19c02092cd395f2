"""Session and protocol queries (W1, W2, J2, J3, S4, X7 with history)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import protocol as PR
from ..operators import session as SS
from ..session import stage
from ..sources.protocol_fixture import DUCK_LINES, protocol_lines
from ..sources.tables import table
from . import duck as D
from .registry import query


def conversation_calls(spark, sf_dir):
    """(conv_id, turn, tool_name, args): each turn is a call named by its role."""
    c = table(spark, sf_dir, "conversations")
    args = F.to_json(F.struct(F.col("text").alias("prompt"),
                              F.concat(F.lit("chats/"), F.col("conv_id").cast("string"), F.lit("/"),
                                       F.col("turn").cast("string"), F.lit(".md")).alias("path")))
    return c.select("conv_id", "turn", F.col("role").alias("tool_name"), args.alias("args"))


DUCK_CALLS = """(
SELECT conv_id, turn, role AS tool_name,
       json_object('prompt', text, 'path', 'chats/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.md') AS args
FROM conversations)"""


@query("session_recent_calls", oracle=f"""
SELECT conv_id, turn, array_to_string(r, ',') AS recent_tools, CAST(len(h) AS INTEGER) AS history_size
FROM (SELECT conv_id, turn,
        list(tool_name) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r,
        list(tool_name) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS h
      FROM {DUCK_CALLS} c)""")
def session_recent_calls(spark, sf_dir):
    calls = conversation_calls(spark, sf_dir)
    r = SS.recent_calls(calls, "conv_id", "turn", ["tool_name"], n=3, out_col="recent")
    r = SS.recent_calls(r, "conv_id", "turn", ["tool_name"], n=10, out_col="history")
    return r.select("conv_id", "turn", F.array_join(F.expr("transform(recent, c -> c.tool_name)"), ",")
                    .alias("recent_tools"), F.size("history").alias("history_size"))


@query("session_query", oracle=f"""
WITH w AS (SELECT conv_id, turn, tool_name, args,
             list(args) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS inh
           FROM {DUCK_CALLS} c)
SELECT conv_id, turn, {D.js_trim(f"array_to_string(list_concat([translate(tool_name, '_-', '  ')], {D.arg_kw('args')}, flatten(list_transform(inh, lambda a: coalesce({D.arg_kw('a')}, [])))), ' ')")} AS query
FROM w""")
def session_query(spark, sf_dir):
    calls = conversation_calls(spark, sf_dir)
    r = SS.recent_calls(calls, "conv_id", "turn", ["tool_name", "args"], n=3, out_col="recent")
    return SS.session_query(r).select("conv_id", "turn", "query")


@query("protocol_split", oracle=f"""
WITH l AS (SELECT *, json_valid(line) AS ok FROM {DUCK_LINES} x),
p AS (SELECT seq, conn, ok,
        CASE WHEN ok THEN json_extract_string(line, '$.id') END AS rpc_id,
        CASE WHEN ok THEN json_extract_string(line, '$.method') END AS method,
        CASE WHEN ok THEN json_extract_string(line, '$.params.name') END AS tool_name,
        CASE WHEN ok THEN json_extract(line, '$.result') END AS result,
        CASE WHEN ok THEN json_extract(line, '$.error') END AS error FROM l)
SELECT seq, conn, rpc_id, tool_name,
  CASE WHEN NOT ok THEN 'raw' WHEN method = 'tools/call' AND rpc_id IS NOT NULL AND tool_name IS NOT NULL THEN 'request'
       WHEN rpc_id IS NOT NULL AND (result IS NOT NULL OR error IS NOT NULL) THEN 'response' ELSE 'other' END AS kind
FROM p""")
def protocol_split(spark, sf_dir):
    m = PR.classify_messages(protocol_lines(spark, sf_dir))
    return m.select("seq", "conn", "rpc_id", "tool_name", "kind")


@query("request_response_asof", oracle=f"""
WITH l AS (SELECT *, json_valid(line) AS ok FROM {DUCK_LINES} x),
p AS (SELECT seq, conn,
        CASE WHEN ok THEN json_extract_string(line, '$.id') END AS rpc_id,
        CASE WHEN ok AND json_extract_string(line, '$.method') = 'tools/call' AND json_extract_string(line, '$.params.name') IS NOT NULL
             THEN 'request'
             WHEN ok AND json_extract_string(line, '$.id') IS NOT NULL
                  AND (json_extract(line, '$.result') IS NOT NULL OR json_extract(line, '$.error') IS NOT NULL) THEN 'response' END AS kind,
        CASE WHEN ok THEN json_extract_string(line, '$.params.name') END AS tool_name FROM l),
k AS (SELECT * FROM p WHERE kind IN ('request', 'response') AND rpc_id IS NOT NULL),
g AS (SELECT *, lag(seq) OVER w AS prev_seq, lag(kind) OVER w AS prev_kind FROM k
      WINDOW w AS (PARTITION BY conn, rpc_id ORDER BY seq))
SELECT g.conn, g.rpc_id, g.seq, coalesce(g.prev_kind = 'request', false) AS matched,
       CASE WHEN g.prev_kind = 'request' THEN g.prev_seq END AS request_seq,
       CASE WHEN g.prev_kind = 'request' THEN r.tool_name END AS tool_name
FROM g LEFT JOIN k r ON r.conn = g.conn AND r.seq = g.prev_seq
WHERE g.kind = 'response'""")
def request_response_asof(spark, sf_dir):
    m = PR.classify_messages(protocol_lines(spark, sf_dir)).select("conn", "rpc_id", "seq", "kind", "tool_name")
    # Written once: the look-back reads it twice, and a filter on ``kind`` would parse each line again.
    m = stage(m, "messages").filter(F.col("kind").isin("request", "response"))
    out = SS.match_responses(m, ["conn", "rpc_id"], "seq", "kind", carry=("tool_name",)).filter("kind = 'response'")
    matched = F.coalesce(F.col("prev_kind") == "request", F.lit(False))
    return out.select("conn", "rpc_id", "seq", matched.alias("matched"),
                      F.when(matched, F.col("prev_seq")).alias("request_seq"),
                      F.when(matched, F.col("prev_tool_name")).alias("tool_name"))
