"""Event log and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import event_log as EL
from ..operators import report as RP
from ..operators import protocol as PR
from ..operators import session as SS
from ..session import ensure_checkpoint_dir, stage
from ..sources import fixtures as FX
from ..sources.protocol_fixture import DUCK_LINES, protocol_lines
from ..sources.tables import fingerprint, table
from . import duck as D
from .q_normalise import DUCK_EMPTY, empty_responses
from .q_results import REDUCED, _reduced
from .registry import query

# The log of the end-to-end reduction, and an event for each empty response.
_EVENTS_SQL = f"""
WITH {REDUCED}
SELECT tool, action, total_before AS before, CASE WHEN action = 'compressed' THEN total_after ELSE total_before END AS after,
       CASE WHEN action = 'compressed' THEN dominant_type END AS content_type, n_errors AS errors FROM results
UNION ALL SELECT event_type, 'empty-response', 0, 0, NULL, 0 FROM ({DUCK_EMPTY})"""


def log_folder(spark, sf_dir):
    """The folder of this application's event log of the tables as they are, written if it has not been.

    The batch is named by the state of the input files, so the ledger tells whether it was reduced before:
    the first query that needs the log pays for the reduction, and changed files give another log.
    """
    mark = fingerprint(spark, sf_dir)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/condensa/event-log/{spark.sparkContext.applicationId}/{mark}"
    if EL.has(spark, root, mark):
        return root
    summary, _ = _reduced(spark, sf_dir)
    empty = empty_responses(spark, sf_dir).withColumn("args", F.lit("{}"))
    EL.append(RP.events_from_results(summary).unionByName(RP.empty_events(empty, "event_type")), root, mark)
    return root


def event_log_table(spark, sf_dir):
    """The log's events: those of the end-to-end reduction and of the empty responses."""
    return EL.read(spark, log_folder(spark, sf_dir))


@query("savings_report", oracle=f"""
WITH ev AS ({_EVENTS_SQL})
SELECT content_type, CAST(GROUPING(content_type) AS INTEGER) AS is_total, count(*) AS events, sum(before) AS before,
       sum(after) AS after, sum(errors) AS errors, round((1 - sum(after) / sum(before)) * 100, 3) AS reduction_pct
FROM ev GROUP BY ROLLUP (content_type)""")
def savings_report(spark, sf_dir):
    """A5 over the log, without the durations: those are measured, so no two runs agree."""
    return RP.savings(event_log_table(spark, sf_dir))


@query("latency_report", oracle=f"""
WITH l AS (SELECT *, json_valid(line) AS ok FROM {DUCK_LINES} x),
k AS (SELECT conn, seq, ts, json_extract_string(line, '$.id') AS rpc_id, json_extract_string(line, '$.params.name') AS tool,
             json_extract_string(line, '$.method') IS NOT DISTINCT FROM 'tools/call' AS call FROM l WHERE ok),
g AS (SELECT call, ts, lag(call) OVER w AS after_call, lag(tool) OVER w AS tool, lag(ts) OVER w AS since
      FROM k WINDOW w AS (PARTITION BY conn, rpc_id ORDER BY seq)),
d AS (SELECT tool, (epoch_us(ts) - epoch_us(since)) // 1000 AS ms FROM g WHERE NOT call AND after_call)
SELECT tool, CAST(GROUPING(tool) AS INTEGER) AS is_total, count(*) AS n, round(avg(ms), 3) AS avg_ms,
       quantile_cont(ms, 0.5) AS median_ms FROM d GROUP BY ROLLUP (tool)""")
def latency_report(spark, sf_dir):
    """A5's mean and exact median over the times from call to response, per tool and over all."""
    m = PR.classify_messages(protocol_lines(spark, sf_dir))
    m = stage(m.select("conn", "rpc_id", "seq", "kind", "tool_name", F.unix_micros("ts").alias("at")), "messages")
    done = SS.match_responses(m.filter(F.col("kind").isin("request", "response")), ["conn", "rpc_id"], "seq", "kind",
                              carry=("tool_name", "at")).filter("kind = 'response' AND prev_kind = 'request'")
    took = done.select(F.col("prev_tool_name").alias("tool"), F.expr("(at - prev_at) div 1000").alias("ms"))
    return RP.latency(stage(took, "latency"), "tool", "ms")


@query("outcome_counts", oracle=f"""
WITH ev AS ({_EVENTS_SQL}) SELECT tool, action, count(*) AS n FROM ev GROUP BY tool, action""")
def outcome_counts(spark, sf_dir):
    return RP.outcome_counts(event_log_table(spark, sf_dir))


@query("detail_previews", oracle=f"""
WITH t AS (SELECT result_id, pos, text FROM {D.TEXT_BLOCKS} b WHERE type = 'text'),
a AS (SELECT result_id, string_agg(coalesce(substr(text, 1, 300), ''), chr(10) || '---' || chr(10) ORDER BY pos) AS p
      FROM t GROUP BY result_id)
SELECT result_id, CASE WHEN p = '' THEN NULL WHEN length(p) > 500 THEN substr(p, 1, 500) || '...' ELSE p END AS preview
FROM a""")
def detail_previews(spark, sf_dir):
    return RP.previews(FX.text_blocks(spark, sf_dir))


_ARGS_SPARK = """to_json(named_struct('prompt', text, 'turn', turn, 'even', turn % 2 = 0,
                 'meta', named_struct('conv', conv_id), 'tags', array('a', 'b')))"""


def _args_duck(args: str) -> str:
    return f"""array_to_string(list_filter(list_transform(json_keys({args}), lambda k:
  CASE WHEN json_type({args}, {D.kpath('k')}) = 'VARCHAR' THEN k || '=' ||
         CASE WHEN length(json_extract_string({args}, {D.kpath('k')})) > 200
              THEN substr(json_extract_string({args}, {D.kpath('k')}), 1, 200) || '...' ELSE json_extract_string({args}, {D.kpath('k')}) END
       WHEN json_type({args}, {D.kpath('k')}) IN ('BOOLEAN', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN k || '=' || json_extract_string({args}, {D.kpath('k')})
  END), lambda x: x IS NOT NULL), '; ')"""


@query("log_args_summary", oracle=f"""
WITH c AS (SELECT conv_id, turn, json_object('prompt', text, 'turn', turn, 'even', turn % 2 = 0,
                  'meta', json_object('conv', conv_id), 'tags', ['a', 'b']) AS args FROM conversations)
SELECT conv_id, turn, {_args_duck('args')} AS summary FROM c""")
def log_args_summary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ARGS_SPARK).alias("args"))
    return c.select("conv_id", "turn", F.expr(RP.args_summary_expr("args")).alias("summary"))


@query("event_log", oracle=f"""
WITH {REDUCED}
SELECT tool, result_id, CASE WHEN action = 'compressed' THEN rule_strategy ELSE 'skip' END AS strategy, total_before AS before,
       CASE WHEN action = 'compressed' THEN total_after ELSE total_before END AS after,
       CASE WHEN action <> 'compressed' THEN '0%' WHEN total_before > 0 THEN printf('%.1f', (1 - total_after / total_before) * 100) || '%' END AS reduction,
       CASE WHEN action = 'compressed' THEN dominant_type END AS content_type, action, CAST(n_errors AS INTEGER) AS errors,
       {_args_duck('args')} AS tool_input FROM results""")
def event_log(spark, sf_dir):
    """One event per result, read from the log (without its measured times)."""
    return event_log_table(spark, sf_dir).filter("result_id IS NOT NULL").drop("ts", "day", "duration_ms")
