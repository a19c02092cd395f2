"""Queries over blocks: sizing, classification, inventory, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..config import FIXTURE_CONFIG, Rule
from ..functions import exprs as E
from ..operators import blocks as B
from ..operators import routing as R
from ..sources import fixtures as FX
from ..sources.tables import table
from . import duck as D
from .registry import query

THR = FIXTURE_CONFIG.text_threshold

# Rules used on the event-derived tool names: a pattern rule placed before an exact
# rule wins for the names it matches (order decides).
FIXTURE_RULES = (
    Rule("dom-cleanup", tool_name="browser_snapshot"),
    Rule("passthrough", tool_name_pattern="^(click|view)$"),
    Rule("truncate", tool_name_pattern="ur"),
    Rule("json-collapse", tool_name="purchase"),
    Rule("ocr", tool_name_pattern="er"),
    Rule("auto", tool_name_pattern=".*"),
)


# P1 ---------------------------------------------------------------------------
@query("token_estimate", oracle=f"""
SELECT result_id, pos, {D.tokens('text')} AS tokens, CAST(strlen(text) AS BIGINT) AS n_bytes
FROM {D.TEXT_BLOCKS} b""")
def token_estimate(spark, sf_dir):
    b = FX.text_blocks(spark, sf_dir)
    return b.select("result_id", "pos", F.expr(E.token_estimate("text")).alias("tokens"),
                    F.octet_length("text").cast("bigint").alias("n_bytes"))


# P2-P6 ------------------------------------------------------------------------
@query("classify_blocks", oracle=f"""
SELECT result_id, pos, before, content_type, {D.strategy_for('content_type')} AS default_strategy
FROM {D.annotated_blocks(f"({D.TEXT_BLOCKS} UNION ALL SELECT * FROM {D.SHOT_BLOCKS})", THR)} a""")
def classify_blocks(spark, sf_dir):
    b = FX.text_blocks(spark, sf_dir).unionByName(FX.screenshot_blocks(spark, sf_dir))
    return B.annotate(b, FIXTURE_CONFIG).select("result_id", "pos", "before", "content_type",
                                                 "default_strategy")


@query("block_inventory", oracle=f"""
SELECT source, content_type, count(*) AS n_blocks, count(DISTINCT result_id) AS n_results,
       sum(before) AS tokens_before, max(before) AS max_tokens
FROM {D.annotated_blocks(D.TEXT_BLOCKS, THR)} a GROUP BY source, content_type""")
def block_inventory(spark, sf_dir):
    return B.inventory(B.annotate(FX.text_blocks(spark, sf_dir), FIXTURE_CONFIG))


# J1 ---------------------------------------------------------------------------
@query("rule_match", oracle=f"""
WITH names AS (
  SELECT {D.short_name('full_name')} AS tool_name FROM {D.EVENT_TOOL_NAMES} e
  WHERE starts_with(full_name, 'mcp__')
  UNION ALL SELECT role AS tool_name FROM conversations),
counted AS (SELECT tool_name, count(*) AS n_calls FROM names GROUP BY tool_name)
SELECT tool_name, {D.rule_case('tool_name', FIXTURE_RULES)} AS strategy, n_calls FROM counted""")
def rule_match(spark, sf_dir):
    ev = FX.event_tool_names(spark, sf_dir).filter(F.expr(E.is_mcp_tool("full_name")))
    names = (ev.select(F.expr(E.short_tool_name("full_name")).alias("tool_name"))
             .unionByName(table(spark, sf_dir, "conversations").select(F.col("role").alias("tool_name"))))
    # Aggregate first: the theta join then sees one row per distinct name.
    counted = names.groupBy("tool_name").agg(F.count(F.lit(1)).alias("n_calls"))
    matched = R.match_rules(counted, "tool_name", FIXTURE_RULES)
    return counted.join(matched, "tool_name").select("tool_name", "strategy", "n_calls")


# P12 --------------------------------------------------------------------------
@query("short_tool_name", oracle=f"""
SELECT full_name, {D.short_name('full_name')} AS short_name, count(*) AS n_calls
FROM {D.EVENT_TOOL_NAMES} e WHERE starts_with(full_name, 'mcp__') GROUP BY full_name""")
def short_tool_name(spark, sf_dir):
    ev = FX.event_tool_names(spark, sf_dir).filter(F.expr(E.is_mcp_tool("full_name")))
    return (ev.groupBy("full_name").agg(F.count(F.lit(1)).alias("n_calls"))
            .select("full_name", F.expr(E.short_tool_name("full_name")).alias("short_name"), "n_calls"))


# P7-P10 -------------------------------------------------------------------------
@query("image_guard", oracle=f"""
WITH a AS (SELECT * FROM {D.annotated_blocks(D.SHOT_BLOCKS, THR)} x),
f AS (SELECT result_id,
             bool_or(CASE WHEN type = 'image' THEN true ELSE content_type <> 'small-text' END) AS compressible,
             bool_or({D.has_image_path('type', 'text')}) AS has_path
      FROM a GROUP BY result_id),
r AS (SELECT a.*, f.compressible, f.has_path, {D.short_name('tool_name')} AS short_name FROM a JOIN f USING (result_id)),
g AS (SELECT r.*, {D.screenshot_tool('short_name')} AS screenshot_tool,
             {D.rule_case('short_name', C.DEFAULT_RULES)} AS rule_strategy FROM r)
SELECT result_id, pos, type, content_type, compressible, has_path, screenshot_tool,
       CASE WHEN NOT compressible THEN 'skip'
            WHEN rule_strategy = 'auto' AND type = 'image' AND NOT has_path AND NOT screenshot_tool THEN 'passthrough'
            WHEN rule_strategy = 'auto' THEN {D.strategy_for('content_type')}
            ELSE rule_strategy END AS effective_strategy
FROM g""")
def image_guard(spark, sf_dir):
    cfg = FIXTURE_CONFIG
    a = B.annotate(FX.screenshot_blocks(spark, sf_dir), cfg)
    r = R.route(a, cfg)
    return r.select("result_id", "pos", "type", "content_type", "compressible", "has_path",
                    "screenshot_tool", "effective_strategy")


# S7 ---------------------------------------------------------------------------
# Config documents derived from events: the event type picks which keys are present.
_CONFIG_DOCS_SPARK = """
CASE event_type
  WHEN 'view' THEN concat('{"threshold": ', CAST(event_id * 10 AS STRING), '}')
  WHEN 'click' THEN concat('{"minBlockTokens": ', CAST(event_id * 10 AS STRING), '}')
  WHEN 'signup' THEN concat('{"minBlockTokens": ', CAST(event_id AS STRING), ', "threshold": ', CAST(event_id * 3 AS STRING), '}')
  WHEN 'purchase' THEN concat('{"threshold": 7, "textCompressionThreshold": ', CAST(event_id * 2 AS STRING), '}')
  ELSE concat('{"threshold": ', CAST(event_id AS STRING)) END"""
_CONFIG_DOCS_DUCK = """
CASE event_type
  WHEN 'view' THEN '{"threshold": ' || CAST(event_id * 10 AS VARCHAR) || '}'
  WHEN 'click' THEN '{"minBlockTokens": ' || CAST(event_id * 10 AS VARCHAR) || '}'
  WHEN 'signup' THEN '{"minBlockTokens": ' || CAST(event_id AS VARCHAR) || ', "threshold": ' || CAST(event_id * 3 AS VARCHAR) || '}'
  WHEN 'purchase' THEN '{"threshold": 7, "textCompressionThreshold": ' || CAST(event_id * 2 AS VARCHAR) || '}'
  ELSE '{"threshold": ' || CAST(event_id AS VARCHAR) END"""


@query("legacy_config_threshold", oracle=f"""
WITH d AS (SELECT event_id, user_id, {_CONFIG_DOCS_DUCK} AS doc,
                  CASE WHEN user_id % 7 = 0 THEN CAST(50000 AS BIGINT) END AS flag_threshold FROM events),
k AS (SELECT *, CASE WHEN json_valid(doc) AND json_type(doc) = 'OBJECT' THEN json_keys(doc) END AS keys FROM d)
SELECT event_id,
  coalesce(flag_threshold,
    CASE WHEN list_contains(keys, 'textCompressionThreshold') THEN CAST(json_extract_string(doc, '$.textCompressionThreshold') AS BIGINT)
         WHEN list_contains(keys, 'threshold') THEN CAST(json_extract_string(doc, '$.threshold') AS BIGINT)
         WHEN list_contains(keys, 'minBlockTokens') THEN CAST(json_extract_string(doc, '$.minBlockTokens') AS BIGINT) END,
    CAST({C.DEFAULT_TEXT_THRESHOLD} AS BIGINT)) AS text_threshold,
  CASE WHEN flag_threshold IS NOT NULL THEN 'flag'
       WHEN list_contains(keys, 'textCompressionThreshold') OR list_contains(keys, 'threshold')
            OR list_contains(keys, 'minBlockTokens') THEN 'file' ELSE 'default' END AS origin
FROM k""")
def legacy_config_threshold(spark, sf_dir):
    from ..operators.config_rows import resolve_threshold
    e = table(spark, sf_dir, "events")
    docs = e.select("event_id", F.expr(_CONFIG_DOCS_SPARK).alias("doc"),
                    F.when(e.user_id % 7 == 0, F.lit(50000).cast("bigint")).alias("flag_threshold"))
    return resolve_threshold(docs, "doc", "flag_threshold").select("event_id", "text_threshold", "origin")


# S1 ---------------------------------------------------------------------------
_HOOK_LINES_SPARK = """CASE WHEN event_id % 70 = 0 THEN '   '
WHEN event_id % 50 = 0 THEN concat('{"session_id": "s', CAST(user_id AS STRING), '", "tool_name": ')
ELSE concat('{"session_id": "s', CAST(user_id AS STRING), '", "cwd": "/w", "hook_event_name": "PostToolUse", ',
            '"tool_name": "mcp__srv__', event_type, '", "tool_input": ', props, ', "tool_response": "ok"}') END"""
_HOOK_LINES_DUCK = _HOOK_LINES_SPARK.replace("CAST(user_id AS STRING)", "CAST(user_id AS VARCHAR)").replace(
    "concat(", "concat(")


@query("tool_call_source", oracle=f"""
WITH l AS (SELECT event_id, {_HOOK_LINES_DUCK} AS line FROM events)
SELECT CASE WHEN trim(line) = '' THEN 'empty' WHEN NOT json_valid(line) THEN 'corrupt' ELSE 'ok' END AS status,
       CASE WHEN json_valid(line) AND trim(line) <> '' THEN json_extract_string(line, '$.tool_name') END AS tool_name,
       count(*) AS n
FROM l GROUP BY ALL""")
def tool_call_source(spark, sf_dir):
    from ..sources.toolcalls import parse_hook_lines
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_HOOK_LINES_SPARK).alias("line"))
    p = parse_hook_lines(e)
    return p.groupBy("status", F.when(F.col("status") == "ok", F.col("tool_name")).alias("tool_name")).agg(
        F.count(F.lit(1)).alias("n"))


# P11 --------------------------------------------------------------------------
@query("dry_run_plan", oracle=f"""
WITH a AS (SELECT * FROM {D.annotated_blocks(D.TEXT_BLOCKS, THR)} x),
f AS (SELECT result_id, bool_or(CASE WHEN type = 'image' THEN true ELSE content_type <> 'small-text' END) AS compressible
      FROM a GROUP BY result_id),
r AS (SELECT a.*, f.compressible, {D.short_name('tool_name')} AS short_name FROM a JOIN f USING (result_id))
SELECT result_id, pos, before, content_type, compressible, {D.rule_case('short_name', C.DEFAULT_RULES)} AS rule_strategy,
       CASE WHEN NOT compressible THEN 'skip' WHEN {D.rule_case('short_name', C.DEFAULT_RULES)} = 'auto'
            THEN {D.strategy_for('content_type')} ELSE {D.rule_case('short_name', C.DEFAULT_RULES)} END AS would_apply
FROM r""")
def dry_run_plan(spark, sf_dir):
    """The decisions a dry run reports (sizes, types, rules, strategies); nothing is reduced."""
    r = R.route(B.annotate(FX.text_blocks(spark, sf_dir), FIXTURE_CONFIG), FIXTURE_CONFIG)
    return r.select("result_id", "pos", "before", "content_type", "compressible", "rule_strategy",
                    F.col("effective_strategy").alias("would_apply"))
