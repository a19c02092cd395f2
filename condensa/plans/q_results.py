"""Result-level queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..config import FIXTURE_CONFIG as CFG
from ..operators import blocks as B
from ..operators import results as RS
from ..operators import routing as R
from ..session import stage, unstage
from ..sources import fixtures as FX
from ..sources.results_fixture import all_blocks, duck_all_blocks, ocr_table
from ..sources.tables import spread
from . import duck as D
from .q_json import duck_reduced
from .q_text import _duck_reduce_ctes
from .registry import query

ALL = duck_all_blocks(D.TEXT_BLOCKS, D.SHOT_BLOCKS)

ROUTED = f"""
a AS (SELECT * FROM {D.annotated_blocks(ALL, CFG.text_threshold)} x),
f AS (SELECT result_id,
             bool_or(CASE WHEN type = 'image' THEN true ELSE content_type <> 'small-text' END) AS compressible,
             bool_or({D.has_image_path('type', 'text')}) AS has_path FROM a GROUP BY result_id),
r0 AS (SELECT a.*, f.compressible, f.has_path, {D.short_name('tool_name')} AS short_name FROM a JOIN f USING (result_id)),
r AS (SELECT r0.*, {D.rule_case('short_name', C.DEFAULT_RULES)} AS rule_strategy,
             {D.screenshot_tool('short_name')} AS screenshot_tool FROM r0),
routed AS (SELECT r.*, CASE WHEN rule_strategy = 'auto' AND type = 'image' AND NOT has_path AND NOT screenshot_tool
                            THEN 'passthrough' WHEN rule_strategy = 'auto' THEN {D.strategy_for('content_type')}
                            ELSE rule_strategy END AS effective_strategy FROM r)"""


_OCR = f"""
WITH i AS (SELECT * FROM {D.SHOT_BLOCKS} s WHERE type = 'image'),
o AS (SELECT sha256(i.data) AS image_key, CASE WHEN CAST(regexp_extract(i.result_id, '(\\d+)$', 1) AS BIGINT) % 7 = 0
             THEN ' ok ' ELSE b.text END AS ocr, b.item_id % 5 = 3 AS failed
      FROM i JOIN benchmark b ON CAST(regexp_extract(i.result_id, '(\\d+)$', 1) AS BIGINT) = b.item_id),
j AS (SELECT id, ocr, coalesce(failed, false) AS failed, coalesce(json_extract_string(args, '$.filename'), json_extract_string(args, '$.path')) AS path
      FROM picked LEFT JOIN o ON sha256(picked.data) = o.image_key WHERE branch = 'ocr')
SELECT id, failed, CASE WHEN failed THEN NULL WHEN ocr IS NOT NULL AND length(regexp_replace(ocr, {D.s(C.JS_WS)}, '', 'g')) >= {C.MIN_MEANINGFUL_CHARS}
       THEN '[OCR extracted from screenshot — may contain errors]' || chr(10) || {D.js_trim('ocr')}
       WHEN ocr IS NULL AND path IS NOT NULL
       THEN '[Screenshot saved to: ' || path || ' — OCR could not extract text. No text found on image.]'
       WHEN path IS NOT NULL THEN '[Screenshot saved to: ' || path || ' — no text found on image.]' END AS seen FROM j"""


def _ratio(after: str, before: str) -> str:
    return f"CASE WHEN {before} > 0 THEN {D.js_round(f'(1 - {after} / {before}) * 100')} ELSE 0 END"


# R1 in SQL: every branch on its own blocks, then totals, guard and summary per result.
REDUCED = f"""
rt AS MATERIALIZED (WITH {ROUTED} SELECT * FROM routed),
picked AS MATERIALIZED (
  SELECT *, result_id || '#' || pos AS id,
         CASE WHEN compressible AND effective_strategy = 'ocr' AND type = 'image' AND coalesce(data, '') <> '' THEN 'ocr'
              WHEN compressible AND type = 'text' AND coalesce(text, '') <> '' THEN effective_strategy END AS branch FROM rt),
trunc_in AS (SELECT id AS doc_id, text, {D.tokenize('query')} AS q
             FROM (SELECT *, {D.synthetic_query('short_name', 'args', ['args'])} AS query FROM picked WHERE branch = 'truncate')),
trunc AS MATERIALIZED (WITH {_duck_reduce_ctes('trunc_in').strip()} SELECT doc_id AS id, reduced FROM red),
js AS MATERIALIZED ({duck_reduced("(SELECT id, text FROM picked WHERE branch = 'json-collapse')", 'id')}),
dom AS MATERIALIZED (WITH {D.snap_outline_ctes("(SELECT id, text FROM picked WHERE branch = 'dom-cleanup')", 'id', 'text').strip()}
                     SELECT block_id AS id, outline FROM outline),
seen AS MATERIALIZED ({_OCR}),
blocks_out AS (
  SELECT picked.*, coalesce(failed, false) AS error, CASE WHEN seen IS NOT NULL THEN 'text' ELSE type END AS out_type, coalesce(trunc.reduced, js.reduced, outline, seen, text) AS out_text,
         CASE WHEN seen IS NULL THEN data END AS out_data, CASE WHEN seen IS NULL THEN mime_type END AS out_mime
  FROM picked LEFT JOIN trunc USING (id) LEFT JOIN js USING (id) LEFT JOIN dom USING (id) LEFT JOIN seen USING (id)),
sized AS MATERIALIZED (SELECT *, {D.block_tokens('out_type', 'out_text', 'out_data')} AS after FROM blocks_out),
stats AS (SELECT result_id, content_type, count(*) AS n, sum(before) AS before, sum(after) AS after, min(pos) AS first_pos
          FROM sized WHERE compressible AND NOT error GROUP BY ALL),
parts AS (SELECT result_id,
    string_agg(content_type || ': ' || n || ' block' || CASE WHEN n > 1 THEN 's' ELSE '' END || ', ' || {D.fmt_int('before')} || '→' || {D.fmt_int('after')}
               || ' tokens (-' || CAST({_ratio('after', 'before')} AS VARCHAR) || '%)', '; ' ORDER BY first_pos)
      FILTER (content_type <> 'small-text' AND before <> after) AS big,
    any_value(n || ' small block' || CASE WHEN n > 1 THEN 's' ELSE '' END || ' unchanged') FILTER (content_type = 'small-text') AS small,
    arg_max(content_type, [before, -first_pos]) FILTER (content_type <> 'small-text') AS dominant
  FROM stats GROUP BY result_id),
totals AS (SELECT result_id, any_value(short_name) AS tool, any_value(rule_strategy) AS rule_strategy, any_value(compressible) AS compressible, any_value(args) AS args,
                  count(*) AS n_blocks, count(*) FILTER (error) AS n_errors, sum(before) AS total_before, sum(after) AS total_after FROM sized GROUP BY result_id),
judged AS (SELECT totals.*, coalesce(dominant, 'small-text') AS dominant_type, big, small,
             CASE WHEN NOT compressible OR total_after = total_before OR (total_after > total_before * {C.GROWTH_LIMIT}::DOUBLE AND rule_strategy = 'auto')
                  THEN 'no-change' ELSE 'compressed' END AS action FROM totals LEFT JOIN parts USING (result_id)),
results AS (SELECT *, CASE WHEN action = 'compressed' THEN '[{RS.SUMMARY_TAG}: ' || {D.fmt_int('total_before')} || '→' || {D.fmt_int('total_after')} || ' tokens (-'
             || CAST({_ratio('total_after', 'total_before')} AS VARCHAR) || '%)' || CASE WHEN big IS NOT NULL OR small IS NOT NULL THEN ' | ' || concat_ws('; ', big, small) ELSE '' END || ']' END AS summary
            FROM judged)"""


def _routed(spark, sf_dir):
    return R.route(B.annotate(spread(all_blocks(spark, sf_dir), "result_id"), CFG), CFG)


def _reduced(spark, sf_dir):
    summary, reduced = RS.reduce_results(all_blocks(spark, sf_dir), CFG, ocr_table(spark, sf_dir), materialize=True)
    return summary, reduced


@query("result_totals", oracle=f"""
WITH {ROUTED}
SELECT result_id, any_value(short_name) AS tool, any_value(rule_strategy) AS rule_strategy,
       bool_or(compressible) AS compressible, count(*) AS n_blocks, sum(before) AS total_before
FROM routed GROUP BY result_id""")
def result_totals(spark, sf_dir):
    r = _routed(spark, sf_dir)
    return (r.groupBy("result_id")
            .agg(F.first("short_name").alias("tool"), F.first("rule_strategy").alias("rule_strategy"),
                 F.bool_or("compressible").alias("compressible"), F.count(F.lit(1)).alias("n_blocks"),
                 F.sum("before").alias("total_before")))


@query("per_type_stats", oracle=f"""
WITH {ROUTED}
SELECT result_id, content_type, count(*) AS n, sum(before) AS before,
       arg_min(effective_strategy, pos) AS strategy, min(pos) AS first_pos
FROM routed WHERE compressible GROUP BY result_id, content_type""")
def per_type_stats(spark, sf_dir):
    r = _routed(spark, sf_dir).filter("compressible")
    return (r.groupBy("result_id", "content_type")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("before").alias("before"),
                 F.min_by("effective_strategy", "pos").alias("strategy"), F.min("pos").alias("first_pos")))


@query("dominant_type", oracle=f"""
WITH {ROUTED},
t AS (SELECT result_id, content_type, sum(before) AS before, min(pos) AS first_pos FROM routed
      WHERE compressible AND content_type <> 'small-text' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY before DESC, first_pos) AS rn FROM t)
SELECT f.result_id, coalesce(k.content_type, 'small-text') AS dominant_type
FROM (SELECT DISTINCT result_id FROM routed WHERE compressible) f LEFT JOIN k ON k.result_id = f.result_id AND k.rn = 1""")
def dominant_type(spark, sf_dir):
    r = _routed(spark, sf_dir).filter("compressible")
    t = (r.filter(F.col("content_type") != "small-text").groupBy("result_id", "content_type")
         .agg(F.sum("before").alias("before"), F.min("pos").alias("first_pos")))
    best = t.groupBy("result_id").agg(
        F.max_by("content_type", F.struct("before", (-F.col("first_pos")).alias("p"))).alias("dominant_type"))
    ids = r.select("result_id").distinct()
    return ids.join(best, "result_id", "left").select(
        "result_id", F.coalesce("dominant_type", F.lit("small-text")).alias("dominant_type"))


@query("ocr_lookup", oracle=f"""
WITH img AS (SELECT * FROM {D.SHOT_BLOCKS} s WHERE type = 'image'),
o AS (SELECT sha256(i.data) AS image_key, CASE WHEN CAST(regexp_extract(i.result_id, '(\\d+)$', 1) AS BIGINT) % 7 = 0
             THEN ' ok ' ELSE b.text END AS text, b.item_id % 5 = 3 AS failed
      FROM img i JOIN benchmark b ON CAST(regexp_extract(i.result_id, '(\\d+)$', 1) AS BIGINT) = b.item_id),
j AS (SELECT img.result_id, img.pos, o.text AS ocr, coalesce(o.failed, false) AS failed,
             coalesce(json_extract_string(img.args, '$.filename'), json_extract_string(img.args, '$.path')) AS path
      FROM img LEFT JOIN o ON sha256(img.data) = o.image_key)
SELECT result_id, pos,
  CASE WHEN failed THEN 'image' WHEN ocr IS NOT NULL AND length(regexp_replace(ocr, {D.s(C.JS_WS)}, '', 'g')) >= {C.MIN_MEANINGFUL_CHARS}
       THEN 'text' WHEN path IS NOT NULL THEN 'text' ELSE 'image' END AS out_type,
  CASE WHEN failed THEN NULL WHEN ocr IS NOT NULL AND length(regexp_replace(ocr, {D.s(C.JS_WS)}, '', 'g')) >= {C.MIN_MEANINGFUL_CHARS}
       THEN '[OCR extracted from screenshot — may contain errors]' || chr(10) || {D.js_trim('ocr')}
       WHEN ocr IS NULL AND path IS NOT NULL
       THEN '[Screenshot saved to: ' || path || ' — OCR could not extract text. No text found on image.]'
       WHEN path IS NOT NULL THEN '[Screenshot saved to: ' || path || ' — no text found on image.]' END AS out_text
FROM j""")
def ocr_lookup(spark, sf_dir):
    img = FX.screenshot_blocks(spark, sf_dir).filter("type = 'image'")
    out = RS.ocr_replace(img, ocr_table(spark, sf_dir))
    return out.select("result_id", "pos", "out_type",
                      F.when(F.col("out_type") == "text", F.col("out_text")).alias("out_text"))


@query("reduce_results", oracle=f"""
WITH {REDUCED}
SELECT result_id, tool, rule_strategy, action, n_blocks, n_errors, total_before AS before,
       CASE WHEN action = 'compressed' THEN total_after ELSE total_before END AS after, dominant_type, summary FROM results""")
def reduce_results(spark, sf_dir):
    """R1 end to end over every kind of result (the flagship query)."""
    summary, _ = _reduced(spark, sf_dir)
    return summary.select("result_id", "tool", "rule_strategy", "action", "n_blocks", "n_errors",
                          F.col("total_before").alias("before"), F.col("final_after").alias("after"),
                          "dominant_type", "summary")


@query("growth_guard", oracle=f"""
WITH {REDUCED}
SELECT result_id, rule_strategy, total_before, total_after, total_after > total_before * {C.GROWTH_LIMIT}::DOUBLE AS grew, action FROM results WHERE compressible""")
def growth_guard(spark, sf_dir):
    """A4: results whose reduction would grow them (or change nothing) keep their blocks."""
    summary, _ = _reduced(spark, sf_dir)
    return summary.filter("compressible").select(
        "result_id", "rule_strategy", "total_before", "total_after",
        F.expr(f"total_after > total_before * {C.GROWTH_LIMIT}D").alias("grew"), "action")


@query("summary_line", oracle=f"""
WITH {REDUCED}
SELECT result_id, summary FROM results WHERE action = 'compressed'""")
def summary_line(spark, sf_dir):
    """A14 + U1: the summary block of every changed result."""
    summary, _ = _reduced(spark, sf_dir)
    return summary.filter("action = 'compressed'").select("result_id", "summary")


@query("result_output", oracle=f"""
WITH {REDUCED},
final AS (
  SELECT result_id, pos, CASE WHEN action = 'compressed' THEN out_type ELSE type END AS t, CASE WHEN action = 'compressed' THEN out_text ELSE text END AS x,
         CASE WHEN action = 'compressed' THEN out_data ELSE data END AS d, CASE WHEN action = 'compressed' THEN out_mime ELSE mime_type END AS m
  FROM sized JOIN (SELECT result_id, action FROM results) USING (result_id)
  UNION ALL SELECT result_id, -1, 'text', summary, NULL, NULL FROM results WHERE action = 'compressed')
SELECT result_id, count(*) AS n_blocks, CAST(sum(length(coalesce(x, '')) + length(coalesce(d, ''))) AS BIGINT) AS content_chars,
       CAST(sum(('0x' || substr(md5(concat_ws('|', pos, t, coalesce(x, ''), coalesce(d, ''), coalesce(m, ''))), 1, 8))::BIGINT) AS BIGINT) AS content_hash,
       min(pos) AS first_pos FROM final GROUP BY result_id""")
def result_output(spark, sf_dir):
    """Final blocks in result order (summary block first); per result the block
    count, characters and a position-aware hash (partial aggregation)."""
    _, reduced = _reduced(spark, sf_dir)
    # the reduced blocks feed the summary and the output, which feeds its range sampling, too: each is written once
    # and deleted when the next is there, so that disk holds one text of a block and its shuffle
    reduced = RS.stage_reduced(reduced)
    final = stage(RS.final_blocks(reduced, RS.result_summary(reduced, CFG)), "final-blocks")
    unstage(reduced)
    nested = RS.nest(final)
    none = F.lit("")
    whole = F.concat_ws("|", "pos", "type", F.coalesce("text", none), F.coalesce("data", none), F.coalesce("mime_type", none))
    return nested.groupBy("result_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length(F.coalesce("text", none)) + F.length(F.coalesce("data", none))).alias("content_chars"),
        F.sum(F.conv(F.substring(F.md5(whole), 1, 8), 16, 10).cast("bigint")).alias("content_hash"), F.min("pos").alias("first_pos"))
