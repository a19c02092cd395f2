"""Events and reports (U2, A5, A15, S6, P14); the log they are kept in is ``event_log``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as E
from .selection import medians


def reduction_text(before: str, after: str) -> str:
    """'(1 - after/before) * 100' with one decimal and a percent sign; NULL when before is 0."""
    return f"IF({before} = 0, NULL, concat(format_string('%.1f', (1 - {after} / {before}) * 100), '%'))"


def empty_events(empty: DataFrame, tool_col: str = "tool_name", args_col: str = "args") -> DataFrame:
    """One event per empty response (rows of ``normalise.empty_responses``), like ``events_from_results``."""
    null = lambda kind: F.lit(None).cast(kind)
    zero = F.lit(0).cast("bigint")
    return empty.select(F.current_timestamp().alias("ts"), F.expr(E.short_tool_name(tool_col)).alias("tool"), null("string").alias("result_id"),
                        F.lit("skip").alias("strategy"), zero.alias("before"), zero.alias("after"), F.lit("0%").alias("reduction"),
                        null("string").alias("content_type"), F.lit("empty-response").alias("action"), F.lit(0).alias("errors"),
                        F.expr(args_summary_expr(args_col)).alias("tool_input"))


def events_from_results(summary: DataFrame) -> DataFrame:
    """One event per result — compressed, or no-change for skipped/unchanged ones."""
    compressed = F.col("action") == "compressed"
    return summary.select(
        F.current_timestamp().alias("ts"), F.col("tool"), "result_id",
        F.when(compressed, F.col("rule_strategy")).otherwise(F.lit("skip")).alias("strategy"),
        F.col("total_before").alias("before"),
        F.when(compressed, F.col("total_after")).otherwise(F.col("total_before")).alias("after"),
        F.when(compressed, F.expr(reduction_text("total_before", "total_after"))).otherwise(F.lit("0%"))
        .alias("reduction"),
        F.when(compressed, F.col("dominant_type")).alias("content_type"), "action",
        F.col("n_errors").cast("int").alias("errors"), F.expr(args_summary_expr("args")).alias("tool_input"))


def latency(rows: DataFrame, key: str, ms: str) -> DataFrame:
    """A5: (key, is_total, n, avg_ms, median_ms) for each value of ``key`` and over all rows (is_total = 1)."""
    both = rows.select(F.col(key), F.col(ms).alias("_ms"), F.explode(F.array(F.lit(0), F.lit(1))).alias("is_total"))
    both = both.withColumn(key, F.when(F.col("is_total") == 0, F.col(key)))
    mean = both.groupBy(key, "is_total").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_ms"), 3).alias("avg_ms"))
    mid = medians(both, [key, "is_total"], "_ms", "median_ms").select(
        F.col(key).alias("_key"), F.col("is_total").alias("_total"), "median_ms")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("is_total") == F.col("_total"))
    return mean.join(mid, same, "left").drop("_key", "_total")


def savings(events: DataFrame) -> DataFrame:
    """A5: events, tokens, reduction and errors per content type and over all (is_total = 1)."""
    return (events.rollup("content_type")
            .agg(F.grouping_id().cast("int").alias("is_total"), F.count(F.lit(1)).alias("events"),
                 F.sum("before").alias("before"), F.sum("after").alias("after"), F.sum("errors").alias("errors"))
            .withColumn("reduction_pct", F.round(F.expr("(1 - after / before) * 100"), 3)))


def savings_report(events: DataFrame) -> DataFrame:
    """A5 in full: ``savings`` with the mean and median of the measured durations."""
    took = latency(events, "content_type", "duration_ms").select(
        F.col("content_type").alias("_type"), F.col("is_total").alias("_total"), "avg_ms", "median_ms")
    same = F.col("content_type").eqNullSafe(F.col("_type")) & (F.col("is_total") == F.col("_total"))
    return savings(events).join(took, same, "left").drop("_type", "_total")


def outcome_counts(events: DataFrame) -> DataFrame:
    """Events per tool and action."""
    return events.groupBy("tool", "action").agg(F.count(F.lit(1)).alias("n"))


def previews(blocks: DataFrame, id_col: str = "result_id") -> DataFrame:
    """First 300 characters of each text block, joined by a separator line, cut at 500.

    Each block after the first adds at least the 5-character separator, so 102 blocks are over
    500 characters whatever they hold, and what follows is cut anyway: a per-result group
    limit keeps that many rows of a result before the shuffle.
    """
    cap = C.PREVIEW_MAX_CHARS // len(C.PREVIEW_SEPARATOR) + 2
    t = blocks.filter(F.col("type") == "text")
    w = Window.partitionBy(id_col).orderBy("pos")
    t = t.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap)
    sep = C.PREVIEW_SEPARATOR.replace("\n", "\\n")
    agg = t.groupBy(id_col).agg(F.expr(
        f"listagg(coalesce(substring(text, 1, {C.PREVIEW_BLOCK_CHARS}), ''), '{sep}') WITHIN GROUP (ORDER BY pos)")
        .alias("_p"))
    return agg.select(id_col, F.expr(
        f"IF(_p = '', NULL, IF(length(_p) > {C.PREVIEW_MAX_CHARS}, concat(substring(_p, 1, {C.PREVIEW_MAX_CHARS}), '...'), _p))")
        .alias("preview"))


def args_summary_expr(args: str) -> str:
    """String arguments cut at 200 + '...', numbers and booleans kept, others dropped.

    Returned as 'key=value' pairs joined by '; ' (key order kept)."""
    m = f"from_json({args}, 'map<string,variant>')"
    v = "variant_get(e.value, '$', 'string')"
    val = (f"CASE WHEN schema_of_variant(e.value) = 'STRING' THEN IF(length({v}) > {C.LOG_ARG_MAX}, "
           f"concat(substring({v}, 1, {C.LOG_ARG_MAX}), '...'), {v}) "
           f"WHEN schema_of_variant(e.value) = 'BOOLEAN' OR schema_of_variant(e.value) IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT', 'DOUBLE', 'FLOAT') "
           f"OR startswith(schema_of_variant(e.value), 'DECIMAL') THEN {v} END")
    return (f"array_join(filter(transform(map_entries({m}), e -> IF({val} IS NULL, NULL, concat(e.key, '=', {val}))), "
            f"x -> x IS NOT NULL), '; ')")
