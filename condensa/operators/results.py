"""Result-level job (R1, R2) with totals (A1), per-type stats (A2), dominant type (A3),
growth guard (A4), summary line (A14), summary block (U1), OCR lookup (J5) and the
re-nesting sink (S9).

Plan shape: every block is reduced in one narrow projection where each reducer only
sees the blocks routed to it (other rows carry NULL through it). Only image blocks
leave that path, for the equi-join with the extracted-text table. Per-result flags and
statistics are partial aggregations (map-side first), so a result with very many
blocks does not concentrate on one reducer; what is joined back is one row per result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import Config
from ..functions import exprs as E
from ..functions import keywords as K
from . import blocks as B
from . import jsonops as J
from . import routing as R
from . import snapshot as SN
from . import text as T
from ..session import stage, unstage
from ..sources.tables import on_cluster, spread

SUMMARY_TAG = "condensed"


# J5 ------------------------------------------------------------------------------------
def ocr_replace(images: DataFrame, ocr_text: DataFrame) -> DataFrame:
    """Replace image blocks by their extracted text.

    ``ocr_text(image_key, text[, error])``: extracted text per image (sha-256 of the payload), or why
    the extraction failed. Missing or low-quality text with a saved path gives a reference
    sentence; without a path the image stays, and so it does after a failure (R2).
    Adds out_type, out_text, out_data, out_mime and failure.
    """
    why = F.col("error") if "error" in ocr_text.columns else F.lit(None).cast("string")
    o = ocr_text.select(F.col("image_key").alias("_ik"), F.col("text").alias("_ocr"), why.alias("failure"))
    df = images.withColumn("_ik", F.sha2("data", 256)).join(o, "_ik", "left").drop("_ik")
    path = F.expr("coalesce(get_json_object(args, '$.filename'), get_json_object(args, '$.path'))")
    df = df.withColumn("_path", path)
    meaningful = F.expr(E.meaningful_chars("_ocr"))
    ok = F.col("_ocr").isNotNull() & (meaningful >= C.MIN_MEANINGFUL_CHARS)
    text = (F.when(ok, F.concat(F.lit("[OCR extracted from screenshot — may contain errors]\n"),
                                F.expr(E.js_trim("_ocr"))))
            .when(F.col("_ocr").isNull() & F.col("_path").isNotNull(),
                  F.concat(F.lit("[Screenshot saved to: "), F.col("_path"),
                           F.lit(" — OCR could not extract text. No text found on image.]")))
            .when(F.col("_path").isNotNull(),
                  F.concat(F.lit("[Screenshot saved to: "), F.col("_path"), F.lit(" — no text found on image.]"))))
    replaced = text.isNotNull() & F.col("failure").isNull()
    return (df.withColumn("out_type", F.when(replaced, F.lit("text")).otherwise(F.col("type")))
              .withColumn("out_text", F.when(replaced, text).otherwise(F.col("text")))
              .withColumn("out_data", F.when(replaced, F.lit(None).cast("string")).otherwise(F.col("data")))
              .withColumn("out_mime", F.when(replaced, F.lit(None).cast("string")).otherwise(F.col("mime_type")))
              .drop("_ocr", "_path"))


# Per-block reduction -------------------------------------------------------------------
def reduce_blocks(routed: DataFrame, cfg: Config, ocr_text: DataFrame | None = None) -> DataFrame:
    """Apply the effective strategy to every block of every compressible result.

    Adds out_type/out_text/out_data/out_mime, ``after``, ``error`` and ``failure`` (R2: a block whose reducer
    fails stays as it is, and says why). Skipped results and dry runs keep their blocks.
    """
    eff = F.col("effective_strategy")
    is_text = (F.col("type") == "text") & (F.coalesce(F.col("text"), F.lit("")) != "")
    run = F.lit(not cfg.dry_run)
    # Split once by reducer, right after routing, so each heavy reducer only ever
    # evaluates the rows routed to it.
    branch = (F.when(run & (eff == "json-collapse") & is_text, F.lit("json"))
              .when(run & (eff == "ocr") & (F.col("type") == "image")
                    & (F.coalesce(F.col("data"), F.lit("")) != "") & F.lit(ocr_text is not None), F.lit("ocr"))
              .otherwise(F.lit("native")))
    df = routed.withColumn("_branch", branch)
    no_failure = F.lit(None).cast("string")
    # native branch: truncate (C2) and snapshot outline (D5-D9) as column expressions
    nat = df.filter("_branch = 'native'")
    nat = nat.withColumn("_trunc_in", F.when(run & (eff == "truncate") & is_text, F.col("text")))
    nat = nat.withColumn("_q", F.when(F.col("_trunc_in").isNotNull(), F.expr(
        E.tokenize(K.synthetic_query("short_name", "args", ["args"])))))
    nat = T.reduce_long_text(nat, "_trunc_in", "_q", cfg, out_col="_trunc_out")
    nat = nat.drop("head", "middle", "tail", "total_tokens", "target_tokens", "middle_tokens", "middle_target",
                   "compressed_middle", "final_middle_tokens", "first_pass_tokens")
    nat = nat.withColumn("_dom_out", F.when(run & (eff == "dom-cleanup") & is_text,
                                            F.expr(SN.outline_expr("text"))))
    new_text = F.coalesce(F.col("_trunc_out"), F.col("_dom_out"), F.col("text"))
    nat = (nat.withColumn("out_type", F.col("type"))
              .withColumn("out_text", F.when(F.col("type") == "text", new_text).otherwise(F.col("text")))
              .withColumn("out_data", F.col("data")).withColumn("out_mime", F.col("mime_type"))
              .withColumn("failure", no_failure)
              .drop("_trunc_in", "_q", "_trunc_out", "_dom_out"))
    # json branch (K7, K5, K4)
    js = J.reduce_json(df.filter("_branch = 'json'"), "text", "_json_red", "failure")
    js = (js.withColumn("out_type", F.col("type"))
            .withColumn("out_text", F.col("_json_red"))
            .withColumn("out_data", F.col("data")).withColumn("out_mime", F.col("mime_type"))
            .drop("_json_red"))
    df = nat.unionByName(js)
    if ocr_text is not None:
        images = ocr_replace(routed.withColumn("_branch", branch).filter("_branch = 'ocr'"), ocr_text)
        df = df.unionByName(images)
    df = df.drop("_branch").withColumn("error", F.col("failure").isNotNull())
    return df.withColumn("after", F.expr(B_TOKENS_OUT))


B_TOKENS_OUT = E.block_tokens("out_type", "out_text", "out_data")


# A1-A4, A14 ----------------------------------------------------------------------------
def type_stats(reduced: DataFrame) -> DataFrame:
    """(result_id, content_type, count, before, after, strategy, first_pos); errors left out."""
    return (reduced.filter(F.col("compressible") & ~F.col("error"))
            .groupBy("result_id", "content_type")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("before").alias("before"), F.sum("after").alias("after"),
                 F.min_by("effective_strategy", "pos").alias("strategy"), F.min("pos").alias("first_pos")))


def _ratio(after: str, before: str) -> str:
    return f"IF({before} > 0, {E.js_round(f'(1 - {after} / {before}) * 100')}, 0)"


def summary_expr() -> str:
    """One-line summary from totals and the ordered per-type stats array ``types``."""
    part = (f"concat(t.content_type, ': ', CAST(t.n AS STRING), ' block', IF(t.n > 1, 's', ''), ', ', "
            f"{E.fmt_int('t.before')}, '→', {E.fmt_int('t.after')}, ' tokens (-', "
            f"CAST({_ratio('t.after', 't.before')} AS STRING), '%)')")
    parts = (f"concat(transform(filter(types, t -> t.content_type <> 'small-text' AND t.before <> t.after), "
             f"t -> {part}), transform(filter(types, t -> t.content_type = 'small-text' AND t.n > 0), "
             f"t -> concat(CAST(t.n AS STRING), ' small block', IF(t.n > 1, 's', ''), ' unchanged')))")
    return (f"concat('[{SUMMARY_TAG}: ', {E.fmt_int('total_before')}, '→', {E.fmt_int('total_after')}, "
            f"' tokens (-', CAST({_ratio('total_after', 'total_before')} AS STRING), '%)', "
            f"IF(size({parts}) > 0, concat(' | ', array_join({parts}, '; ')), ''), ']')")


def result_summary(reduced: DataFrame, cfg: Config) -> DataFrame:
    """One row per result: totals, guard decision, dominant type, action, summary line.

    One pass over the reduced blocks: a (result, content type) aggregation, then a
    per-result aggregation of those few rows (at most one per content type).
    """
    ok = F.col("compressible") & ~F.col("error")
    per_type = (reduced.groupBy("result_id", "content_type")
                .agg(F.first("short_name").alias("tool"), F.first("args").alias("args"), F.first("rule_strategy").alias("rule_strategy"),
                     F.first("compressible").alias("compressible"), F.count(F.lit(1)).alias("n_all"),
                     F.sum("before").alias("before_all"), F.sum("after").alias("after_all"),
                     F.sum(F.col("error").cast("int")).alias("err"),
                     F.count(F.when(ok, 1)).alias("n"), F.sum(F.when(ok, F.col("before"))).alias("before"),
                     F.sum(F.when(ok, F.col("after"))).alias("after"),
                     F.min_by(F.when(ok, F.col("effective_strategy")), F.when(ok, F.col("pos"))).alias("strategy"),
                     F.min(F.when(ok, F.col("pos"))).alias("first_pos")))
    df = (per_type.groupBy("result_id")
          .agg(F.first("tool").alias("tool"), F.first("args").alias("args"), F.first("rule_strategy").alias("rule_strategy"),
               F.first("compressible").alias("compressible"), F.sum("n_all").alias("n_blocks"),
               F.sum("before_all").alias("total_before"), F.sum("after_all").alias("total_after"),
               F.sum("err").alias("n_errors"),
               F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct(
                   "first_pos", "content_type", "n", "before", "after", "strategy")))).alias("types")))
    grew = F.expr(f"total_after > total_before * {C.GROWTH_LIMIT}D AND rule_strategy = 'auto'")
    same = F.col("total_after") == F.col("total_before")
    action = (F.when(~F.col("compressible") | F.lit(cfg.dry_run), F.lit("no-change"))
              .when(grew | same, F.lit("no-change")).otherwise(F.lit("compressed")))
    dominant = F.expr(
        "coalesce(try_element_at(transform(array_sort(filter(types, t -> t.content_type <> 'small-text'), "
        "(l, r) -> CASE WHEN l.before > r.before THEN -1 WHEN l.before < r.before THEN 1 "
        "WHEN l.first_pos < r.first_pos THEN -1 WHEN l.first_pos > r.first_pos THEN 1 ELSE 0 END), "
        "t -> t.content_type), 1), 'small-text')")
    return (df.withColumn("action", action)
              .withColumn("dominant_type", dominant)
              .withColumn("summary", F.when(F.col("action") == "compressed", F.expr(summary_expr())))
              .withColumn("final_after", F.when(F.col("action") == "compressed", F.col("total_after"))
                          .otherwise(F.col("total_before"))))


def reduce_results(blocks: DataFrame, cfg: Config, ocr_text: DataFrame | None = None,
                   materialize: bool = False):
    """R1 end to end. Returns (per-result summary, reduced blocks).

    The blocks feed the per-result flags and their join, and the routed blocks three reducer branches;
    with ``materialize`` both are written once below the cluster's checkpoint folder instead of being derived and
    shuffled again for every reader, and the first are deleted once the second are written. On one machine the
    routed ones are dealt out evenly: the join leaves partitions sized by bytes, which are too few for reducers
    that spend seconds on a megabyte. On executors the join's own partitions stand, without a second shuffle of all text.
    """
    annotated = B.annotate(blocks, cfg)
    if materialize:
        annotated = stage(annotated, "annotated-blocks")
    routed = R.route(annotated, cfg)
    if materialize:
        routed = stage(routed if on_cluster(blocks.sparkSession) else spread(routed, "result_id"), "routed-blocks")
        unstage(annotated)
    reduced = reduce_blocks(routed, cfg, ocr_text)
    return result_summary(reduced, cfg), reduced


def stage_reduced(reduced: DataFrame) -> DataFrame:
    """The reduced blocks, written once below the checkpoint folder; what they were made from is deleted.

    A block that stays as it is (``same``) is not written a second time as its own output, whose columns are null.
    """
    columns = {"out_type": "type", "out_text": "text", "out_data": "data", "out_mime": "mime_type"}
    same = reduce(lambda a, b: a & b, (F.col(out).eqNullSafe(F.col(old)) for out, old in columns.items()))
    packed = reduced.withColumn("same", same)
    packed = stage(packed.withColumns({out: F.when(~F.col("same"), F.col(out)) for out in columns}), "reduced-blocks")
    unstage(reduced)
    return packed


# U1 + S9 -------------------------------------------------------------------------------
def final_blocks(reduced: DataFrame, summary: DataFrame) -> DataFrame:
    """Blocks as emitted: changed results get their reduced blocks behind a summary block
    at pos -1; every other result keeps its original blocks. ``reduced`` may come from ``stage_reduced``."""
    s = summary.select("result_id", "action", "summary")
    df = reduced.join(s, "result_id")
    changed = F.col("action") == "compressed"
    new = changed & ~F.col("same") if "same" in reduced.columns else changed
    body = df.select("result_id", "pos",
                     F.when(new, F.col("out_type")).otherwise(F.col("type")).alias("type"),
                     F.when(new, F.col("out_text")).otherwise(F.col("text")).alias("text"),
                     F.when(new, F.col("out_data")).otherwise(F.col("data")).alias("data"),
                     F.when(new, F.col("out_mime")).otherwise(F.col("mime_type")).alias("mime_type"))
    head = s.filter(changed).select("result_id", F.lit(-1).alias("pos"), F.lit("text").alias("type"),
                                    F.col("summary").alias("text"), F.lit(None).cast("string").alias("data"),
                                    F.lit(None).cast("string").alias("mime_type"))
    return head.unionByName(body)


def nest(blocks: DataFrame) -> DataFrame:
    """The output blocks of every result as JSON, in (result, position) order.

    Rows are range-partitioned on (result_id, pos) and sorted within partitions, so the
    output files list each result's blocks in order while a result with very many
    blocks is split across tasks instead of being gathered into one row.
    """
    block = F.to_json(F.struct(F.col("type"), F.col("text"), F.col("data"), F.col("mime_type").alias("mimeType")))
    return (blocks.select("result_id", "pos", "type", "text", "data", "mime_type", block.alias("block"))
            .repartitionByRange("result_id", "pos").sortWithinPartitions("result_id", "pos"))

