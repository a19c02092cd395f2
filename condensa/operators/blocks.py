"""Block-level projections: size, content type and default strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import exprs as E


def annotate(blocks: DataFrame, cfg: Config) -> DataFrame:
    """Add ``before`` (block tokens), ``content_type`` and ``default_strategy``.

    Narrow projection: no shuffle, stays in whole-stage codegen.
    """
    return (blocks
            .withColumn("before", F.expr(E.block_tokens("type", "text", "data")))
            .withColumn("content_type", F.expr(E.classify("type", "text", cfg.text_threshold)))
            .withColumn("default_strategy",
                        F.expr(E.strategy_for("content_type", cfg.image_ocr, cfg.json_collapse))))


def inventory(annotated: DataFrame) -> DataFrame:
    """Blocks and tokens per source and content type (partial aggregation map-side)."""
    return (annotated.groupBy("source", "content_type")
            .agg(F.count(F.lit(1)).alias("n_blocks"),
                 F.countDistinct("result_id").alias("n_results"),
                 F.sum("before").alias("tokens_before"),
                 F.max("before").alias("max_tokens")))
