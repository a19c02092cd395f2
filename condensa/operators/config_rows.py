"""Config resolution over a table of user config documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C

# Keys that feed the text threshold, in the order they are looked at.
THRESHOLD_KEYS = ["textCompressionThreshold", "threshold", "minBlockTokens"]


def resolve_threshold(df: DataFrame, doc_col: str, flag_col: str | None = None,
                      default: int = C.DEFAULT_TEXT_THRESHOLD) -> DataFrame:
    """Effective text threshold per row: flag > file (first present key) > default.

    Invalid JSON or a non-object document falls back to the defaults. Adds
    ``text_threshold`` and ``origin`` ('flag' | 'file' | 'default').
    """
    keys = F.json_object_keys(F.col(doc_col))
    from_file = None
    for k in reversed(THRESHOLD_KEYS):
        val = F.get_json_object(F.col(doc_col), f"$.{k}").cast("bigint")
        from_file = F.when(F.array_contains(keys, k), val) if from_file is None \
            else F.when(F.array_contains(keys, k), val).otherwise(from_file)
    present = F.exists(keys, lambda k: k.isin(*THRESHOLD_KEYS))
    flag = F.col(flag_col) if flag_col else F.lit(None).cast("bigint")
    return (df.withColumn("text_threshold", F.coalesce(flag, from_file, F.lit(default).cast("bigint")))
              .withColumn("origin", F.when(flag.isNotNull(), "flag")
                          .when(F.coalesce(present, F.lit(False)), "file").otherwise("default")))
