"""Exact medians of groups of any size (A5) by counting digits; no group's values meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGIT_BITS = 16  # so a window holds at most 65,536 rows, whatever the group's size


def medians(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """(keys, ``out``): the median of an integer column per group, the mean of the two middle values if even.

    Values count from the least of all, and are read as digits of DIGIT_BITS bits, highest first. Each round
    counts rows per (group, digits so far, next digit), map-side first, and prefix sums over the digits tell
    in which one the wanted ranks lie; the next round counts only there. NULL values take no part, a group
    of NULLs has no row, a NULL key is a group like any other. Values may span at most 2^63.
    """
    df = df.select(F.struct(*keys).alias("_k"), F.col(value).cast("bigint").alias("_v")).filter("_v IS NOT NULL")
    low, high = df.agg(F.min("_v"), F.max("_v")).first()
    if low is None:
        return df.select("_k.*", F.lit(None).cast("double").alias(out)).limit(0)
    rounds = max(1, -(-(high - low).bit_length() // DIGIT_BITS))
    df = df.withColumn("_v", F.col("_v") - F.lit(low))
    # One row for each wanted rank (from 0): the digits known so far and the rank among the rows that have them.
    want = (df.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
            .select("_k", F.explode(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2"))).alias("_rank"))
            .select("_k", "_rank", F.lit(0).cast("bigint").alias("_head")))
    for left in range(rounds - 1, -1, -1):
        shift = left * DIGIT_BITS
        cut = df.withColumn("_next", F.shiftright("_v", shift)).withColumn("_head", F.shiftright("_next", DIGIT_BITS))
        if left < rounds - 1:
            cut = cut.join(want.select("_k", "_head").distinct(), ["_k", "_head"], "left_semi")
        counts = cut.groupBy("_k", "_head", "_next").agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("_k", "_head").orderBy("_next"))
        counts = counts.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("_n"))
        want = (want.join(counts, ["_k", "_head"]).filter("_rank >= _start AND _rank < _end")
                .select("_k", (F.col("_rank") - F.col("_start")).alias("_rank"), F.col("_next").alias("_head")))
    return want.groupBy("_k").agg((F.avg("_head") + F.lit(low)).alias(out)).select("_k.*", out)
