"""Mixing sources to target weights (native DataFrame operators only).

Method: every row gets a hash-random key; rows are range-sorted by it within their
source; distributed prefix sums of the sizes give each row its place; each source is cut
at its exact budget, after as many whole epochs as the budget needs.

* The key is 48 bits of md5 of the row id and a seed, so that reruns agree. Being uniform,
  its top bits are range boundaries: a source of n rows is cut into ceil(n / BUCKET_ROWS)
  key ranges, so that a source with a third of all rows is sorted by many tasks.
* Budgets: a source's weight is 5, 2 or 1 (its place by code point, null last, repeating).
  The sum of all sizes is shared by weight; a target stops at MAX_EPOCHS times its
  source's size and the excess is reshared by weight, until none is above. The fixed
  point is min(3 * size, level * weight) for one level, which integer sums in the order of
  size / weight find exactly.
* The row at the cut is taken in part, so that a source's taken words are the whole
  number below its target.

Nulls: a null text has size 0; a null source is a source of its own, the last; a null id
hashes like an empty one. Repeated rows are rows of their own. An empty table gives no rows. Columns are
read by name and extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_PATTERN, join_small, null_key, prefix_scan, stage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
KEY_BITS = 48
#: Rows of one key range within a source, and the most ranges of one source.
BUCKET_ROWS = 1_000
MAX_BUCKETS = 1 << 14


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def random_key(row_id: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit("|" + seed)))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source_key, source_size, n_rows, target, epochs, rest: one row per source.

    Both orders over the sources (by code point, by size over weight) are distributed
    prefix scans; the driver sees three sums only.
    """
    per_source = sized.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    ranked = prefix_scan(per_source, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, "mix-sources")
    scale = 1
    for w in set(weights):
        scale *= w
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    weighted = (ranked.withColumn("weight", weight.cast("long"))
                # scale is a common multiple of the weights: size / weight stays whole
                .withColumn("ratio", F.col("source_size").cast("decimal(38,0)") * F.expr(f"cast({scale} div weight as decimal(10,0))")))
    ordered = prefix_scan(weighted, [F.col("ratio").asc(), F.col("source_key").asc()],
                          {"size_upto": F.col("source_size"), "weight_upto": F.col("weight")}, "mix-ratios")
    ordered = stage(ordered, "mix-levels")
    total, all_weight = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        total, all_weight = 0, 0
    dec = lambda c: c.cast("decimal(38,0)")
    # With the level at this source's own cap, do the targets fit into the total?
    full = (dec(F.col("size_upto")) * max_epochs * F.col("weight")
            + dec(F.col("source_size")) * max_epochs * (F.lit(all_weight) - F.col("weight_upto"))
            <= F.lit(total).cast("decimal(38,0)") * F.col("weight"))
    levelled = ordered.withColumn("full", full)
    full_size, full_weight = levelled.where("full").agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    open_total, open_weight = total - max_epochs * full_size, all_weight - full_weight
    level = (F.col("weight") * F.lit(open_total)).cast("double") / F.lit(float(max(open_weight, 1)))
    target = F.when(F.col("full"), (F.col("source_size") * max_epochs).cast("double")).otherwise(level)
    split = (levelled.withColumn("target", target).withColumn("budget", F.floor("target").cast("long"))
             .withColumn("epochs", F.expr(f"if(source_size > 0, least(budget div source_size, {max_epochs}), 0)").cast("long"))
             .withColumn("rest", F.expr(f"if(epochs >= {max_epochs}, 0, budget - epochs * source_size)").cast("long")))
    return stage(split.select("source_key", "source_size", "n_rows", "target", "epochs", "rest"), "mix-targets")


def _mixed(docs: DataFrame, row_id: str, source: str, text: str, seed: str, payload: list[str]) -> DataFrame:
    """row_id, source, p_<payload>..., size, source_size, target, epochs, taken."""
    sized = stage(docs.select(F.col(row_id).alias("row_id"), F.col(source).cast("string").alias("source"),
                              null_key(F.col(source)).alias("source_key"), word_count(F.col(text)).alias("size"),
                              random_key(F.col(row_id), seed).alias("key"), F.xxhash64(F.col(text)).alias("tie"),
                              *[F.col(c).alias(f"p_{c}") for c in payload]), "mix-sizes")
    targets = source_targets(sized)
    buckets = F.least(F.lit(MAX_BUCKETS).cast("long"), F.ceil(F.col("n_rows") / F.lit(BUCKET_ROWS)))
    placed = (join_small(sized, targets, ["source_key"], F.col("key"))
              .withColumn("bucket", F.shiftright(F.col("key") * buckets, KEY_BITS).cast("int")))
    sums = placed.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("base"))
    inside = (Window.partitionBy("source_key", "bucket").orderBy("key", "row_id", "tie", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = placed.join(bases, ["source_key", "bucket"]).withColumn("upto", F.col("base") + F.sum("size").over(inside))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("upto") + F.col("size")))
    return cut.withColumn("taken", F.col("epochs") * F.col("size") + part)


def mix(docs: DataFrame, row_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED) -> DataFrame:
    """row_id, source, size, source_size, target, taken (words, repeats counted). Only
    narrow rows are shuffled."""
    return _mixed(docs, row_id, source, text, seed, []).select(
        F.col("row_id").alias(row_id), F.col("source").alias(source), "size", "source_size", "target", "taken")


def materialise(docs: DataFrame, row_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED) -> DataFrame:
    """The mixed rows themselves: each row repeated as its source's epochs need, and the
    row at the cut shortened to the words taken. Columns as in ``docs``.

    Only the last copy of a row at the cut is rewritten; it keeps its own white space.
    """
    taken = _mixed(docs, row_id, source, text, seed, docs.columns).where("taken > 0")
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    pieces = F.regexp_extract_all(F.col(f"p_{text}"), F.lit(rf"[{SPACE_CLASS}]*{WORD_PATTERN}"), F.lit(0))
    short = F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")
    cut = copies.withColumn(f"p_{text}", F.when(words < F.col("size"), short).otherwise(F.col(f"p_{text}")))
    return cut.select(*[F.col(f"p_{c}").alias(c) for c in docs.columns])
