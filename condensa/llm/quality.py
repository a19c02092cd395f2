"""Quality rules with adaptive thresholds (native DataFrame operators only).

Method: each document gets integer features; each (language, source) group keeps a
mergeable quantile sketch of each feature; limits are read from the sketches instead of
being fixed numbers, and are joined back to the documents, which they filter.

The sketch is a log-bucket histogram over integers: values below 2^SUB_BITS have a bucket
each, larger ones share one with values that agree in the leading SUB_BITS bits, so a
quantile is off by less than 2^(1-SUB_BITS) of its value. Two sketches merge by adding bucket
counts; the result does not depend on the order of merging, so reruns agree.

Limits: with quartiles q1, q2, q3 of a feature in a group, the upper limit is
q2 + SPREAD * (q3 - q2) + slack and the lower one q2 - SPREAD * (q2 - q1) - slack. They
follow the group's own middle half, so junk of up to a quarter of a group does not widen
them, and a group with no junk loses nothing. A group under MIN_GROUP documents uses the merged sketch of its
language, and a language under MIN_GROUP that of the whole table; documents that fail the
base rules are in no sketch.

Features of documents that pass the base rules:
symbols, repeated words and words equal to the one before per 1000 words, characters per
100 words, capitals per 1000 word characters, repeated lines per 1000 lines with a word.

A null text has no words and fails the base rules. Null language or source is a group of
its own. Repeated rows are rows of their own; an empty table gives no rows; extra columns
are ignored by ``assess`` and kept by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, join_small, null_key, stage

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SUB_BITS = 5
MIN_GROUP = 200
SPREAD = 4
#: feature -> slack around the limits; ``low`` features have a lower limit, too.
FEATURES = {"symbols_pm": 200, "repeats_pm": 250, "chars_pc": 150, "capitals_pm": 300, "dup_lines_pm": 500, "stutter_pm": 300}
LOW = ("chars_pc",)


def _let(value: Column, body) -> Column:
    """Bind a computed value once for a lambda that reads it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    """Words of a text: split at white space, without the empty ends."""
    parts = F.split(text, f"[{SPACE_CLASS}]+")
    return F.filter(parts, lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text.

    A 64-bit hash per window first: if all differ, no window repeats. Only then are the
    windows themselves sorted, so the count is exact whatever the hashes do.
    """
    last = F.size(words) - F.lit(WINDOW - 1)
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    windows = F.transform(F.sequence(F.lit(1), last),
                          lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i")))

    def positions(rows: Column) -> Column:
        same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
        marked = F.transform(rows, lambda r, j: F.when(same(r, F.get(rows, j - 1)) | same(r, F.get(rows, j + 1)), r["i"]))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    exact = _let(_let(F.sort_array(windows), positions), covered)
    some = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(last < 2, F.lit(0).cast("long")).when(some, exact).otherwise(F.lit(0).cast("long"))


def base_features(docs: DataFrame, row_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
                  payload: list[str] | None = None) -> DataFrame:
    """row_id, lang_key, source_key, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_capitals, n_stutter, n_repeat_words, base_failed; payload columns as p_<name>."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(row_id).alias("row_id"), null_key(F.col(lang)).alias("lang_key"), null_key(F.col(source)).alias("source_key"),
                       body.alias("body"), *[F.col(c).alias(f"p_{c}") for c in payload or []])
    without = lambda chars: F.length("body") - F.length(F.translate(F.col("body"), chars, ""))
    lines = F.filter(F.split("body", "\n"), lambda line: line.rlike(f"[^{SPACE_CLASS}]"))
    counted = rows.withColumns({
        "words": _words(F.col("body")),
        "line_counts": _let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup"))),
        "word_chars": (F.length("body") - without(" \t\n\x0b\x0c\r")).cast("long"),
        "n_symbols": without("#*$%&|<>").cast("long"),
        "n_capitals": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
    })
    done = counted.select("row_id", "lang_key", "source_key", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_capitals",
                          F.col("line_counts.n").alias("n_lines"), F.col("line_counts.dup").alias("n_dup_lines"),
                          _let(F.col("words"), lambda a: F.size(F.filter(a, lambda w, i: F.coalesce(w == F.get(a, i - 1), F.lit(False))))).cast("long").alias("n_stutter"),
                          _repeat_words(F.col("words")).alias("n_repeat_words"), *[f"p_{c}" for c in payload or []])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return done.withColumn("base_failed", failed)


def with_rates(features: DataFrame) -> DataFrame:
    """The integer rates that the sketches hold (null for documents that fail the base rules)."""
    rate = lambda times, part, whole: F.expr(f"if(base_failed, null, {times} * {part} div greatest({whole}, 1))")
    return features.withColumns({"symbols_pm": rate(1000, "n_symbols", "n_words"), "repeats_pm": rate(1000, "n_repeat_words", "n_words"),
                                 "chars_pc": rate(100, "word_chars", "n_words"), "capitals_pm": rate(1000, "n_capitals", "word_chars"),
                                 "dup_lines_pm": rate(1000, "n_dup_lines", "n_lines"),
                                 "stutter_pm": rate(1000, "n_stutter", "n_words")})


def bucket_floor(value: Column) -> Column:
    """The least value of the sketch bucket that ``value`` (>= 0) falls into."""
    drop = F.greatest(F.length(F.bin(value)) - SUB_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(rates: DataFrame) -> DataFrame:
    """lang_key, source_key, feature, bucket, n: the sketch of every group, one row a bucket."""
    long = (rates.where(~F.col("base_failed"))
            .select("lang_key", "source_key", F.posexplode(F.array(*[F.col(f) for f in FEATURES])).alias("feature", "value")))
    return (long.select("lang_key", "source_key", "feature", bucket_floor(F.col("value")).alias("bucket"))
            .groupBy("lang_key", "source_key", "feature", "bucket").agg(F.count("*").alias("n")))


def _quartiles(merged: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """keys, feature, <tag>_n, <tag>_q1..3 read from merged sketches (one small window per sketch)."""
    group = [*keys, "feature"]
    all_rows = Window.partitionBy(*group)
    upto = all_rows.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = merged.withColumns({"_n": F.sum("n").over(all_rows), "_upto": F.sum("n").over(upto)})
    at = lambda k: F.min(F.when(4 * F.col("_upto") >= k * F.col("_n"), F.col("bucket"))).alias(f"{tag}_q{k}")
    return cum.groupBy(*group).agg(F.max("_n").alias(f"{tag}_n"), at(1), at(2), at(3))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang_key, source_key and an array of (low, high) in the order of FEATURES."""
    by_lang = sketch.groupBy("lang_key", "feature", "bucket").agg(F.sum("n").alias("n"))
    overall = sketch.groupBy("feature", "bucket").agg(F.sum("n").alias("n"))
    groups = (_quartiles(sketch, ["lang_key", "source_key"], "g").join(_quartiles(by_lang, ["lang_key"], "l"), ["lang_key", "feature"])
              .join(F.broadcast(_quartiles(overall, [], "t")), ["feature"]))  # a row per feature
    pick = lambda k: F.when(F.col("g_n") >= MIN_GROUP, F.col(f"g_q{k}")).when(F.col("l_n") >= MIN_GROUP, F.col(f"l_q{k}")).otherwise(F.col(f"t_q{k}"))
    slack = F.element_at(F.array(*[F.lit(v) for v in FEATURES.values()]), F.col("feature") + 1)
    has_low = F.element_at(F.array(*[F.lit(f in LOW) for f in FEATURES]), F.col("feature") + 1)
    limits = groups.select("lang_key", "source_key", "feature",
                           F.when(has_low, pick(2) - SPREAD * (pick(2) - pick(1)) - slack).alias("low"),
                           (pick(2) + SPREAD * (pick(3) - pick(2)) + slack).alias("high"))
    return limits.groupBy("lang_key", "source_key").agg(F.sort_array(F.collect_list(F.struct("feature", "low", "high"))).alias("limits"))


def assess(docs: DataFrame, row_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
           payload: list[str] | None = None) -> DataFrame:
    """base_features, the rates, and ``kept``."""
    rates = stage(with_rates(base_features(docs, row_id, text, lang, source, payload)), "quality-features")
    limits = stage(thresholds(sketches(rates)), "quality-limits")
    judged = join_small(rates, limits, ["lang_key", "source_key"], F.col("row_id"), "left")
    outside = F.lit(False)
    for i, f in enumerate(FEATURES):
        at = F.get(F.col("limits"), F.lit(i))
        outside = outside | F.coalesce(F.col(f) > at["high"], F.lit(False)) | F.coalesce(F.col(f) < at["low"], F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~outside).drop("limits")


def keep_good(docs: DataFrame, row_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that are kept, with their own columns."""
    judged = assess(docs, row_id, text, lang, source, payload=docs.columns)
    return judged.where("kept").select(*[F.col(f"p_{c}").alias(c) for c in docs.columns])
