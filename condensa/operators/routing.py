"""Routing: rule match (J1), per-result gates (P7, P8), image guard (P10), dry run."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import exprs as E

# Patterns of which no literal is known meet every name, so their number is bounded; other rules are found by
# a key and may be many more.
MAX_BROADCAST_RULES = 10_000
GRAM = 3
LAST = 2**31 - 1


def needed_literal(pattern: str) -> str | None:
    """The longest text that any match of the regular expression holds, or None if that is not plain to see.

    Groups, alternatives, flags and unusual escapes give None; classes, anchors, dots and what a quantifier
    makes optional end a run of plain characters.
    """
    runs, run, i = [], "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        char = None
        if c == "\\":
            if i == len(pattern) or (pattern[i].isalnum() and pattern[i] not in "dDwWsSbB"):
                return None
            char, i = (None if pattern[i].isalnum() else pattern[i]), i + 1
        elif c == "[":
            end = pattern.find("]", i + 1)
            if end < 0 or any(x in pattern[i:end] for x in "[&\\"):
                return None
            i = end + 1
        elif c in "()|{}]*+?":
            return None
        elif c not in ".^$":
            char = c
        more = pattern[i:i + 1]
        if more in ("*", "?", "{"):
            char = None
        if char is not None:
            run += char
        if char is None or more == "+":
            runs, run = [*runs, run], ""
        if more and more in "*?+{":
            i = pattern.find("}", i) + 1 if more == "{" else i + 1
            if i == 0:
                return None
            i += pattern[i:i + 1] in ("?", "+")  # lazy or possessive
    return max([*runs, run], key=len) or None


def _grams(text: str) -> set[str]:
    return {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}


def rule_index(rules) -> tuple[list, list, list]:
    """Rules by how a name finds them: (name, position, strategy), (gram, position, pattern, strategy) and, for
    patterns without a literal of GRAM characters, (position, pattern, strategy).

    A pattern is filed under the gram of its literal that the fewest patterns have. Nothing after a rule that
    matches every name can be first, so it is left out.
    """
    patterns = [(i, r) for i, r in enumerate(rules) if r.tool_name_pattern]
    every = min((i for i, r in patterns if r.tool_name_pattern in (".*", "^.*")), default=LAST)
    exact = [(r.tool_name, i, r.strategy) for i, r in enumerate(rules) if r.tool_name and i <= every]
    known = {i: _grams(needed_literal(r.tool_name_pattern) or "") for i, r in patterns if i <= every}
    held = Counter(g for grams in known.values() for g in grams)
    keyed, rest = [], []
    for i, r in patterns:
        if i <= every and known[i]:
            keyed.append((min(known[i], key=lambda g: (held[g], g)), i, r.tool_name_pattern, r.strategy))
        elif i <= every:
            rest.append((i, r.tool_name_pattern, r.strategy))
    return exact, keyed, rest


def match_rules(names: DataFrame, name_col: str, rules) -> DataFrame:
    """First matching rule by position wins; no match gives ``auto``. One row per distinct name.

    Distinct names (a partial aggregation) meet rules by equal keys: the whole name for exact rules, the
    name's grams for patterns, which are then tried. Only patterns without a usable literal, such as ``.*``,
    are tried on every name; that list is broadcast after its length is checked.
    """
    spark = names.sparkSession
    exact, keyed, rest = rule_index(list(rules))
    if len(rest) > MAX_BROADCAST_RULES:
        raise ValueError(f"more than {MAX_BROADCAST_RULES} patterns without a literal")
    distinct = names.select(F.col(name_col).alias("_name")).distinct()
    found = [distinct.select("_name", F.lit(LAST).alias("rule_pos"), F.lit("auto").alias("rule_strategy"))]
    if exact:
        by_name = spark.createDataFrame(exact, "_name string, rule_pos int, rule_strategy string")
        found.append(distinct.join(by_name, "_name"))
    if keyed:
        by_gram = spark.createDataFrame(keyed, "_gram string, rule_pos int, rule_pattern string, rule_strategy string")
        starts = f"sequence(1, greatest(length(_name) - {GRAM - 1}, 0))"
        grams = distinct.filter(F.length("_name") >= GRAM).select("_name", F.explode(F.expr(
            f"array_distinct(transform({starts}, i -> substring(_name, i, {GRAM})))")).alias("_gram"))
        found.append(grams.join(by_gram, "_gram").filter("_name rlike rule_pattern"))
    if rest:
        wild = spark.createDataFrame(rest, "rule_pos int, rule_pattern string, rule_strategy string")
        found.append(distinct.join(F.broadcast(wild), F.expr("_name rlike rule_pattern")))
    cols = ["_name", "rule_pos", "rule_strategy"]
    union = reduce(DataFrame.unionAll, [f.select(*cols) for f in found])
    return union.groupBy(F.col("_name").alias(name_col)).agg(F.min_by("rule_strategy", "rule_pos").alias("strategy"))


def with_rule_strategy(df: DataFrame, name_col: str, rules) -> DataFrame:
    """Same answer as ``match_rules`` folded into one CASE: no join at all."""
    return df.withColumn("strategy", F.expr(E.rule_strategy(name_col, rules)))


def result_flags(annotated: DataFrame, cfg: Config) -> DataFrame:
    """Per-result gates: compressible (P7) and has-image-path.

    Aggregated per result (partial aggregation, so a result with very many blocks does
    not land on one task) and returned as one row per result for an equi-join back.
    """
    compressible = (F.when(F.col("type") == "image", F.lit(cfg.image_ocr))
                    .otherwise(F.col("content_type") != "small-text"))
    return (annotated.groupBy("result_id")
            .agg(F.bool_or(compressible).alias("compressible"),
                 F.bool_or(F.expr(E.text_has_image_path("type", "text"))).alias("has_path")))


def route(annotated: DataFrame, cfg: Config) -> DataFrame:
    """Decide the effective strategy of every block of every compressible result.

    Adds ``short_name``, ``rule_strategy``, ``compressible``, ``has_path``,
    ``screenshot_tool``, ``block_strategy`` (rule strategy after the image guard) and
    ``effective_strategy`` (``auto`` resolved by content type). Skipped results keep
    ``compressible = false`` and strategy ``skip``.
    """
    flags = result_flags(annotated, cfg)
    df = annotated.join(flags, "result_id", "left")
    if cfg.server_tools_only:
        df = df.withColumn("compressible", F.col("compressible") & F.expr(E.is_mcp_tool("tool_name")))
    df = df.withColumn("short_name", F.expr(E.short_tool_name("tool_name")))
    df = with_rule_strategy(df, "short_name", cfg.rules).withColumnRenamed("strategy", "rule_strategy")
    df = df.withColumn("screenshot_tool", F.expr(E.is_screenshot_tool("short_name")))
    guard = ((F.col("rule_strategy") == "auto") & (F.col("type") == "image")
             & ~F.col("has_path") & ~F.col("screenshot_tool"))
    df = df.withColumn("block_strategy", F.when(guard, F.lit("passthrough")).otherwise(F.col("rule_strategy")))
    eff = F.when(F.col("block_strategy") == "auto", F.col("default_strategy")).otherwise(F.col("block_strategy"))
    return df.withColumn("effective_strategy",
                         F.when(F.col("compressible"), eff).otherwise(F.lit("skip")))
