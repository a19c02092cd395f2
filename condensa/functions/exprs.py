"""Column expressions, written as Spark SQL text.

Each builder takes SQL expressions (usually column names) and returns SQL text, so the
same expression can go into ``selectExpr``, ``F.expr`` or ``spark.sql``. All of them stay
inside Catalyst (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def sql_str(s: str) -> str:
    """A Spark SQL string literal (raw-string form, so no escape processing)."""
    if "'" not in s:
        return "r'" + s + "'"
    if '"' not in s:
        return 'r"' + s + '"'
    # Both quote kinds: build with concat of pieces.
    parts = s.split("'")
    return "concat(" + ", \"'\", ".join(sql_str(p) for p in parts) + ")"


def sql_array(values) -> str:
    return "array(" + ", ".join(sql_str(v) for v in values) + ")"


def col(sql: str) -> Column:
    return F.expr(sql)


def let(value: str, var: str, body: str) -> str:
    """Bind ``value`` to the lambda variable ``var`` for ``body`` (evaluated once per row).

    Catalyst inlines a computed column into every place that reads it, including the
    body of a lambda, where it would then be recomputed per element. Reading a
    computed array only through a bound variable keeps the work linear. The variable is that of a fold's last step, over
    nothing: ``transform`` would copy what the body gives, once more with each binding around it.
    """
    return f"aggregate(array(), {value}, (_acc, _none) -> _acc, {var} -> {body})"


# P1 ---------------------------------------------------------------------------
def token_estimate(text: str) -> str:
    """ceil(utf-8 bytes / 4); NULL text counts as 0."""
    return f"CAST(ceil(octet_length(coalesce({text}, '')) / 4) AS BIGINT)"


# P2 ---------------------------------------------------------------------------
def block_tokens(type_: str, text: str, data: str) -> str:
    return (
        f"CASE WHEN {type_} = 'image' AND coalesce({data}, '') <> '' "
        f"THEN CAST(ceil(length({data}) / 4) AS BIGINT) "
        f"WHEN coalesce({text}, '') <> '' THEN {token_estimate(text)} ELSE CAST(0 AS BIGINT) END"
    )


# P4 ---------------------------------------------------------------------------
def has_dom_signal(text: str) -> str:
    return "(" + " OR ".join(f"contains(coalesce({text}, ''), {sql_str(s)})" for s in C.DOM_SIGNALS) + ")"


# P5 ---------------------------------------------------------------------------
def json_looking(text: str) -> str:
    return f"(coalesce({text}, '') rlike {sql_str('^' + C.JS_WS + '*[{\\[]')})"


def js_trim(text: str) -> str:
    """JavaScript String.trim: strips the whole Unicode whitespace set."""
    return f"regexp_replace({text}, {sql_str('^' + C.JS_WS + '+|' + C.JS_WS + '+$')}, '')"


# P3 ---------------------------------------------------------------------------
def classify(type_: str, text: str, threshold: int) -> str:
    tok = token_estimate(text)
    js = json_looking(text)
    return (
        f"CASE WHEN {type_} = 'image' THEN 'image' "
        f"WHEN {has_dom_signal(text)} THEN 'dom-snapshot' "
        f"WHEN {tok} > {int(threshold)} THEN IF({js}, 'large-json', 'large-text') "
        f"WHEN {tok} > {C.JSON_MIN_TOKENS} AND {js} THEN 'large-json' "
        f"ELSE 'small-text' END"
    )


# P6 ---------------------------------------------------------------------------
def strategy_for(content_type: str, image_ocr: bool, json_collapse: bool) -> str:
    img = "'ocr'" if image_ocr else "'passthrough'"
    js = "'json-collapse'" if json_collapse else "'passthrough'"
    return (
        f"CASE {content_type} WHEN 'image' THEN {img} WHEN 'dom-snapshot' THEN 'dom-cleanup' "
        f"WHEN 'large-json' THEN {js} WHEN 'large-text' THEN 'truncate' ELSE 'passthrough' END"
    )


# P9 ---------------------------------------------------------------------------
def is_screenshot_tool(name: str) -> str:
    return "(" + " OR ".join(f"contains({name}, {sql_str(t)})" for t in C.SCREENSHOT_TOOLS) + ")"


# P8 (per block; aggregated per result by the caller) --------------------------
def text_has_image_path(type_: str, text: str) -> str:
    return f"({type_} = 'text' AND coalesce({text}, '') <> '' AND {text} rlike {sql_str(C.FILE_PATH_PATTERN)})"


# P12 --------------------------------------------------------------------------
def is_mcp_tool(name: str) -> str:
    return f"startswith({name}, 'mcp__')"


def short_tool_name(name: str) -> str:
    """Parts from the third ``__`` part on, rejoined; non-MCP names unchanged."""
    parts = f"split({name}, '__')"
    return (
        f"CASE WHEN {is_mcp_tool(name)} AND size({parts}) >= 3 "
        f"THEN array_join(slice({parts}, 3, size({parts})), '__') ELSE {name} END"
    )


# J1 as an expression: first matching rule by position wins -----------------
def rule_strategy(name: str, rules) -> str:
    """Fold an ordered rule list into one CASE (no join, no shuffle)."""
    whens = []
    for r in rules:
        conds = []
        if r.tool_name:
            conds.append(f"{name} = {sql_str(r.tool_name)}")
        if r.tool_name_pattern:
            conds.append(f"{name} rlike {sql_str(r.tool_name_pattern)}")
        if conds:
            whens.append(f"WHEN {' OR '.join(conds)} THEN {sql_str(r.strategy)}")
    if not whens:
        return "'auto'"
    return "CASE " + " ".join(whens) + " ELSE 'auto' END"


# P13 --------------------------------------------------------------------------
def meaningful_chars(text: str) -> str:
    return f"length(regexp_replace(coalesce({text}, ''), {sql_str(C.JS_WS)}, ''))"


# X1 ---------------------------------------------------------------------------
def tokenize(text: str) -> str:
    """Lower-case, non-word characters to space, split on whitespace, drop short and stop words.

    One split on runs of what is neither a word character nor a hyphen leaves the same words, at a tenth
    of the time of a replacement of each such character.
    """
    stop = ", ".join(sql_str(w) for w in C.STOP_WORDS)  # a literal list is tested by hash
    return (
        f"filter(split(lower(coalesce({text}, '')), '[^\\\\w-]+'), "
        f"w -> length(w) > 1 AND w NOT IN ({stop}))"
    )


def fmt_int(x: str) -> str:
    """Thousands separators, like toLocaleString for integers."""
    return f"format_number({x}, 0)"


def js_round(x: str) -> str:
    """Math.round: halves go toward +infinity."""
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"
