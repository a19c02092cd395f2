import re

from conftest import one
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from condensa.config import Config, DEFAULT_RULES, Rule, load_config
from condensa.functions import exprs as E
from condensa.operators import routing as R


def test_token_estimate(spark):
    assert one(spark, E.token_estimate("t"), t="Hello world") == 3
    assert one(spark, E.token_estimate("t"), t="") == 0


def _cls(spark, type_, text, thr=100_000):
    return one(spark, E.classify("ty", "t", thr), ty=type_, t=text)


def test_classify(spark):
    assert _cls(spark, "image", None) == "image"
    assert _cls(spark, "text", '- button "OK" [ref=42]') == "dom-snapshot"
    assert _cls(spark, "text", "- role: navigation") == "dom-snapshot"
    assert _cls(spark, "text", "[" + "x" * 3000 + "]") == "large-json"
    assert _cls(spark, "text", "x" * 500_000) == "large-text"
    assert _cls(spark, "text", "small") == "small-text"
    assert _cls(spark, "text", "x" * 40_000) == "small-text"


def test_rules_first_match_wins(spark):
    names = spark.createDataFrame([("browser_snapshot",), ("some_random_tool",), ("purchase",)], "n string")
    got = {r["n"]: r["strategy"] for r in R.match_rules(names, "n", DEFAULT_RULES).collect()}
    assert got == {"browser_snapshot": "dom-cleanup", "some_random_tool": "auto", "purchase": "auto"}
    rules = (Rule("truncate", tool_name_pattern="ur"), Rule("json-collapse", tool_name="purchase"))
    got = {r["n"]: r["strategy"] for r in R.match_rules(names, "n", rules).collect()}
    assert got["purchase"] == "truncate" and got["some_random_tool"] == "auto"
    # the CASE form gives the same answers
    case = {r["n"]: r["strategy"] for r in R.with_rule_strategy(names, "n", rules).collect()}
    assert case == got


def test_needed_literal():
    want = {"browser_.*": "browser_", "^get_\\w+list$": "get_", "a+bc": "bc", "ab+c": "ab", "abc?de": "ab", "a\\.b_cd{2}": "a.b_c",
            "[xyz]files": "files", "(a|b)files": None, "(?i)files": None, "\\x41bc": None, ".*": None, "x|files": None,
            "\\Qab.c\\E": None, "a]b": None, "[a[bc]]files": None, "lazy*?end": "laz", "": None}
    assert {p: R.needed_literal(p) for p in want} == want


PIECES = st.sampled_from(["ab", "c", "list", ".", ".*", "a+", "b?", "[ab]", "\\w", "\\.", "x{2}", "^", "$", "d*?"])


@given(st.lists(PIECES, max_size=6).map("".join), st.text("abcdlistx.", max_size=12))
def test_every_match_holds_the_literal(pattern, name):
    found = re.search(pattern, name)
    assert not found or (R.needed_literal(pattern) or "") in found.group()


def test_many_rules_meet_names_by_key(spark):
    kinds = ["truncate", "json-collapse", "dom-cleanup", "ocr"]
    rules = [Rule(kinds[i % 4], tool_name=f"tool_{i}") if i % 2 else Rule(kinds[i % 4], tool_name_pattern=f"^get_{i % 613}x.*item{i}$")
             for i in range(5000)]
    names = [f"tool_{i}" for i in range(0, 6000, 7)] + [f"get_{i % 613}x_item{i}" for i in range(0, 6000, 4)] + ["", "zz", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = R.match_rules(df, "n", rules)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()

    plain = [(r.tool_name, r.tool_name_pattern and re.compile(r.tool_name_pattern), r.strategy) for r in rules]

    def first(name):
        return next((s for exact, p, s in plain if name is not None and (name == exact or (p and p.search(name)))), "auto")
    assert {r["n"]: r["strategy"] for r in got.collect()} == {n: first(n) for n in names}
    # Behind a rule that matches every name, no rule counts; before it, patterns without a literal do.
    some = [Rule("ocr", tool_name_pattern="z|q"), Rule("truncate", tool_name_pattern=".*"), Rule("dom-cleanup", tool_name="tool_7")]
    got = {r["n"]: r["strategy"] for r in R.match_rules(df, "n", some).collect()}
    assert got["zz"] == "ocr" and got["tool_7"] == "truncate" and got[None] == "auto"


def test_config_overlay():
    assert load_config(None).text_threshold == 100_000
    assert load_config('{"threshold": 500}').text_threshold == 500
    assert load_config('{"minBlockTokens": 700}').text_threshold == 700
    assert load_config('{"threshold": 1, "minBlockTokens": 2}').text_threshold == 1
    assert load_config('{"textCompressionThreshold": 9, "threshold": 1}').text_threshold == 9
    assert load_config("not json") == Config()
    cfg = load_config('{"rules": [{"toolName": "x", "strategy": "ocr"}]}')
    assert len(cfg.rules) == 1 and cfg.rules[0].strategy == "ocr"


def test_short_name(spark):
    assert one(spark, E.short_tool_name("n"), n="mcp__srv__a__b") == "a__b"
    assert one(spark, E.short_tool_name("n"), n="mcp__srv") == "mcp__srv"
    assert one(spark, E.short_tool_name("n"), n="Read") == "Read"
