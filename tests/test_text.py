"""Text jobs on own inputs: tokens, ranking, chunks, the budget pick and the reduced text."""

import re
from conftest import one
from pyspark.sql import functions as F

from condensa.config import STOP_WORDS, Config
from condensa.functions import exprs as E
from condensa.functions import keywords as K
from condensa.operators import text as T

PARTS = [
    "Rain fell on the harbour all night and the boats stayed in",
    "The ledger lists every cargo with its weight and its owner",
    "A cargo without an owner is stored in the north shed",
    "Gulls and terns nest on the north cliff above the harbour",
    "Weight of a cargo decides the fee that the owner pays",
]


def test_tokenize(spark):
    assert one(spark, E.tokenize("t"), t="The Ledger, of 12 north-shed cargo: a/b/cc!") == ["ledger", "12", "north-shed", "cargo", "cc"]
    assert one(spark, E.tokenize("t"), t=" ".join(STOP_WORDS)) == []
    assert one(spark, E.tokenize("t"), t=None) == []


def _rank(spark, query):
    df = spark.createDataFrame([(PARTS, query)], "docs array<string>, query string")
    df = T.with_chunk_scores(df.withColumn("q", F.expr(E.tokenize("query"))), "docs", "q", "scores")
    return df.select(F.expr(T.ranked_expr("docs", "scores")).alias("r")).first()["r"]


def test_ranking(spark):
    first = _rank(spark, "owner cargo weight")
    assert {x["idx"] for x in first[:2]} == {1, 4} and first[2]["idx"] == 2
    assert all(x["neg"] < 0 for x in first[:3]) and all(x["neg"] == 0 for x in first[3:])
    assert [x["idx"] for x in _rank(spark, "zebra")] == [0, 1, 2, 3, 4]
    assert [x["idx"] for x in _rank(spark, "")] == [0, 1, 2, 3, 4]


def _chunks(spark, text, target, overlap=50):
    return one(spark, T.chunk_expr("t", target, overlap), t=text)


def test_chunks_cover_the_text(spark):
    text = "\n\n".join(f"Entry {i}. " + " ".join(f"cargo {i}x{k} owner." for k in range(5 + i % 7)) for i in range(60))
    found = _chunks(spark, text, 40, 0)
    assert "".join(found) == text and len(found) > 20
    with_overlap = _chunks(spark, text, 40, 5)
    at = 0
    for c in with_overlap:  # each chunk starts inside or right after the one before
        here = text.find(c, max(0, at - 40))
        assert 0 <= here <= at
        at = max(at, here + len(c))
    assert at == len(text)


def test_chunks_of_unbroken_and_short_text(spark):
    assert _chunks(spark, "Gulls nest", 100) == ["Gulls nest"]
    found = _chunks(spark, "z" * 5000, 100, 0)
    assert found[0] == "z" * 400 and "".join(found) == "z" * 5000


def test_greedy_pick_skips_and_continues(spark):
    ranked = ("array(named_struct('neg', -9.0D, 'idx', 4, 'tokens', 6L), named_struct('neg', -7.0D, 'idx', 1, 'tokens', 7L), "
              "named_struct('neg', -2.0D, 'idx', 0, 'tokens', 4L), named_struct('neg', -1.0D, 'idx', 3, 'tokens', 1L))")
    assert one(spark, T.greedy_pick_expr(ranked, "10"), x="") == [0, 4]


def _reduce(spark, text, args="{}", cfg=Config()):
    df = spark.createDataFrame([(text, args)], "text string, args string")
    df = df.withColumn("q", F.expr(E.tokenize(K.synthetic_query("'read_ledger'", "args", ["args"]))))
    return T.reduce_long_text(df, "text", "q", cfg).first()["reduced"]


def _ledger(n, at=range(0)):
    return "\n".join(f"Row {i}: " + ("harbour tariff of the winter season " if i in at else "grain salt rope tar canvas ") * 4 for i in range(n))


def test_reduced_text_keeps_head_and_tail(spark):
    text = _ledger(4500)
    got = _reduce(spark, text)
    assert len(got) < len(text) and "[... middle compressed" in got
    assert text.startswith(got.split("[... middle")[0].rstrip("\n")) and text.endswith(got[-2000:])
    assert _reduce(spark, "one line") == "one line"


def test_reduced_text_follows_the_arguments(spark):
    got = _reduce(spark, _ledger(4500, range(2300, 2330)), '{"path": "harbour/tariff-winter.txt"}')
    assert sum(f"Row {i}: harbour" in got for i in range(2300, 2330)) >= 25


def test_empty_summary_falls_back(spark):
    text = _ledger(1200, range(600, 610))
    cfg = Config(text_threshold=500, head_tokens=200, tail_tokens=100, chunk_target=64, chunk_overlap=8)
    rows = [(text, "harbour tariff", s) for s in ("", None, "SUMMARY OF IT ALL")]
    df = spark.createDataFrame(rows, "text string, query string, s string").withColumn("q", F.expr(E.tokenize("query")))
    empty, none, given = [r["reduced"] for r in T.reduce_long_text(df, "text", "q", cfg, summaries_col="s").collect()]
    assert empty == none and "harbour tariff" in empty and "SUMMARY" not in empty
    assert given == empty or "SUMMARY OF IT ALL" in given


def test_query_builder(spark):
    def query(name, args, previous=None):
        return one(spark, K.synthetic_query("n", "a", ["p"] if previous is not None else []), n=name, a=args, p=previous or "{}")

    assert query("weigh_cargo", "{}") == "weigh cargo"
    url = query("fetch", '{"url": "https://port.example.org/fees/winter-tariff.html"}')
    assert "port.example.org" in url and "fees" in url
    assert {"ledger", "north"} <= set(query("read_file", '{"path": "north/ledger.csv"}').split())
    assert "openShed" in query("grep", '{"pattern": "openShed", "path": "lib/"}')
    assert "tariff" in query("snapshot", "{}", '{"path": "fees/tariff.md"}')


def test_chunks_of_long_texts_equal_a_plain_fold(spark):
    """Words only, no separators at all, and lines, with characters of several bytes; more than one slice of pieces."""
    words = " ".join(("thion", "é", "wh", "edretha")[i * i % 4] for i in range(3000))
    cases = [words, "é" * 5000, "\n".join(words[i:i + 40] for i in range(0, 12000, 40)), "a. b" * 1500]

    def plain(text, target, overlap):
        size = lambda s: -(-len(s.encode()) // 4)
        pieces = [text]
        for sep in ("\n\n", "\n", ". ", " "):
            pieces = [q for p in pieces for q in (re.findall(f"(?s).*?{re.escape(sep)}|.+", p) if size(p) > target else [p])]
        pieces = [q for p in pieces for q in ([p[i:i + target * 4] for i in range(0, len(p), target * 4)]
                                              if len(p) > target * 6 else [p])]
        chunks, cur = [], ""
        for p in pieces:
            if cur and size(cur + p) > target:
                chunks.append(cur)
                cur = (cur[-overlap * 4:] if overlap else "") + p
            else:
                cur += p
        return chunks + [cur] * bool(cur)
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, text string")
    for target, overlap in ((64, 8), (50, 0)):
        got = {r.i: r.c for r in df.selectExpr("i", f"{T.chunk_expr('text', target, overlap)} AS c").collect()}
        assert got == {i: plain(c, target, overlap) for i, c in enumerate(cases)}
