"""The stored search index: same answers as scoring everything, far fewer pairs, no unbounded block."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from condensa.functions import exprs as E
from condensa.operators import bm25 as BM
from condensa.operators import search_index as SI


def _corpus(n):
    """Every document shares frequent words with every query; rare words tell them apart."""
    r = random.Random(7)
    docs = []
    for i in range(n):
        words = [f"common{r.randrange(8)}" for _ in range(r.randrange(3, 60))] + [f"rare{r.randrange(300)}" for _ in range(4)]
        docs.append((i, " ".join(words)))
    docs += [(n, None), (n + 1, ""), (n + 2, docs[0][1]), (n + 3, docs[0][1]), (n + 4, "the of"), (n + 5, "common1 " * 5000)]
    asked = [(q, " ".join([f"common{r.randrange(8)}" for _ in range(6)] + [f"rare{r.randrange(300)}" for _ in range(3)])) for q in range(12)]
    asked += [(100, "rare1"), (101, "nowhere"), (102, None), (103, docs[0][1]), (104, "common1 common1 common2")]
    return docs, asked


@pytest.fixture(scope="module")
def tables(spark):
    docs, asked = _corpus(800)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("term", F.lit("x")).withColumn("score", F.lit(1))
    return d, spark.createDataFrame(asked, "item_id bigint, text string").withColumn("rank", F.lit(0))


def _rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark, tables):
    path = tempfile.mkdtemp(prefix="condensa-index-", dir="/tmp")
    SI.build(tables[0], "doc_id", "text", path)
    return path


@pytest.mark.parametrize("top_k", [10, None])
def test_equals_full_scoring(spark, tables, index, top_k):
    docs, asked = tables
    got = _rows(SI.search(spark, index, asked, "item_id", "text", top_k))
    assert got and got == _rows(BM.search(docs, "doc_id", "text", asked, "item_id", "text", top_k))


def test_scores_few_of_the_pairs_that_share_a_term(spark, tables, index):
    rows = SI.asked_levels(spark, index, tables[1], "item_id", "text")
    sharing, scored = (SI.survivors(spark, index, rows, k).count() for k in (None, 10))
    assert scored * 5 < sharing, (scored, sharing)


def test_blocks_of_a_frequent_term_are_bounded(spark, tables, monkeypatch):
    monkeypatch.setattr(SI, "PIECE_ROWS", 32)
    path = tempfile.mkdtemp(prefix="condensa-index-", dir="/tmp")
    SI.build(tables[0], "doc_id", "text", path)
    assert spark.read.parquet(f"{path}/postings").agg(F.max("n")).first()[0] <= 3 * 32


def test_without_broadcasts_and_with_a_weak_floor(spark, tables, index, monkeypatch):
    monkeypatch.setattr(SI, "FIRST_POSTINGS", 20)
    monkeypatch.setattr(SI, "SLACK", 0.9)
    monkeypatch.setattr(SI, "MAX_BROADCAST_ENTRIES", 0)
    monkeypatch.setattr(BM, "MAX_BROADCAST_TERMS", 0)
    docs, asked = tables
    assert _rows(SI.search(spark, index, asked, "item_id", "text")) == _rows(BM.search(docs, "doc_id", "text", asked, "item_id", "text"))


def test_repeated_ids_and_empty_tables(spark, tables):
    path = tempfile.mkdtemp(prefix="condensa-index-", dir="/tmp")
    twice = spark.createDataFrame([(1, "alpha beta"), (1, "alpha gamma delta"), (2, "beta"), (None, "alpha")], "doc_id bigint, text string")
    SI.build(twice, "doc_id", "text", path)
    asked = spark.createDataFrame([(1, "alpha beta")], "item_id bigint, text string")
    assert [r[:3] for r in _rows(SI.search(spark, path, asked, "item_id", "text"))] == [(1, 1, 1), (1, 2, 2)]
    assert SI.search(spark, path, asked.where("false"), "item_id", "text").count() == 0
    SI.build(twice.where("false"), "doc_id", "text", path)  # replaces the index
    assert SI.search(spark, path, asked, "item_id", "text").count() == 0


def test_few_more_pairs_than_results_get_exact_scores(spark, tables, index, monkeypatch):
    """The greatest parts found are a floor too, so that what is scored exactly grows with the results, not the documents."""
    monkeypatch.setattr(SI, "FIRST_POSTINGS", 20)
    rows = SI.asked_levels(spark, index, tables[1], "item_id", "text")
    results = SI.search(spark, index, tables[1], "item_id", "text").count()
    assert SI.survivors(spark, index, rows, 10).count() <= 1.5 * results


def test_rows_of_one_id_with_other_lengths_are_one_document(spark):
    path = tempfile.mkdtemp(prefix="condensa-index-", dir="/tmp")
    docs = [(1, "alpha beta"), (1, "alpha gamma delta"), (1, "alpha gamma delta"), (2, "alpha")]
    SI.build(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", path)
    found = {(r.doc_id, r.term): r.impact for r in spark.read.parquet(f"{path}/documents").collect()}
    norm = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2.25))
    want = {(1, "alpha"): norm(1, 2) + norm(2, 3), (1, "beta"): norm(1, 2), (1, "gamma"): norm(2, 3), (1, "delta"): norm(2, 3), (2, "alpha"): norm(1, 1)}
    assert found == pytest.approx(want)
    assert spark.read.parquet(f"{path}/postings").where("term = 'alpha'").agg(F.sum("n")).first()[0] == 2


def test_terms_of_odd_texts(spark):
    texts = ["", None, " ", "a", "The quick-brown fox_1, THE Foxés naïve", "x\ty zz\U0001f600yy--..-", "\x0bone\x1ctwo\r\nthree ", "İstanbul K9 ſs"]
    old = "split(regexp_replace(lower(coalesce(t, '')), '[^\\\\w\\\\s-]', ' '), '\\\\s+')"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    stop = E.tokenize("t")[E.tokenize("t").index("w -> "):]
    for r in df.select(F.expr(E.tokenize("t")).alias("new"), F.expr(f"filter({old}, {stop}").alias("old")).collect():
        assert r.new == r.old
