"""Plan-shape checks: the properties the design relies on at scale."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranking_folds_chunks_once(spark):
    plan = _plan(entry.queries()["bm25_rank_chunks"](spark, SF))
    # one chunk fold = one regexp_extract_all per separator (4) and one for the hard cut
    assert plan.count("regexp_extract_all") == 5


def test_per_row_jobs_do_not_shuffle(spark):
    for name in ("chunk_text", "reduce_long_text", "snapshot_outline"):
        plan = _plan(entry.queries()[name](spark, SF))
        exchanges = [ln for ln in plan.split("\n") if "Exchange" in ln]
        # only the optional spread of a single-file input (REPARTITION_BY_NUM) may appear
        assert all("REPARTITION_BY_NUM" in ln for ln in exchanges), (name, exchanges)


def test_corpus_search_broadcasts_only_one_row_stats(spark):
    df = entry.queries()["bm25_corpus_search"](spark, SF)
    logical = df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in logical.lower()
    assert "BroadcastNestedLoopJoin" in _plan(df) or "BroadcastExchange" in _plan(df)


def test_pushdown_and_pruning(spark):
    plan = _plan(entry.queries()["truncate_budget"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
