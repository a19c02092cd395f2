"""What is broadcast from the driver stays below bounds on counted rows, whatever the planner's estimate is."""

import numpy as np
from pyspark.sql import functions as F

from condensa.llm import common, components, jaccard


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_small_beyond_its_bound(spark, monkeypatch):
    small = common.stage(spark.range(40).select("id", (F.col("id") * 3).alias("value")), "test-small")
    large = common.stage(spark.range(500).select((F.col("id") % 60).alias("id"), F.col("id").alias("row")), "test-large")
    few = common.join_small(large, small, ["id"], F.col("row"), "left")
    assert "BroadcastHashJoin" in plan(few)
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 39)
    many = common.join_small(large, small, ["id"], F.col("row"), "left")
    assert "Broadcast" not in plan(many)  # sixteen times the rows, but a small file
    assert sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, few.collect()), key=str)
    assert "Broadcast" not in plan(common.join_small(large, small, ["id"], F.col("row")))


def test_near_blocks_beyond_their_bound(spark, monkeypatch):
    rows = [(i, 3, np.array(sorted([i % 4, 100 + i % 7, 200 + i]), "<u8").tobytes()) for i in range(30)]
    reps = common.stage(spark.createDataFrame(rows, "rid bigint, n bigint, columns binary"), "test-reps")
    few = jaccard._near_blocks(reps, 50)
    monkeypatch.setattr(jaccard, "BROADCAST_BLOCKS", 29, raising=False)
    many = jaccard._near_blocks(reps, 50)
    assert plan(few).count("BroadcastHashJoin") == 2
    assert plan(many).count("BroadcastHashJoin") == 1  # the ranges' sums
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_components_of_more_edges_than_a_task_joins(spark, monkeypatch):
    monkeypatch.setattr(components, "FOREST_EDGES", 20)
    plans, stage = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df, name: plans.append(plan(df)) or stage(df, name))
    edges = [(i, i + 5) for i in range(100)] + [(1000 + i, 1000) for i in range(1, 40)]
    found = components.components(common.stage(spark.createDataFrame(edges, "a bigint, b bigint"), "test-edges"))
    want = [(i, i % 5) for i in range(5, 105)] + [(1000 + i, 1000) for i in range(1, 40)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)
