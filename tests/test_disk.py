"""Staged tables and shuffle files go as soon as no later job reads them; rows stay the same."""

import json
import os
import time
from types import SimpleNamespace

from pyspark.sql import functions as F

from condensa.config import Config
from condensa.operators import results as RS
from condensa.session import ensure_checkpoint_dir, stage
from condensa.sources.tables import on_cluster

TEXT = "A sentence about a topic that goes on. " * 900
ROWS = [("r1", 0, "t", TEXT), ("r1", 1, "t", '[{"a": 1, "b": 2}]'), ("r2", 0, "t", "small"), ("r2", 0, "t", "small"), ("r4", 0, None, None),
        ("r3", 0, "mcp__db__query", json.dumps([{"id": i, "name": f"User {i}", "bio": "Loves data " * 4} for i in range(500)])), (None, 0, "t", TEXT)]


def blocks(spark):
    return spark.createDataFrame(ROWS, "result_id string, pos int, tool_name string, text string").selectExpr(
        "result_id", "'s' AS source", "pos", "tool_name", "'{}' AS args", "'text' AS type", "text",
        "CAST(NULL AS STRING) AS data", "CAST(NULL AS STRING) AS mime_type")


def staged(spark):
    """Folders of staged tables, by name."""
    top = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/condensa"
    return {f"{run}/{name}" for run in (os.listdir(top) if os.path.isdir(top) else []) for name in os.listdir(f"{top}/{run}")}


def names(folders):
    return sorted(x.partition("/")[2] for x in folders)


def test_each_staged_table_goes_when_the_next_is_written(spark):
    summary, lazy = RS.reduce_results(blocks(spark), Config())
    want = sorted(map(str, RS.final_blocks(lazy, summary).collect()))
    before = staged(spark)
    _, reduced = RS.reduce_results(blocks(spark), Config(), materialize=True)
    assert names(staged(spark) - before) == ["routed-blocks"]
    packed = RS.stage_reduced(reduced)
    assert names(staged(spark) - before) == ["reduced-blocks"]
    assert sorted(map(str, RS.final_blocks(packed, RS.result_summary(packed, Config())).collect())) == want
    once = {(r.result_id, r.pos): (r.same, r.out_text is None) for r in packed.collect()}
    assert once["r2", 0] == (True, True) and once["r3", 0] == (False, False)


def test_shuffle_files_of_a_staged_table_go(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = shuffled()
    found = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test-counts")
    left = None
    for _ in range(50):  # they are removed in the background
        left = shuffled() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert found.agg(F.sum("count")).first()[0] == 1000


def test_executors_of_their_own():
    of = lambda master: on_cluster(SimpleNamespace(sparkContext=SimpleNamespace(master=master)))
    assert not of("local") and not of("local[4]") and not of("local[*, 2]")
    assert of("local-cluster[3,2,3000]") and of("yarn") and of("spark://host:7077")
