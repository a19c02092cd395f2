"""Connected components of an edge table.

Each task joins the edges that it holds, FOREST_EDGES at most, into stars (every node with the least
node that it reaches there). Where the edges fill more than one task, large and small stars
alternate with that step until nothing changes: only minima are aggregated per node (no neighbour
lists are collected), so a hub with any number of neighbours is summed up on the map side.
Each step is written to the shared folder and read back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Edges that a task joins at once.
FOREST_EDGES = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of the edges that are not the least themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # roots are hooked below smaller ones
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _forest(edges: DataFrame) -> DataFrame:
    """u, v (v the least of u's component within its task) for edges u, v."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            u, v = stars(*(np.concatenate([np.asarray(batch.column(i)) for batch in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= FOREST_EDGES:
                yield done()
                held, size = [], 0
        if held:
            yield done()

    return edges.mapInArrow(joined, "u bigint, v bigint")


def _least(edges: DataFrame) -> DataFrame:
    """u -> the least of u and its neighbours v."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label: the nodes of ``edges`` (a, b: bigint, a staged table) and the least node of their component;
    that least node itself is not listed. The result is a staged table."""
    now = edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    state = None
    while True:
        tasks = -(-now.count() // FOREST_EDGES)
        now = stage(_forest(now.repartition(max(1, tasks))), name)
        if tasks <= 1:  # all edges met in one task
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour is joined with the least one (the hint: edges compress well, and
        # the planner would broadcast very many of them)
        large = both.join(_least(both).hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, name)
        # small star: the smaller neighbours and the node itself are joined with the least one
        small = large.join(_least(large).hint("merge"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stage(small, name)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
