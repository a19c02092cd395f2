"""Hard negatives by score bounds along a spanning tree of the anchors.

A row's score is its inner product with the anchor. Anchors go in groups; each group has a minimum
spanning tree of its anchors (by distance). Of a block of candidates the root's scores are computed;
for a child c of an anchor p at distance d and a candidate of norm n,

    score(p) - d * n <= score(c) <= score(p) + d * n,

and where the parent's score was not computed, its own bounds take the place of the score. A candidate is
rescored at an anchor only if its bounds overlap the window of scores that can matter there:

1. positives: rows of the anchor's label, scores from the k-th best so far up;
2. negatives: rows of other labels, scores between ``low`` and ``high`` percent of one of the anchor's positive
   scores, and not below the k-th best found in that window.

Plan: groups of GROUP_ROWS anchors times shards of SHARD_ROWS candidates; one task takes one group and
one shard, so memory is bounded and all (anchor, candidate) work is spread. Each pass keeps the best
of each shard, a window the best of these. Nothing depends on how many rows a label has.

Scores are integers (components are whole numbers), exact in doubles below 2^53; bounds get a margin for
rounding. Higher scores come first, equal ones by the smaller id. A negative positive score has an empty
window. Rows with a null label, id or vector, or with a null or non-finite component take no part; vectors of
different lengths are not comparable. Rows with equal ids are rows of their own (an anchor may
be the positive of its twin). An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.shipping import ship

from .common import stage

GROUP_ROWS = 2048
SHARD_ROWS = 16384
#: Candidates whose bounds are held at once.
BLOCK_ROWS = 1024


def quantised(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """row, id, label, dim, v (array<double> of whole numbers) of the rows that take part; row tells them apart."""
    v = F.col(embedding).cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    return (rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull()).where(fine)
            .select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"),
                    F.size(embedding).alias("dim"), whole.alias("v")))


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, distance): the rows of ``x`` in an order in which parents come first (the root is its own
    parent), a minimum spanning tree by Euclidean distance, grown from the row nearest to the mean."""
    n = len(x)
    squares = (x * x).sum(1)
    root = int(np.argmin(squares - 2 * x @ x.mean(0))) if n else 0
    best, parent, free = np.full(n, np.inf), np.full(n, root), np.ones(n, bool)
    best[root] = 0.0
    order, distance = np.zeros(n, np.int64), np.zeros(n)
    for i in range(n):
        at = int(np.argmin(np.where(free, best, np.inf)))
        order[i], free[at] = at, False
        distance[at] = np.sqrt(((x[at] - x[parent[at]]) ** 2).sum())
        d = np.maximum(squares + squares[at] - 2 * (x @ x[at]), 0)
        closer = free & (d < best)
        best[closer], parent[closer] = d[closer], at
    return order, parent, distance


def depths(order: np.ndarray, parent: np.ndarray) -> list[np.ndarray]:
    """The rows of each depth of the tree, root first."""
    depth = np.zeros(len(order), np.int64)
    for at in order.tolist():
        if parent[at] != at:
            depth[at] = depth[parent[at]] + 1
    return [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=-1)) + 1)]


class _Best:
    """The k best (score, id, row) of each list; ``floor`` is a list's k-th score."""

    def __init__(self, lists: int, k: int):
        self.k, self.floor = k, np.full(lists, -np.inf)
        self.kept: list = [None] * lists

    def add(self, at: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if self.kept[at] is not None:
            score, ids, rows = (np.concatenate(p) for p in zip(self.kept[at], (score, ids, rows)))
        if len(score) >= self.k:
            top = np.lexsort((rows, ids, -score))[:self.k]
            score, ids, rows = score[top], ids[top], rows[top]
            self.floor[at] = score[-1]
        self.kept[at] = (score, ids, rows)


def walk(tree: tuple[list[np.ndarray], np.ndarray, np.ndarray], anchors: np.ndarray, block: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, candidates, scores) of the (anchor, candidate) pairs that are rescored.

    ``wanted(anchors, lower, upper)`` says which pairs can matter, given bounds of their scores.
    """
    levels, parent, distance = tree
    norm = np.sqrt((block * block).sum(1))
    size = np.sqrt((anchors * anchors).sum(1))
    low, high = np.empty((len(anchors), len(block))), np.empty((len(anchors), len(block)))
    for depth, at in enumerate(levels):
        if depth:
            reach = distance[at][:, None] * norm * (1 + 1e-9) + 1e-9 * (1 + size[at][:, None] * norm)
            low[at], high[at] = low[parent[at]] - reach, high[parent[at]] + reach
            check = wanted(at, low[at], high[at])
        else:
            check = np.ones((len(at), len(block)), bool)  # the root's scores bound all others
        i, c = np.nonzero(check)
        if not len(i):
            continue
        if len(i) * 4 > check.size:  # most pairs: one product
            score = (anchors[at] @ block.T)[i, c]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", anchors[at[i[j:j + 65536]]], block[c[j:j + 65536]]) for j in range(0, len(i), 65536)])
        low[at[i], c] = high[at[i], c] = score
        cut = np.searchsorted(i, np.arange(len(at) + 1))
        for k in range(len(at)):
            if cut[k] < cut[k + 1]:
                yield int(at[k]), c[cut[k]:cut[k + 1]], score[cut[k]:cut[k + 1]]


def _matrix(table: pa.Table) -> np.ndarray:
    flat = np.asarray(table.column("v").combine_chunks().flatten())
    x = flat.reshape(table.num_rows, -1) if len(flat) else np.zeros((table.num_rows, 1))
    return x.astype(np.float64)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` is a staged table as from ``quantised``; ``anchor`` says which rows are anchors. ``low`` and ``high`` are
    the window of a negative's score in percent of the positive's.
    """
    ship(rows.sparkSession)
    anchors = rows.where(anchor)
    shards, groups = max(1, -(-rows.count() // SHARD_ROWS)), max(1, -(-anchors.count() // GROUP_ROWS))
    part = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")

    def plant(table: pa.Table) -> pa.Table:
        order, parent, distance = spanning_tree(_matrix(table))
        return table.append_column("place", pa.array(np.arange(table.num_rows))).append_column("parent", pa.array(parent)).append_column("distance", pa.array(distance))

    kept = "row bigint, id bigint, label string, dim int, v array<double>, grp int"
    trees = stage(anchors.withColumn("grp", part(groups, "row")).groupBy("dim", "grp").applyInArrow(plant, kept + ", place bigint, parent bigint, distance double"), "negatives-trees")
    sent = trees.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = rows.withColumn("shard", part(shards, "row")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def product(sent: DataFrame, run, schema: str) -> DataFrame:
        dealt_ = dealt.select(*[F.col(c).alias(c) for c in dealt.columns])  # columns of its own for the cogroup
        return sent.groupBy("dim", "grp", "shard").cogroup(dealt_.groupBy("dim", "grp", "shard")).applyInArrow(run, schema)

    def sides(left: pa.Table, right: pa.Table):
        left = left.sort_by("place")
        parent, distance = np.asarray(left.column("parent")), np.asarray(left.column("distance"))
        # parents come before children in no given order of places: depths are found from the root down
        order = _parents_first(parent)
        names = {name: i for i, name in enumerate(sorted(set(left.column("label").to_pylist()) | set(right.column("label").to_pylist())))}
        labels = [np.array([names[x] for x in t.column("label").to_pylist()], np.int64) for t in (left, right)]
        return left, (depths(order, parent), parent, distance), _matrix(left), _matrix(right), *labels

    def blocks(right: pa.Table, x: np.ndarray, label: np.ndarray) -> Iterator[tuple]:
        ids, numbers = np.asarray(right.column("id")), np.asarray(right.column("row"))
        for b in range(0, len(x), BLOCK_ROWS):
            e = b + BLOCK_ROWS
            yield x[b:e], label[b:e], ids[b:e], numbers[b:e]

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = []
        if left.num_rows and right.num_rows:
            left, tree, a, x, mine_, theirs = sides(left, right)
            own = np.asarray(left.column("row"))
            best = _Best(len(a), positives)
            for block, label, ids, numbers in blocks(right, x, theirs):
                def wanted(at, lower, upper):
                    return (mine_[at][:, None] == label) & (own[at][:, None] != numbers) & (upper >= best.floor[at][:, None])
                for i, c, score in walk(tree, a, block, wanted):
                    good = (label[c] == mine_[i]) & (numbers[c] != own[i]) & (score >= best.floor[i])
                    if good.any():
                        best.add(i, score[good], ids[c][good], numbers[c][good])
            out = [(own[i], *k) for i, k in enumerate(best.kept) if k is not None]
        return pa.table({"row": pa.array(np.concatenate([np.full(len(o[1]), o[0]) for o in out]) if out else [], pa.int64()),
                         "score": pa.array(np.concatenate([o[1] for o in out]).astype(np.int64) if out else [], pa.int64()),
                         "id": pa.array(np.concatenate([o[2] for o in out]) if out else [], pa.int64()),
                         "number": pa.array(np.concatenate([o[3] for o in out]) if out else [], pa.int64())})

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = []
        if left.num_rows and right.num_rows:
            left, tree, a, x, mine_, theirs = sides(left, right)
            held = left.column("found").to_pylist()
            top = np.full((len(a), positives), -1.0)  # no window below zero
            for i, found in enumerate(held):
                for j, p in enumerate(found):
                    top[i, j] = p["score"]
            least = np.where(top >= 0, np.ceil(top * low / 100 * (1 - 1e-12)), np.inf)
            most = np.where(top >= 0, np.floor(top * high / 100 * (1 + 1e-12)), -np.inf)
            best = _Best(len(a) * positives, negatives)
            for block, label, ids, numbers in blocks(right, x, theirs):
                def wanted(at, lower, upper):
                    floor = np.maximum(least[at], best.floor.reshape(-1, positives)[at])
                    some = np.zeros(lower.shape, bool)
                    for j in range(positives):
                        some |= (upper >= floor[:, j, None]) & (lower <= most[at][:, j, None])
                    return some & (mine_[at][:, None] != label)
                for i, c, score in walk(tree, a, block, wanted):
                    other = label[c] != mine_[i]
                    for j in range(len(held[i])):
                        at = i * positives + j
                        good = other & (low * top[i, j] <= 100 * score) & (100 * score <= high * top[i, j]) & (score >= best.floor[at])
                        if good.any():
                            best.add(at, score[good], ids[c][good], numbers[c][good])
            own, own_id = np.asarray(left.column("row")), np.asarray(left.column("id"))
            for at, k in enumerate(best.kept):
                if k is not None:
                    p = held[at // positives][at % positives]
                    out += [(int(own[at // positives]), int(own_id[at // positives]), p["number"], p["id"], p["score"], int(s), int(d), int(r)) for s, d, r in zip(*k)]
        names = ("row", "anchor_id", "positive", "positive_id", "positive_score", "negative_score", "negative_id", "number")
        return pa.table({name: pa.array([o[i] for o in out], pa.int64()) for i, name in enumerate(names)})

    ranked = product(sent, find_positives, "row bigint, score bigint, id bigint, number bigint")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "id", "number")
    first = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    windows = stage(first.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id", "number"))).alias("found")), "negatives-positives")
    # the whole tree goes along: an anchor without a positive still bounds its children
    planted = stage(trees.join(windows, "row", "left").withColumn("found", F.coalesce("found", F.array().cast(windows.schema["found"].dataType))), "negatives-windows")
    asked = planted.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = product(asked, find_negatives, "row bigint, anchor_id bigint, positive bigint, positive_id bigint, positive_score bigint, negative_score bigint, negative_id bigint, number bigint")
    order = Window.partitionBy("row", "positive").orderBy(F.col("negative_score").desc(), "negative_id", "number")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def _parents_first(parent: np.ndarray) -> np.ndarray:
    """The rows of a tree given by parents (the root is its own) in an order in which parents come first."""
    children: dict[int, list[int]] = {}
    root = 0
    for i, p in enumerate(parent.tolist()):
        if i == p:
            root = i
        else:
            children.setdefault(p, []).append(i)
    order = [root]
    for at in order:
        order.extend(children.get(at, ()))
    return np.array(order, np.int64)
