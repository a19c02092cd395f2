"""Exact top-k search by inner product with multi-resolution segment statistics.

Method: a vector is cut into equal segments; for each segment its mean and its standard
deviation are kept, at LEVELS resolutions, coarse to fine. For segments of length l,

    |q - x|^2 >= sum over segments of l * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2),

and with the vectors' norms this lower bound on the distance is an upper bound on the
inner product, sum of l * (mean_q * mean_x + dev_q * dev_x). Candidates whose bound is
below the query's k-th best score so far are dropped level by level; exact scores are
computed for the survivors only.

Plan: vectors are packed into blocks. Queries go in groups of QUERY_ROWS, candidates in
shards of SHARD_ROWS; one task takes one group and one shard, so memory is bounded and all
(query, candidate) work is spread over groups x shards. A first pass over each group's
own shard gives each query a floor for its k-th score; the second pass covers all shards.
A window keeps each query's k best of its shards.

Scores are integers (components are floor(64 * x)), exact in doubles below 2^53; bounds get
a margin for rounding, so no candidate is lost to it. Equal scores go by the smaller id.

Vectors that are null or hold a null or non-finite component take no part; neither do rows with a
null id. Vectors of different lengths are not comparable. Rows with equal ids are rows of
their own: a query never meets its own row, but it meets others of its id. An empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condensa.shipping import ship

from .common import stage

#: Segments of each resolution, coarse to fine.
LEVELS = (4, 8, 16)
QUERY_ROWS = 2048
SHARD_ROWS = 16384
#: Candidates that are multiplied at once.
BLOCK_ROWS = 2048


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """row, id, dim, v (array<double> of whole numbers) of the vectors that take part, written once.

    ``row`` numbers the rows, so that rows of one id are told apart.
    """
    v = F.col(embedding).cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    return stage(vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(fine)
                 .select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("id"), F.size(embedding).alias("dim"), whole.alias("v")),
                 "topk-vectors")


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row: sqrt(l) * mean and sqrt(l) * deviation of each segment, so that the bound is an inner product."""
    cuts = np.unique(np.linspace(0, x.shape[1], segments + 1).astype(int))
    lens = np.diff(cuts)
    sums, squares = np.add.reduceat(x, cuts[:-1], axis=1), np.add.reduceat(x * x, cuts[:-1], axis=1)
    spread = np.sqrt(np.maximum(squares - sums * sums / lens, 0))
    return np.concatenate([sums / np.sqrt(lens), spread], axis=1)


def search(numbers: np.ndarray, queries: np.ndarray, row_numbers: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int,
           floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of each query's k best rows but its own, scores at or above ``floor``."""
    best: list[list] = [[] for _ in numbers]  # per query arrays of (score, id)
    floor = floor.copy()
    if not rows.shape[1]:
        queries, rows = np.zeros((len(queries), 1)), np.zeros((len(rows), 1))
    levels = [s for s in LEVELS if s < rows.shape[1]]
    query_stats = [statistics(queries, s) for s in levels]
    norms = np.sqrt((queries * queries).sum(1))
    for a in range(0, len(rows), BLOCK_ROWS):
        block, block_ids = rows[a:a + BLOCK_ROWS], ids[a:a + BLOCK_ROWS]
        margin = 1e-9 * (1 + norms[:, None] * np.sqrt((block * block).sum(1))[None, :])
        alive = numbers[:, None] != row_numbers[None, a:a + BLOCK_ROWS]
        for s, stats in zip(levels, query_stats):
            q, c = alive.any(1), alive.any(0)
            if not q.any():
                break
            bound = stats[q] @ statistics(block[c], s).T + margin[np.ix_(q, c)]
            alive[np.ix_(q, c)] &= bound >= floor[q][:, None]
        qi, ci = np.nonzero(alive)
        if not len(qi):
            continue
        q, c = alive.any(1), alive.any(0)
        if len(qi) * 4 > int(q.sum()) * int(c.sum()):  # most pairs survive: one product
            exact = np.zeros(alive.shape)
            exact[np.ix_(q, c)] = queries[q] @ block[c].T
            score = exact[qi, ci]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", queries[qi[b:b + 65536]], block[ci[b:b + 65536]]) for b in range(0, len(qi), 65536)])
        good = score >= floor[qi]
        qi, ci, score = qi[good], ci[good], score[good]
        for i, lo, hi in zip(*_runs(qi)):
            s, d = score[lo:hi], block_ids[ci[lo:hi]]
            if best[i]:
                s, d = np.concatenate([best[i][0], s]), np.concatenate([best[i][1], d])
            if len(s) > k:
                top = np.lexsort((d, -s))[:k]
                s, d = s[top], d[top]
                floor[i] = max(floor[i], s[-1])
            best[i] = [s, d]
    got = [(i, b) for i, b in enumerate(best) if b]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return (np.concatenate([np.full(len(b[0]), i) for i, b in got]), np.concatenate([b[1] for _, b in got]), np.concatenate([b[0] for _, b in got]))


def _runs(values: np.ndarray) -> tuple[list, list, list]:
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])
    return (values[lo].tolist(), lo.tolist(), hi.tolist()) if len(values) else ([], [], [])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, id, score for ``queries``, some rows of ``vectors`` (as from ``quantised``), against all of them.

    The work is queries x vectors by nature; it is dealt out as
    groups of queries times shards of vectors.
    """
    ship(vectors.sparkSession)
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = vectors.withColumn("shard", part(shards))
    asked = queries.withColumn("grp", part(groups)).withColumnRenamed("row", "number")

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        column = table.column("v").combine_chunks()
        return np.asarray(table.column("id")), np.asarray(column.flatten()).reshape(table.num_rows, -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"number": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        (query_ids, q), (ids, x) = matrix(left), matrix(right)
        numbers = np.asarray(left.column("number"))
        at, found, score = search(numbers, q, np.asarray(right.column("row")), ids, x, k, np.asarray(left.column("floor")))
        return pa.table({"number": numbers[at], "query_id": query_ids[at].astype(np.int64), "id": found.astype(np.int64), "score": score.astype(np.float64)})

    def product(some_queries: DataFrame, some_rows: DataFrame) -> DataFrame:
        keys = ("grp", "shard", "dim")
        some_rows = some_rows.select(*[F.col(c).alias(c) for c in some_rows.columns])  # columns of its own for the cogroup
        return some_queries.groupBy(*keys).cogroup(some_rows.groupBy(*keys)).applyInArrow(run, "number bigint, query_id bigint, id bigint, score double")

    no_floor = asked.withColumn("floor", F.lit(float("-inf")))
    # a group's own shard: the k-th score there is a floor of the k-th score of all
    first = no_floor.withColumn("shard", F.pmod(F.col("grp"), F.lit(shards)).cast("int"))
    here = rows.where(F.col("shard") < groups).withColumn("grp", F.explode(F.sequence(F.col("shard"), F.lit(groups - 1), F.lit(shards))))
    floors = (product(first, here).groupBy("number").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
              .select("number", F.col("least").alias("known")))
    floored = stage(asked.join(floors, "number", "left").withColumn("floor", F.coalesce("known", F.lit(float("-inf")))).drop("known"), "topk-queries")
    sent = floored.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = rows.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = product(sent, dealt)
    best = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.col("score").cast("bigint").alias("score"))
