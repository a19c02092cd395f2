"""Corpus search (X3) through a stored index whose posting blocks know their greatest score.

A posting is (document, impact): the BM25 weight of a term in a document without the inverse
document frequency. Postings of a term are cut by impact into levels (LEVELS a unit), and a level
of a frequent term into blocks of PIECE_ROWS postings at most. They are dealt to the tasks by ranges
of (term, level, document), so no term is gathered in one task. The index is four tables under one path:

    documents(doc_id, term, impact)         every document's impacts by term
    postings(term, level, n, top, docs)     the blocks, n postings with top as the greatest impact
    levels(term, level, n, top)             the blocks without their documents
    stats(n_docs, avgdl)                    one row

A search never scores all documents that share a term with the query:

1. the best levels of a query's terms, FIRST_POSTINGS postings or a little more, give k
   documents; the least of their exact scores is a floor of the k-th score;
2. of each query's terms those of least greatest score are not looked up, as long as these scores
   together stay below SLACK of the floor. Of the others only levels are read that reach the
   floor with the greatest scores of all other terms; what they miss can't be among the best;
3. a document found there is kept if its part and the greatest scores of the terms not looked up
   reach the floor. The k-th greatest part among those, which the k-th score can't be below, is a
   higher floor, and the pairs that reach this one too get exact scores, from ``documents``. A
   smaller SLACK reads more postings and leaves fewer pairs.

Nothing is approximate: the result equals ``bm25.search``. Documents without an id take no part;
rows of one id count as one document. A query without a known term has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import stage
from . import bm25 as BM

#: Postings of a block at most.
PIECE_ROWS = 4096
#: Levels for an impact of 1; impacts stay below k1 + 1.
LEVELS = 16
#: Postings of a query that are read for its floor.
FIRST_POSTINGS = 4096
#: Share of the floor that terms which are not looked up may have.
SLACK = 0.1
#: Rows of a side (levels of query terms, ids of documents) up to which it is broadcast (counted first).
MAX_BROADCAST_ENTRIES = 500_000
#: Scores are compared after rounding to nine digits.
MARGIN = 1e-6


def build(docs: DataFrame, id_col: str, text_col: str, path: str, k1: float = C.BM25_K1, b: float = C.BM25_B) -> None:
    """Write the index of ``docs`` under ``path``; a second run replaces it."""
    spark = docs.sparkSession

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    tokens = BM.tokenised(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    stats = keep(BM.corpus_stats(tokens), "stats")
    impact = F.expr(f"tf * {k1 + 1}D / (tf + {k1}D * (1.0D - {b}D + {b}D * try_divide(dl, avgdl)))")
    # the one exchange deals whole documents; the counts below stay where their document is
    entries = (BM.term_table(tokens.repartition("doc_id")).groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
               .crossJoin(F.broadcast(stats)).select("doc_id", "term", impact.alias("impact")))
    lengths = tokens.groupBy("doc_id").agg(F.min("dl").alias("least"), F.max("dl").alias("most"))
    if not lengths.where("least < most").isEmpty():  # rows of one id, of several lengths
        entries = entries.groupBy("doc_id", "term").agg(F.sum("impact").alias("impact"))
    documents = keep(entries, "documents")

    level = F.floor(F.col("impact") * LEVELS).cast("int")
    placed = documents.select("term", level.alias("level"), "doc_id", "impact")
    # a number sorts faster than a text; where two terms share it, blocks are cut between them all the same
    place = F.shiftleft(F.xxhash64("term"), 6).bitwiseXOR(F.col("level"))
    placed = placed.repartitionByRange(place, "doc_id").sortWithinPartitions(place)
    kind = documents.schema["doc_id"].dataType.simpleString()
    blocks = placed.mapInArrow(cut(PIECE_ROWS), f"term string, level int, n bigint, top double, docs array<struct<doc_id:{kind},impact:double>>")
    postings = keep(blocks, "postings")
    keep(postings.select("term", "level", "n", "top"), "levels")


def cut(most: int):
    """A function for ``mapInArrow``: sorted postings to blocks of one term and level with up to ``most`` postings."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            term, level, doc_id, impact = (batch.column(c) for c in ("term", "level", "doc_id", "impact"))
            new = np.ones(rows, bool)
            new[1:] = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(level[1:], level[:-1])).to_numpy(zero_copy_only=False)
            begun = np.flatnonzero(new)
            place = np.arange(rows)
            first = np.flatnonzero((place - np.repeat(begun, np.diff(np.append(begun, rows)))) % most == 0)
            docs = pa.StructArray.from_arrays([doc_id, impact], ["doc_id", "impact"])
            yield pa.RecordBatch.from_arrays(
                [term.take(pa.array(first)), level.take(pa.array(first)), pa.array(np.diff(np.append(first, rows)), pa.int64()),
                 pa.array(np.maximum.reduceat(impact.to_numpy(), first)), pa.ListArray.from_arrays(pa.array(np.append(first, rows), pa.int32()), docs)],
                ["term", "level", "n", "top", "docs"])

    return run


def asked_levels(spark: SparkSession, path: str, queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """(query_id, term, level, n, weight, best): a query's levels, written once; best = greatest score there."""
    asked = stage(BM.query_terms(queries, query_id, query_text), "asked-terms")
    if asked.limit(BM.MAX_BROADCAST_TERMS + 1).count() <= BM.MAX_BROADCAST_TERMS:
        asked = F.broadcast(asked)
    df = F.sum("n").over(Window.partitionBy("query_id", "term"))
    rows = (spark.read.parquet(f"{path}/levels").join(asked, "term").groupBy("query_id", "term", "qtf", "level")
            .agg(F.sum("n").alias("n"), F.max("top").alias("top")).withColumn("df", df))
    rows = rows.crossJoin(F.broadcast(spark.read.parquet(f"{path}/stats")))  # exactly one row
    rows = rows.withColumn("weight", F.expr("qtf * ln((n_docs - df + 0.5D) / (df + 0.5D) + 1.0D)"))
    return stage(rows.select("query_id", "term", "level", "n", "weight", (F.col("weight") * F.col("top")).alias("best")), "asked-levels")


def part_scores(spark: SparkSession, path: str, rows: DataFrame, levels: DataFrame) -> DataFrame:
    """(query_id, doc_id, part): scores summed over the postings of ``levels``, some of the staged ``rows``."""
    levels = levels.select("query_id", "term", "level", "weight")
    if rows.limit(MAX_BROADCAST_ENTRIES + 1).count() <= MAX_BROADCAST_ENTRIES:
        levels = F.broadcast(levels)
    read = spark.read.parquet(f"{path}/postings").select("term", "level", "docs").join(levels, ["term", "level"])
    return (read.select("query_id", "weight", F.explode_outer("docs").alias("p"))
            .groupBy("query_id", F.col("p.doc_id").alias("doc_id")).agg(F.sum(F.col("weight") * F.col("p.impact")).alias("part")))


def exact_scores(spark: SparkSession, path: str, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of ``pairs`` (query_id, doc_id), from the documents' own impacts."""
    pairs = stage(pairs.select("query_id", "doc_id"), "pairs")
    documents, met = spark.read.parquet(f"{path}/documents"), pairs.select("doc_id").distinct()
    if met.limit(MAX_BROADCAST_ENTRIES + 1).count() <= MAX_BROADCAST_ENTRIES:
        met = F.broadcast(met)
    weights = rows.select("query_id", "term", "weight").distinct()
    return (documents.join(met, "doc_id", "left_semi").join(pairs.join(weights, "query_id"), ["doc_id", "term"])
            .groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score")))


def floors(spark: SparkSession, path: str, rows: DataFrame, top_k: int) -> DataFrame:
    """(query_id, floor): a score that at least ``top_k`` documents of the query reach; queries with fewer found have no row."""
    down = Window.partitionBy("query_id").orderBy(F.desc("best"), "term", "level")
    before = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = rows.withColumn("_before", before).where(F.col("_before") < max(FIRST_POSTINGS, top_k))
    ranked = part_scores(spark, path, rows, first).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"), "doc_id")))
    exact = exact_scores(spark, path, rows, ranked.where(F.col("_rank") <= top_k))
    least = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("floor"))
    return least.where(F.col("_n") >= top_k).select("query_id", "floor")


def survivors(spark: SparkSession, path: str, rows: DataFrame, top_k: int | None) -> DataFrame:
    """(query_id, doc_id): the pairs that can be among the ``top_k`` best; all that share a term if that is None."""
    if top_k is None:
        return part_scores(spark, path, rows, rows).select("query_id", "doc_id")
    known = floors(spark, path, rows, top_k).withColumn("floor", F.col("floor") - MARGIN)
    terms = rows.groupBy("query_id", "term").agg(F.max("best").alias("most")).join(known, "query_id", "left")
    whole = Window.partitionBy("query_id")
    up = whole.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    terms = terms.withColumns({"_all": F.sum("most").over(whole),
                               "_looked_up": F.coalesce(F.sum("most").over(up) >= F.col("floor") * SLACK, F.lit(True))})
    terms = terms.withColumn("rest", F.coalesce(F.sum(F.when(~F.col("_looked_up"), F.col("most"))).over(whole), F.lit(0.0)))
    terms = stage(terms, "judged-terms")
    reaches = F.coalesce(F.col("best") + F.col("_all") - F.col("most") >= F.col("floor"), F.lit(True))
    needed = rows.join(terms.where("_looked_up"), ["query_id", "term"]).where(reaches)
    limits = terms.groupBy("query_id").agg(F.max("rest").alias("rest"), F.max("floor").alias("floor"))
    found = part_scores(spark, path, rows, needed).join(limits, "query_id")
    found = stage(found.where(F.coalesce(F.col("part") + F.col("rest") >= F.col("floor"), F.lit(True))), "candidates")
    ranked = found.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"), "doc_id")))
    higher = ranked.where(F.col("_rank") <= top_k).groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("part").alias("_least"))
    higher = higher.where(F.col("_n") >= top_k).select("query_id", (F.col("_least") - MARGIN).alias("_least"))
    found = found.join(higher, "query_id", "left")
    return found.where(F.coalesce(F.col("part") + F.col("rest") >= F.col("_least"), F.lit(True))).select("query_id", "doc_id")


def search(spark: SparkSession, path: str, queries: DataFrame, query_id: str, query_text: str, top_k: int | None = 10) -> DataFrame:
    """query_id, doc_id, score (six digits), rank (1 = best; ties by doc_id): the ``top_k`` best documents of each query."""
    rows = asked_levels(spark, path, queries, query_id, query_text)
    scored = exact_scores(spark, path, rows, survivors(spark, path, rows, top_k))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("doc_id"))
    ranked = scored.withColumn("rank", F.row_number().over(best))
    if top_k is not None:
        ranked = ranked.where(F.col("rank") <= top_k)
    return ranked.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
