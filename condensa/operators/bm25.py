"""BM25 over a whole corpus as a relational plan (X2/X3 with A6-A8, J4, W3).

    documents -> (doc, dl, words)                      tokenised once, written once
    tf(doc, dl, term, tf)     terms of the query vocabulary, counted per document
    df(term)                  tf rows per term
    score(query, doc) = sum over query terms of qtf * idf(df) * tf-norm(tf, dl, avgdl)

The tokenised documents are written to the shared folder and read for the statistics and
for the counts. A document's tokens are counted where they are (map-side), so no row per token
is shuffled. The query terms with their document frequencies go to the counts: they are
broadcast up to MAX_BROADCAST_TERMS rows (counted first), beyond that both sides are shuffled on the
term and AQE splits skewed ones. Scores of a document are summed where the document is; top-k per
query uses a window whose limit Spark pushes below the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as E
from ..session import stage

#: Query terms (rows of query, term) that are broadcast.
MAX_BROADCAST_TERMS = 100_000


def tokenised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, dl, words) of every document, written once; dl = tokens in the document, words = these, joined by spaces."""
    terms = docs.select(F.col(id_col).alias("doc_id"), F.expr(E.tokenize(text_col)).alias("terms"))
    return stage(terms.select("doc_id", F.size("terms").alias("dl"), F.array_join("terms", " ").alias("words")), "bm25-terms")


def term_table(tokens: DataFrame) -> DataFrame:
    """(doc_id, dl, term) with one row per token occurrence."""
    return tokens.where("dl > 0").select("doc_id", "dl", F.explode(F.split("words", " ")).alias("term"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: N documents (zero-term documents count) and their average length."""
    return tokens.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, qid_col: str, text_col: str) -> DataFrame:
    """(query_id, term, qtf): repeated query terms count repeatedly."""
    return (queries.select(F.col(qid_col).alias("query_id"), F.explode_outer(F.expr(E.tokenize(text_col))).alias("term"))
            .filter(F.col("term").isNotNull())
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def search(docs: DataFrame, doc_id: str, doc_text: str, queries: DataFrame, query_id: str,
           query_text: str, top_k: int | None = 10, k1: float = C.BM25_K1, b: float = C.BM25_B) -> DataFrame:
    """Score every document against every query; keep the top ``top_k`` per query.

    Output: query_id, doc_id, score (rounded to 6 digits), rank (1 = best; ties by doc_id).
    Documents sharing no term with a query are not listed (their score is 0).
    """
    qt = stage(query_terms(queries, query_id, query_text), "bm25-queries")
    small = qt.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS
    hint = F.broadcast if small else (lambda df: df)
    tokens = tokenised(docs, doc_id, doc_text)
    terms = term_table(tokens).join(hint(qt.select("term").distinct()), "term", "left_semi")
    tf = terms.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = F.broadcast(corpus_stats(tokens))  # exactly one row
    idf = F.expr("ln((n_docs - df + 0.5D) / (df + 0.5D) + 1.0D)")
    norm = F.expr(f"tf * {k1 + 1}D / (tf + {k1}D * (1.0D - {b}D + {b}D * try_divide(dl, avgdl)))")
    scored = (tf.join(hint(qt.join(dfreq, "term")), "term").crossJoin(stats)
              .withColumn("_part", F.col("qtf") * idf * norm)
              .groupBy("query_id", "doc_id").agg(F.sum("_part").alias("_score")))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("_score", 9)), F.asc("doc_id"))
    ranked = scored.withColumn("rank", F.row_number().over(w))
    if top_k is not None:
        ranked = ranked.filter(F.col("rank") <= top_k)
    return ranked.select("query_id", "doc_id", F.round("_score", 6).alias("score"), "rank")
