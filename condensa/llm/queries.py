"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.sources.tables import table

from . import bpe, conversations, hard_negatives, jaccard, licences, mix, pii, quality, rans, repeats, simhash, sql, token_scan, topk
from .common import scratch_path, stage
from .tokens import read_vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_path() -> str:
    """The byte-level vocabulary that the queries use; an installed package has it."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of every document as rANS blocks and read them back."""
    path = scratch_path(spark, "rans")
    rans.write(table(spark, sf_dir, "documents"), read_vocabulary(vocabulary_path()), path)
    return rans.read_documents(spark, path)


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the adaptive thresholds."""
    judged = quality.assess(table(spark, sf_dir, "documents"))
    return judged.select(judged.row_id.alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"), "n_unknown")


@query
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of highest inner product for every vector whose id is divisible by 20."""
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    found = topk.top_k(vectors, vectors.where("id % 20 = 0"))
    return found.select("query_id", "rank", found.id.alias("vec_id"), "score")


@query
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document by the mix at the sources' target weights."""
    return mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in the flat token files that are written from them."""
    path = scratch_path(spark, "flat")
    vocab = read_vocabulary(vocabulary_path())
    end_id = next(t["id"] for t in vocab.spec["added_tokens"] if t["content"] == "<|endoftext|>")
    token_scan.write(table(spark, sf_dir, "documents"), vocab, path, end_id)
    rows = spark.read.parquet(path)
    counts = token_scan.scan(rows.where("kind = 0"), end_id, 2)  # ids below 2^16
    return token_scan.with_ids(counts, rows.where("kind = 1")).select("doc_id", "n_tokens", "file", "start")


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and those that the trained classifier adds."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    return bpe.digests(table(spark, sf_dir, "documents"), read_vocabulary(vocabulary_path()))


@query
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that link by Jaccard similarity of their 4-word shingles, 0.85 or more."""
    return jaccard.link_groups(table(spark, sf_dir, "documents"), n=4, threshold=85).select("doc_id", "n_shingles", "component_id")


@query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    found = repeats.repeats(table(spark, sf_dir, "documents"))
    runs = F.size("removed").cast("long")
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_bytes", length.alias("n_removed"), runs.alias("n_spans"), "kept_sha256")


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five positives of every anchor (vec_id divisible by 100)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = stage(hard_negatives.quantised(table(spark, sf_dir, "embeddings").withColumn("label", label)), "negatives-vectors")
    found = hard_negatives.mine(rows, F.col("id") % 100 == 0, positives=5, negatives=5, low=80, high=100)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and its component by fingerprints that differ in two bits or less."""
    return simhash.link_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation; its original ids all stay."""
    chats = table(spark, sf_dir, "conversations")
    found = conversations.repair(conversations.damaged(chats))
    ids = chats.select("conv_id").distinct()
    none = {c: F.lit(0).cast("bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    joined = ids.join(found.withColumnRenamed("conv_id", "found_id"), F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    return joined.select("conv_id", *[F.coalesce(c, v).alias(c) for c, v in none.items()])


ORACLES["op3_licences"] = sql.OP3_LICENCES
ORACLES["op4_topk"] = sql.OP4_TOPK
ORACLES["op11_hard_negatives"] = sql.OP11_HARD_NEGATIVES
ORACLES["op13_conversations"] = sql.OP13_CONVERSATIONS
ORACLES["op9_jaccard"] = sql.OP9_JACCARD
ORACLES["op2_quality"] = sql.OP2_QUALITY
ORACLES["op5_mix"] = sql.OP5_MIX
