"""Corpus pipeline: documents in, training tokens out, one Parquet table per stage.

Quality rules drop documents; the n-gram Jaccard join keeps one document of each group; personal
data is masked; sources are mixed to their target weights (documents are repeated, dropped
or cut at the source's exact budget); the BPE stage encodes what is left.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.llm import bpe, jaccard, mix, pii, quality
from condensa.llm.common import scratch_path, stage
from condensa.llm.queries import vocabulary_path
from condensa.llm.tokens import read_vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    return quality.keep_good(docs)


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a column ``key`` that is unique by row and sorts by document id (null last): the id,
    then the row's place in its file."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not a table that was read
        docs = stage(docs, "pipeline-docs")
    ident = F.coalesce(F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0"), F.lit("~"))
    return docs.withColumn(key, F.concat_ws("|", ident, F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link (5-word shingles, similarity 0.8 or more), keep the one
    with the least document id. Documents without words are groups of their own."""
    key = "row_key_" + "_".join(docs.columns)  # no column has this name
    keyed = _keyed(docs, key)
    dropped = jaccard.link_groups(keyed, key).where(~F.col("representative")).select(key)
    return keyed.join(dropped, key, "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; n_chars follows the text."""
    masked = pii.redact(docs, pii.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, drop and cut the documents of each source to its target weight."""
    mixed = mix.materialise(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256 of what
    decoding the ids gives."""
    done = bpe.encode(docs, read_vocabulary(vocabulary_path()))
    return done.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


#: (name, function): each function takes (spark, docs, sf_dir); its result is written as
#: Parquet and read again as the docs of the next one.
STAGES = [("quality_rules", quality_rules), ("one_of_near_copies", one_of_near_copies), ("mask_personal_data", mask_personal_data),
          ("mix_sources", mix_sources), ("encode", encode)]

#: SQL cannot express the PII and BPE stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = scratch_path(spark, name)
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
