"""Response normalisation to blocks (S2) with wrapped-image flattening (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jsonops import single_keys

BLOCK_SCHEMA = ("array<struct<type: string, text: string, data: string, mimeType: string, "
                "source: struct<data: string, media_type: string>>>")


def compact(text: str) -> str:
    """JSON text without the white space outside its strings; key order and numbers as they are."""
    return f"regexp_replace({text}, '(\"[^\"\\\\\\\\]*+(?:\\\\\\\\.[^\"\\\\\\\\]*+)*+\")|\\\\s+', '$1')"


def with_blocks(df: DataFrame, resp_col: str) -> DataFrame:
    """Add ``blocks``: the blocks of a JSON tool response; NULL for an empty response.

    null, an empty string, an empty array and other scalars → NULL; an array whose first element is an
    object with a ``type`` key → its blocks; any other array → one text block of its compact
    JSON; an object with a ``content`` array → those blocks (none, if it is empty: not an empty
    response); an object with a string ``type`` → that block; any other object → one text
    block of its JSON; a string → one text block. An image block without data takes
    source.data and source.media_type (S3). Of a repeated key the last value counts.
    """
    given, resp_col = resp_col, "_resp"
    v = f"try_parse_json({resp_col})"
    kind = f"schema_of_variant({v})"
    first_is_block = (f"startswith({kind}, 'ARRAY') AND "
                      f"array_contains(json_object_keys(get_json_object({resp_col}, '$[0]')), 'type')")
    def text_block(t: str) -> str:
        return (f"array(named_struct('type', 'text', 'text', {t}, 'data', CAST(NULL AS STRING), "
                f"'mimeType', CAST(NULL AS STRING), 'source', CAST(NULL AS STRUCT<data: STRING, media_type: STRING>)))")
    string = f"variant_get({v}, '$', 'string')"
    blocks = (
        f"CASE WHEN {v} IS NULL OR {kind} = 'VOID' THEN NULL "
        f"WHEN startswith({kind}, 'ARRAY') THEN CASE WHEN size(from_json({resp_col}, 'array<string>')) = 0 THEN NULL "
        f"  WHEN coalesce({first_is_block}, false) THEN from_json({resp_col}, '{BLOCK_SCHEMA}') "
        f"  ELSE {text_block(compact(resp_col))} END "
        f"WHEN startswith({kind}, 'OBJECT') THEN CASE "
        f"  WHEN startswith(schema_of_variant(variant_get({v}, '$.content')), 'ARRAY') "
        f"    THEN from_json(get_json_object({resp_col}, '$.content'), '{BLOCK_SCHEMA}') "
        f"  WHEN schema_of_variant(variant_get({v}, '$.type')) = 'STRING' "
        f"    THEN array(from_json({resp_col}, '{BLOCK_SCHEMA[6:-1]}')) "
        f"  ELSE {text_block(compact(resp_col))} END "
        f"WHEN {kind} = 'STRING' AND {string} <> '' THEN {text_block(string)} ELSE NULL END")
    return single_keys(df, given, "_resp", "_why").withColumn("blocks", F.expr(blocks)).drop("_resp", "_why")


def normalise(df: DataFrame, resp_col: str) -> DataFrame:
    """One row per block of ``with_blocks``: adds ``pos`` and the block columns. Rows without blocks give none."""
    b = with_blocks(df, resp_col).select("*", F.posexplode("blocks").alias("pos", "_b")).drop("blocks")
    wrapped = F.expr("_b.type = 'image' AND coalesce(_b.data, '') = '' AND _b.source.data IS NOT NULL")
    return (b.withColumn("type", F.col("_b.type"))
             .withColumn("text", F.col("_b.text"))
             .withColumn("data", F.when(wrapped, F.col("_b.source.data")).otherwise(F.col("_b.data")))
             .withColumn("mime_type", F.when(wrapped, F.coalesce(F.col("_b.source.media_type"), F.col("_b.mimeType"),
                                                                F.lit("image/png"))).otherwise(F.col("_b.mimeType")))
             .drop("_b"))


def empty_responses(df: DataFrame, resp_col: str) -> DataFrame:
    """Rows with an empty response (logged as 'empty-response'), without a join."""
    return with_blocks(df, resp_col).where(F.col("blocks").isNull()).drop("blocks", resp_col)
