"""Tool-call shaped inputs derived from the driver's tables.

The driver tables hold plain prose, raw web pages, chat turns and event rows. The
engine works on tool results (blocks of text, JSON, page snapshots and images), so each
builder here derives such results from a table with built-in functions only. Every
derivation is deterministic and has a line-for-line twin in ``plans.duck`` so that
DuckDB sees identical input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

BLOCK_COLUMNS = ["result_id", "source", "pos", "tool_name", "args", "type", "text", "data", "mime_type"]


def _block(df: DataFrame, result_id, source: str, pos, tool_name: str, args, text) -> DataFrame:
    return df.select(
        result_id.alias("result_id"),
        F.lit(source).alias("source"),
        pos.cast("int").alias("pos"),
        F.lit(tool_name).alias("tool_name"),
        args.alias("args"),
        F.lit("text").alias("type"),
        text.alias("text"),
        F.lit(None).cast("string").alias("data"),
        F.lit(None).cast("string").alias("mime_type"),
    )


def document_args(d: DataFrame):
    """JSON arguments of the ``read_document`` call that returned a document."""
    return F.to_json(F.struct(
        F.concat(F.lit("corpus/"), d.source, F.lit("/"), d.lang, F.lit("/"), d.doc_id.cast("string"),
                 F.lit(".txt")).alias("path"),
        F.substring_index(d.text, ".", 1).alias("query"),
    ))


def document_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tool_name, args, text): documents as results of ``read_document`` calls."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.lit("read_document").alias("tool_name"), document_args(d).alias("args"), "text")


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result per document: the output of a ``read_document`` call."""
    d = table(spark, sf_dir, "documents")
    args = document_args(d)
    return _block(d, F.concat(F.lit("doc:"), d.doc_id.cast("string")), "documents", F.lit(0),
                  "mcp__corpus__read_document", args, d.text)


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result per page: the raw HTML returned by a ``fetch_page`` call."""
    p = table(spark, sf_dir, "pages")
    args = F.to_json(F.struct(p.url.alias("url")))
    return _block(p, F.concat(F.lit("page:"), p.page_id.cast("string")), "pages", F.lit(0),
                  "mcp__web__fetch_page", args, p.html)


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result per conversation; each turn is one block in turn order."""
    c = table(spark, sf_dir, "conversations")
    args = F.to_json(F.struct(c.conv_id.cast("string").alias("conversation")))
    return _block(c, F.concat(F.lit("conv:"), c.conv_id.cast("string")), "conversations", c.turn,
                  "mcp__chat__read_history", args, c.text)


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + pages + conversations as one long block table."""
    return (document_blocks(spark, sf_dir)
            .unionByName(page_blocks(spark, sf_dir))
            .unionByName(conversation_blocks(spark, sf_dir)))


def screenshot_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-block results per page: a caption text block, then an image block.

    Even pages mention a saved image path in the caption; every third page comes from a
    known screenshot tool, the rest from an image generator. The image payload is the
    base64 of the page.
    """
    p = table(spark, sf_dir, "pages")
    rid = F.concat(F.lit("shot:"), p.page_id.cast("string"))
    tool = F.when(p.page_id % 3 == 0, F.lit("mcp__playwright__browser_take_screenshot")) \
        .otherwise(F.lit("mcp__images__generate_image"))
    caption = F.when(p.page_id % 2 == 0,
                     F.concat(F.lit("Saved screenshot to /tmp/shots/page-"), p.page_id.cast("string"),
                              F.lit(".png")))\
        .otherwise(F.concat(F.lit("Captured "), p.url))
    args = F.when(p.page_id % 2 == 0,
                  F.to_json(F.struct(F.concat(F.lit("/tmp/shots/page-"), p.page_id.cast("string"),
                                              F.lit(".png")).alias("filename")))) \
        .otherwise(F.to_json(F.struct(p.url.alias("url"))))
    text = p.select(rid.alias("result_id"), F.lit("screenshots").alias("source"), F.lit(0).alias("pos"),
                    tool.alias("tool_name"), args.alias("args"), F.lit("text").alias("type"),
                    caption.alias("text"), F.lit(None).cast("string").alias("data"),
                    F.lit(None).cast("string").alias("mime_type"))
    image = p.select(rid.alias("result_id"), F.lit("screenshots").alias("source"), F.lit(1).alias("pos"),
                     tool.alias("tool_name"), args.alias("args"), F.lit("image").alias("type"),
                     F.lit(None).cast("string").alias("text"),
                     # base64 without line breaks (Spark's encoder wraps lines by default)
                     F.regexp_replace(F.base64(F.encode(p.html, "UTF-8")),
                                      r"[\r\n]", "").alias("data"),
                     F.lit("image/png").alias("mime_type"))
    return text.unionByName(image).withColumn("pos", F.col("pos").cast("int"))


def event_tool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full tool names of every event: built-in, two-part, three-part and deeper MCP names."""
    e = table(spark, sf_dir, "events")
    name = (F.when(e.event_id % 4 == 0, e.event_type)
            .when(e.event_id % 4 == 1, F.concat(F.lit("mcp__srv__"), e.event_type))
            .when(e.event_id % 4 == 2, F.concat(F.lit("mcp__srv__"), e.event_type, F.lit("__v2")))
            .otherwise(F.concat(F.lit("mcp__"), e.event_type)))
    return e.select("event_id", "user_id", "event_type", name.alias("full_name"))
