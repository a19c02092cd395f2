"""Tool results of every kind in one block table, plus the extracted-text table.

text (documents, pages, conversations), screenshots (caption + image), JSON query
results, page snapshots and snapshot tables: each source keeps its own tool name, so the
default rules route snapshots to the snapshot reducer and everything else by content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as FX
from .json_fixtures import DUCK_JSON_PAYLOADS, json_payloads
from .snapshot_fixtures import DUCK_SNAPSHOTS, DUCK_TABLE_SNAPSHOTS, snapshot_blocks, table_snapshots
from .tables import table

def _blk(df, rid, source, tool, args, text):
    _NULL = F.lit(None).cast("string")
    return df.select(rid.alias("result_id"), F.lit(source).alias("source"), F.lit(0).alias("pos"),
                     F.lit(tool).alias("tool_name"), args.alias("args"), F.lit("text").alias("type"),
                     text.alias("text"), _NULL.alias("data"), _NULL.alias("mime_type"))


def all_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = json_payloads(spark, sf_dir)
    s = snapshot_blocks(spark, sf_dir)
    t = table_snapshots(spark, sf_dir)
    parts = [
        FX.text_blocks(spark, sf_dir),
        FX.screenshot_blocks(spark, sf_dir),
        _blk(j, F.concat(F.lit("json:"), j.json_id), "json", "mcp__db__query",
             F.to_json(F.struct(F.concat(F.lit("select "), j.kind).alias("sql"))), j.text),
        _blk(s, F.concat(F.lit("snap:"), s.page_id.cast("string")), "snapshots",
             "mcp__playwright__browser_snapshot", F.to_json(F.struct(s.url.alias("url"))), s.text),
        _blk(t, F.concat(F.lit("table:"), t.region_id.cast("string")), "tables",
             "mcp__playwright__browser_snapshot", F.lit("{}"), t.text),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("pos", F.col("pos").cast("int"))


def ocr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_key, text, error): text extracted from screenshot images, by image hash.

    Pages with a benchmark item of the same id have text; every seventh of those has
    too little text to count, and of some the extraction failed; the rest have none.
    """
    shots = FX.screenshot_blocks(spark, sf_dir).filter("type = 'image'").select(
        F.sha2("data", 256).alias("image_key"), F.regexp_extract("result_id", r"(\d+)$", 1).cast("bigint").alias("pid"))
    b = table(spark, sf_dir, "benchmark")
    return shots.join(b, shots.pid == b.item_id).select(
        "image_key", F.when(shots.pid % 7 == 0, F.lit(" ok ")).otherwise(b.text).alias("text"),
        F.when(shots.pid % 5 == 3, F.lit("engine failed")).alias("error"))


def duck_all_blocks(text_blocks: str, shot_blocks: str) -> str:
    return f"""(
SELECT * FROM {text_blocks} a
UNION ALL SELECT * FROM {shot_blocks} b
UNION ALL SELECT 'json:' || json_id, 'json', 0, 'mcp__db__query', json_object('sql', 'select ' || kind), 'text', text,
                 CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM {DUCK_JSON_PAYLOADS} c
UNION ALL SELECT 'snap:' || CAST(page_id AS VARCHAR), 'snapshots', 0, 'mcp__playwright__browser_snapshot',
                 json_object('url', url), 'text', text, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM {DUCK_SNAPSHOTS} d
UNION ALL SELECT 'table:' || CAST(region_id AS VARCHAR), 'tables', 0, 'mcp__playwright__browser_snapshot', '{{}}', 'text',
                 text, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM {DUCK_TABLE_SNAPSHOTS} e)"""
