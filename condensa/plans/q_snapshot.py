"""Page-snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import snapshot as SN
from ..sources.snapshot_fixtures import DUCK_SNAPSHOTS, DUCK_TABLE_SNAPSHOTS, snapshot_blocks, table_snapshots
from ..sources.tables import spread
from . import duck as D
from .registry import query

LINE_CTES = D.snap_line_ctes(DUCK_SNAPSHOTS, "page_id", "text")


def _lines(spark, sf_dir):
    return SN.line_table(spread(snapshot_blocks(spark, sf_dir), "page_id"), "page_id", "text")


@query("snapshot_lines", oracle=f"""
WITH {LINE_CTES}
SELECT block_id, line_no, blank, node, indent, role, name, ref, level, attrs, inline_text FROM line_table""")
def snapshot_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("block_id", "line_no", "blank", "node", "indent", "role", "name", "ref",
                                        "level", "attrs", "inline_text")


@query("snapshot_ancestors", oracle=f"""
WITH {LINE_CTES}
SELECT block_id, line_no, parent, depth, subtree_end, hidden FROM line_table""")
def snapshot_ancestors(spark, sf_dir):
    return _lines(spark, sf_dir).select("block_id", "line_no", "parent", "depth", "subtree_end", "hidden")


@query("snapshot_footer_strip", oracle=f"""
WITH {LINE_CTES}
SELECT block_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE NOT under_footer AND NOT (node AND role IN ('contentinfo'))) AS BIGINT) AS n_kept,
       md5(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT under_footer AND NOT (node AND role IN ('contentinfo'))))
         AS kept_md5
FROM line_table GROUP BY block_id""")
def snapshot_footer_strip(spark, sf_dir):
    lt = _lines(spark, sf_dir)
    keep = ~F.col("under_footer") & ~(F.col("node") & F.col("role").isin(*C.FOOTER_ROLES))
    return (lt.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(keep, 1)).alias("n_kept"),
        F.md5(F.expr("listagg(IF(NOT under_footer AND NOT (node AND role IN ('contentinfo')), line, NULL), '\\n') "
                     "WITHIN GROUP (ORDER BY line_no)")).alias("kept_md5")))


@query("snapshot_interactive", oracle=f"""
WITH {LINE_CTES}
SELECT role, count(*) AS n_elements, count(DISTINCT block_id) AS n_blocks FROM line_table
WHERE node AND NOT hidden AND ref <> '' AND role IN ({', '.join(D.s(r) for r in C.INTERACTIVE_ROLES if r != 'link')})
GROUP BY role""")
def snapshot_interactive(spark, sf_dir):
    lt = _lines(spark, sf_dir)
    roles = [r for r in C.INTERACTIVE_ROLES if r != "link"]
    return (lt.filter(F.col("node") & ~F.col("hidden") & (F.col("ref") != "") & F.col("role").isin(*roles))
            .groupBy("role").agg(F.count(F.lit(1)).alias("n_elements"),
                                 F.countDistinct("block_id").alias("n_blocks")))


@query("snapshot_outline", oracle=f"""
WITH {D.snap_outline_ctes(DUCK_SNAPSHOTS, "page_id", "text").lstrip()}
SELECT block_id AS page_id, CAST(length(text) AS INTEGER) AS before_chars, CAST(length(outline) AS INTEGER) AS after_chars,
       md5(outline) AS outline_md5 FROM outline""")
def snapshot_outline(spark, sf_dir):
    """D3 + D5-D9: Markdown outline of every page snapshot (NULL when not shorter)."""
    s = SN.with_outline(spread(snapshot_blocks(spark, sf_dir), "page_id"), "text")
    return s.select("page_id", F.length("text").alias("before_chars"), F.length("outline").alias("after_chars"),
                    F.md5("outline").alias("outline_md5"))


@query("snapshot_table", oracle=f"""
WITH {D.snap_outline_ctes(DUCK_TABLE_SNAPSHOTS, "region_id", "text").lstrip()}
SELECT block_id AS region_id, outline AS markdown FROM outline""")
def snapshot_table(spark, sf_dir):
    """D7 + A12: tables of nations per region rendered to Markdown."""
    t = SN.with_outline(table_snapshots(spark, sf_dir), "text")
    return t.select("region_id", F.col("outline").alias("markdown"))


@query("snapshot_cleanup", oracle=f"""
WITH src AS (SELECT 'page:' || CAST(page_id AS VARCHAR) AS block_id, text FROM {DUCK_SNAPSHOTS} s
             UNION ALL SELECT 'table:' || CAST(region_id AS VARCHAR), text FROM {DUCK_TABLE_SNAPSHOTS} t),
c AS (SELECT block_id, text, {D.snap_cleanup('text')} AS cleaned FROM src)
SELECT block_id, CAST(length(text) AS INTEGER) AS before_chars, CAST(length(cleaned) AS INTEGER) AS after_chars,
       md5(cleaned) AS cleaned_md5 FROM c""")
def snapshot_cleanup(spark, sf_dir):
    """The line cleanup profile over every page snapshot and snapshot table."""
    pages = snapshot_blocks(spark, sf_dir).select(
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("block_id"), "text")
    tables = table_snapshots(spark, sf_dir).select(
        F.concat(F.lit("table:"), F.col("region_id").cast("string")).alias("block_id"), "text")
    s = spread(pages.unionByName(tables), "block_id")
    s = s.withColumn("cleaned", F.expr(SN.cleanup_expr("text")))
    return s.select("block_id", F.length("text").alias("before_chars"), F.length("cleaned").alias("after_chars"),
                    F.md5("cleaned").alias("cleaned_md5"))
