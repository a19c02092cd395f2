"""Page-snapshot tool results derived from ``pages`` (and ``nation`` x ``region`` tables).

Each page becomes an accessibility-tree snapshot: a banner heading, a navigation list
of its links, an ad line, the article paragraphs, a search box, a disabled button, a
strong line, two images and a footer. Even pages come wrapped in a fenced block behind
a short header, like a browser tool's output. All text is pulled out of the HTML with
regular expressions that behave the same in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

_SNAPSHOT_SPARK = r"""
concat_ws('\n',
  '- generic [ref=e1]:',
  '  - banner [ref=e2]:',
  concat('    - heading "', h1, '" [level=1] [ref=e3]'),
  '  - navigation "Main" [ref=e4]:',
  '    - list [ref=e5]:',
  array_join(transform(hrefs, (h, k) -> concat(
     '      - listitem [ref=e', CAST(10 + k AS STRING), ']:\n',
     '        - link "', texts[k], '" [ref=e', CAST(100 + k AS STRING), '] [cursor=pointer]:\n',
     '          - /url: ', h)), '\n'),
  concat('  - generic [ref=e6]: ', ad),
  '  - main [ref=e7]:',
  array_join(transform(paras, (p, k) -> concat('    - paragraph [ref=e', CAST(200 + k AS STRING), ']: ', p)), '\n'),
  '    - textbox "Search" [ref=e8]:',
  concat('      - /placeholder: Search ', host),
  '    - button "Go" [ref=e9] [disabled]',
  '    - strong [ref=e11]:',
  concat('      - text: ', h1),
  '    - img',
  '    - img "logo" [ref=e12]',
  '  - contentinfo [ref=e13]:',
  concat('    - paragraph [ref=e14]: ', foot))
"""


def _parts(p: DataFrame) -> DataFrame:
    nav = F.regexp_extract("html", r"<nav>(.*?)</nav>", 1)
    art = F.regexp_extract("html", r"<article>(.*?)</article>", 1)
    return p.select(
        "page_id", "url",
        F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1).alias("h1"),
        F.regexp_extract_all(nav, F.lit(r'<a href="([^"]*)">'), 1).alias("hrefs"),
        F.regexp_extract_all(nav, F.lit(r'<a href="[^"]*">([^<]*)</a>'), 1).alias("texts"),
        F.regexp_extract("html", r'<div class="ad">([^<]*)</div>', 1).alias("ad"),
        F.regexp_extract_all(art, F.lit(r"<p>([^<]+)"), 1).alias("paras"),
        F.regexp_extract("html", r"<footer>([^<]*)</footer>", 1).alias("foot"),
        F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1).alias("host"))


def snapshot_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text): one snapshot per page; even pages are fenced with a header."""
    p = _parts(table(spark, sf_dir, "pages"))
    snap = F.expr(_SNAPSHOT_SPARK)
    fenced = F.concat(F.lit("### Page state\n- Page URL: "), F.col("url"), F.lit("\n```yaml\n"), snap,
                      F.lit("\n```\n"))
    return p.select("page_id", "url", F.when(F.col("page_id") % 2 == 0, fenced).otherwise(snap).alias("text"))


def table_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, text): a header rowgroup and a body rowgroup of the region's nations."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(
        "r_regionkey", "r_name", "n_nationkey",
        F.concat(F.lit('    - row "'), F.col("n_nationkey").cast("string"), F.lit(" "), F.col("n_name"),
                 F.lit('" [ref=r'), F.col("n_nationkey").cast("string"), F.lit("]:\n"),
                 F.lit('      - cell "'), F.col("n_nationkey").cast("string"), F.lit('" [ref=c'),
                 F.col("n_nationkey").cast("string"), F.lit("]\n"),
                 F.lit("      - cell [ref=d"), F.col("n_nationkey").cast("string"), F.lit("]:\n"),
                 F.lit('        - link "'), F.col("n_name"), F.lit('" [ref=l'), F.col("n_nationkey").cast("string"),
                 F.lit("]:\n"), F.lit("          - /url: /nation/"), F.col("n_nationkey").cast("string")).alias("row"))
    body = rows.groupBy("r_regionkey", "r_name").agg(
        F.expr("listagg(row, '\\n') WITHIN GROUP (ORDER BY n_nationkey)").alias("body"))
    text = F.concat(
        F.lit('- table "Nations of '), F.col("r_name"), F.lit('" [ref=t'), F.col("r_regionkey").cast("string"),
        F.lit("]:\n  - rowgroup:\n    - row \"key name\":\n      - columnheader \"key\"\n"
              "      - columnheader \"name\"\n  - rowgroup:\n"), F.col("body"))
    return body.select(F.col("r_regionkey").cast("bigint").alias("region_id"), text.alias("text"))


DUCK_SNAPSHOTS = r"""(
WITH parts AS (
  SELECT page_id, url,
    regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1,
    regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="([^"]*)">', 1) AS hrefs,
    regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">([^<]*)</a>', 1) AS texts,
    regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS ad,
    regexp_extract_all(regexp_extract(html, '<article>(.*?)</article>', 1), '<p>([^<]+)', 1) AS paras,
    regexp_extract(html, '<footer>([^<]*)</footer>', 1) AS foot,
    regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host
  FROM pages),
s AS (
  SELECT page_id, url, concat_ws(chr(10),
    '- generic [ref=e1]:',
    '  - banner [ref=e2]:',
    '    - heading "' || h1 || '" [level=1] [ref=e3]',
    '  - navigation "Main" [ref=e4]:',
    '    - list [ref=e5]:',
    array_to_string(list_transform(hrefs, lambda h, k:
       '      - listitem [ref=e' || CAST(9 + k AS VARCHAR) || ']:' || chr(10) ||
       '        - link "' || texts[k] || '" [ref=e' || CAST(99 + k AS VARCHAR) || '] [cursor=pointer]:' || chr(10) ||
       '          - /url: ' || h), chr(10)),
    '  - generic [ref=e6]: ' || ad,
    '  - main [ref=e7]:',
    array_to_string(list_transform(paras, lambda p, k: '    - paragraph [ref=e' || CAST(199 + k AS VARCHAR) || ']: ' || p), chr(10)),
    '    - textbox "Search" [ref=e8]:',
    '      - /placeholder: Search ' || host,
    '    - button "Go" [ref=e9] [disabled]',
    '    - strong [ref=e11]:',
    '      - text: ' || h1,
    '    - img',
    '    - img "logo" [ref=e12]',
    '  - contentinfo [ref=e13]:',
    '    - paragraph [ref=e14]: ' || foot) AS snap
  FROM parts)
SELECT page_id, url, CASE WHEN page_id % 2 = 0
  THEN '### Page state' || chr(10) || '- Page URL: ' || url || chr(10) || '```yaml' || chr(10) || snap || chr(10) || '```' || chr(10)
  ELSE snap END AS text
FROM s)"""

DUCK_TABLE_SNAPSHOTS = r"""(
WITH rows AS (
  SELECT r_regionkey, r_name, n_nationkey,
    '    - row "' || CAST(n_nationkey AS VARCHAR) || ' ' || n_name || '" [ref=r' || CAST(n_nationkey AS VARCHAR) || ']:' || chr(10) ||
    '      - cell "' || CAST(n_nationkey AS VARCHAR) || '" [ref=c' || CAST(n_nationkey AS VARCHAR) || ']' || chr(10) ||
    '      - cell [ref=d' || CAST(n_nationkey AS VARCHAR) || ']:' || chr(10) ||
    '        - link "' || n_name || '" [ref=l' || CAST(n_nationkey AS VARCHAR) || ']:' || chr(10) ||
    '          - /url: /nation/' || CAST(n_nationkey AS VARCHAR) AS row
  FROM nation JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT r_regionkey, r_name, string_agg(row, chr(10) ORDER BY n_nationkey) AS body FROM rows GROUP BY ALL)
SELECT CAST(r_regionkey AS BIGINT) AS region_id,
  '- table "Nations of ' || r_name || '" [ref=t' || CAST(r_regionkey AS VARCHAR) || ']:' || chr(10) ||
  '  - rowgroup:' || chr(10) || '    - row "key name":' || chr(10) || '      - columnheader "key"' || chr(10) ||
  '      - columnheader "name"' || chr(10) || '  - rowgroup:' || chr(10) || body AS text
FROM b)"""
