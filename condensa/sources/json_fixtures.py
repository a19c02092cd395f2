"""JSON tool results derived from ``customer`` and ``orders``.

Each payload is one JSON document built by string concatenation, ordered by key, so
Spark and DuckDB produce byte-identical text. Groups have a fixed size by construction
(50 customers by customer key, or a page of 150 orders by order key), so no payload
grows with the data or with a customer that holds many orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

CUSTOMERS_PER_PAYLOAD = 50
ORDERS_PER_PAGE = 150

_CUSTOMER_OBJ = """concat('{"c_custkey": ', CAST(c_custkey AS STRING), ', "c_name": "', c_name,
  '", "c_nationkey": ', CAST(c_nationkey AS STRING), ', "c_acctbal": ', CAST(CAST(c_acctbal AS DECIMAL(15, 2)) AS STRING),
  ', "c_mktsegment": "', c_mktsegment, '", "note": ', IF(c_custkey % 5 = 0, 'null', '"vip | gold"'), '}')"""

_WIDE_OBJ = """concat('{', array_join(transform(sequence(1, 16), i -> concat('"k', CAST(i AS STRING), '": ',
  CAST(c_custkey * i AS STRING))), ', '), '}')"""

_ORDER_OBJ = """concat('{"o_orderkey": ', CAST(o_orderkey AS STRING), ', "o_custkey": ', CAST(o_custkey AS STRING),
  ', "o_orderstatus": "', o_orderstatus, '", "o_totalprice": ', CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS STRING),
  ', "o_orderdate": "', date_format(o_orderdate, 'yyyy-MM-dd'), '", "o_orderpriority": "', o_orderpriority, '"}')"""

_MIXED_OBJ = """IF(o_orderkey % 2 = 0,
  concat('{"o_orderkey": ', CAST(o_orderkey AS STRING), ', "o_orderstatus": "', o_orderstatus, '"}'),
  concat('{"o_orderkey": ', CAST(o_orderkey AS STRING), ', "o_orderstatus": "', o_orderstatus,
         '", "o_orderpriority": "', o_orderpriority, '"}'))"""


def _agg_json(df: DataFrame, key, obj_sql: str, order_col: str, wrap) -> DataFrame:
    g = (df.withColumn("_g", key).withColumn("_o", F.expr(obj_sql))
         .groupBy("_g")
         .agg(F.expr(f"listagg(_o, ', ') WITHIN GROUP (ORDER BY {order_col})").alias("_items"),
              F.count(F.lit(1)).alias("_n")))
    return g.select(F.col("_g").alias("group_id"), wrap(F.col("_items"), F.col("_n"), F.col("_g")).alias("text"))


def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(json_id, kind, text): five payload families.

    customers: top-level array of homogeneous records (a table);
    orders:    object with scalar siblings and one array of a page of orders (table +
               meta line), over the 100-row cap;
    mixed:     array whose records differ in keys (no table; sampled);
    nested:    deep object with empty members (stripping and depth collapse);
    wide:      16-column records (over the column cap; no table).
    """
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    cg = F.floor(F.col("c_custkey") / CUSTOMERS_PER_PAYLOAD)
    og = F.floor(F.col("o_orderkey") / ORDERS_PER_PAGE)
    arr = lambda items, n, g: F.concat(F.lit("["), items, F.lit("]"))
    customers = _agg_json(c, cg, _CUSTOMER_OBJ, "c_custkey", arr)
    wide = _agg_json(c, cg, _WIDE_OBJ, "c_custkey", arr)
    orders = _agg_json(o, og, _ORDER_OBJ, "o_orderkey", lambda items, n, g: F.concat(
        F.lit('{"group": '), g.cast("string"), F.lit(', "source": "orders", "count": '), n.cast("string"),
        F.lit(', "orders": ['), items, F.lit("]}")))
    mixed = _agg_json(o, og, _MIXED_OBJ, "o_orderkey", arr)
    nested = _agg_json(c, cg, _CUSTOMER_OBJ, "c_custkey", lambda items, n, g: F.concat(
        F.lit('{"name": "segment-'), g.cast("string"), F.lit('", "empty": "", "nothing": null, "items": [], '
                                                             '"data": {"l1": {"l2": {"l3": {"l4": {"l5": {"l6": ['),
        items, F.lit(']}}}}}}, "size": '), n.cast("string"), F.lit("}")))
    parts = [("customers", customers), ("orders", orders), ("mixed", mixed), ("nested", nested), ("wide", wide)]
    out = None
    for kind, df in parts:
        df = df.select(F.concat(F.lit(kind + ":"), F.col("group_id").cast("bigint").cast("string")).alias("json_id"),
                       F.lit(kind).alias("kind"), "text")
        out = df if out is None else out.unionByName(df)
    return out


DUCK_JSON_PAYLOADS = """(
WITH cust AS (
  SELECT CAST(floor(c_custkey / 50) AS BIGINT) AS g, c_custkey,
    '{"c_custkey": ' || CAST(c_custkey AS VARCHAR) || ', "c_name": "' || c_name || '", "c_nationkey": ' || CAST(c_nationkey AS VARCHAR)
    || ', "c_acctbal": ' || CAST(CAST(c_acctbal AS DECIMAL(15, 2)) AS VARCHAR) || ', "c_mktsegment": "' || c_mktsegment
    || '", "note": ' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE '"vip | gold"' END || '}' AS o,
    '{' || array_to_string(list_transform(range(1, 17), lambda i: '"k' || CAST(i AS VARCHAR) || '": ' || CAST(c_custkey * i AS VARCHAR)), ', ') || '}' AS w
  FROM customer),
ord AS (
  SELECT CAST(floor(o_orderkey / 150) AS BIGINT) AS g, o_orderkey,
    '{"o_orderkey": ' || CAST(o_orderkey AS VARCHAR) || ', "o_custkey": ' || CAST(o_custkey AS VARCHAR) || ', "o_orderstatus": "' || o_orderstatus
    || '", "o_totalprice": ' || CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR) || ', "o_orderdate": "' || strftime(o_orderdate, '%Y-%m-%d')
    || '", "o_orderpriority": "' || o_orderpriority || '"}' AS o,
    CASE WHEN o_orderkey % 2 = 0 THEN '{"o_orderkey": ' || CAST(o_orderkey AS VARCHAR) || ', "o_orderstatus": "' || o_orderstatus || '"}'
         ELSE '{"o_orderkey": ' || CAST(o_orderkey AS VARCHAR) || ', "o_orderstatus": "' || o_orderstatus || '", "o_orderpriority": "' || o_orderpriority || '"}' END AS m
  FROM orders),
cg AS (SELECT g, string_agg(o, ', ' ORDER BY c_custkey) AS items, string_agg(w, ', ' ORDER BY c_custkey) AS witems, count(*) AS n FROM cust GROUP BY g),
og AS (SELECT g, string_agg(o, ', ' ORDER BY o_orderkey) AS items, string_agg(m, ', ' ORDER BY o_orderkey) AS mitems, count(*) AS n FROM ord GROUP BY g)
SELECT 'customers:' || CAST(g AS VARCHAR) AS json_id, 'customers' AS kind, '[' || items || ']' AS text FROM cg
UNION ALL SELECT 'orders:' || CAST(g AS VARCHAR), 'orders', '{"group": ' || CAST(g AS VARCHAR) || ', "source": "orders", "count": ' || CAST(n AS VARCHAR) || ', "orders": [' || items || ']}' FROM og
UNION ALL SELECT 'mixed:' || CAST(g AS VARCHAR), 'mixed', '[' || mitems || ']' FROM og
UNION ALL SELECT 'nested:' || CAST(g AS VARCHAR), 'nested', '{"name": "segment-' || CAST(g AS VARCHAR) || '", "empty": "", "nothing": null, "items": [], "data": {"l1": {"l2": {"l3": {"l4": {"l5": {"l6": [' || items || ']}}}}}}, "size": ' || CAST(n AS VARCHAR) || '}' FROM cg
UNION ALL SELECT 'wide:' || CAST(g AS VARCHAR), 'wide', '[' || witems || ']' FROM cg)"""
