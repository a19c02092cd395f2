"""JSON queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as E
from ..operators import jsonops as J
from ..sources.json_fixtures import DUCK_JSON_PAYLOADS, json_payloads
from ..sources.tables import spread
from . import duck as D
from .registry import query

P = DUCK_JSON_PAYLOADS


def _duck_profile() -> str:
    return f"""
WITH p AS (SELECT json_id, text, json_type(text) = 'ARRAY' AS is_array,
                  CASE WHEN json_type(text) = 'ARRAY' THEN json_extract(text, '$[*]') END AS a FROM {P} x),
q AS (SELECT *, coalesce({D.homog('a')}, false) AS homogeneous, CASE WHEN len(a) > 0 THEN json_keys(a[1]) END AS sch FROM p)
SELECT json_id, is_array, CAST(len(a) AS INTEGER) AS n_items, homogeneous,
       array_to_string(sch, ',') AS schema,
       round(CASE WHEN len(a) > 0 THEN {D.scalar_share('a', 'sch')} END, 6) AS scalar_share,
       coalesce(homogeneous AND len(sch) <= {C.TABLE_MAX_COLS} AND len(a) >= 2
                AND {D.scalar_share('a', 'sch')} >= {C.TABULAR_MIN_SCALAR_SHARE}, false) AS tabular
FROM q"""


@query("json_homogeneous", oracle=f"SELECT json_id, is_array, n_items, homogeneous, schema FROM ({_duck_profile()})")
def json_homogeneous(spark, sf_dir):
    return J.array_profile(json_payloads(spark, sf_dir), "text").select(
        "json_id", "is_array", "n_items", "homogeneous", "schema")


@query("json_tabular", oracle=f"SELECT json_id, homogeneous, scalar_share, tabular FROM ({_duck_profile()})")
def json_tabular(spark, sf_dir):
    return J.array_profile(json_payloads(spark, sf_dir), "text").select(
        "json_id", "homogeneous", "scalar_share", "tabular")


@query("json_to_table", oracle=f"""
WITH t AS (SELECT json_id, text, {D.tokens('text')} AS before_tokens,
                  CASE WHEN {D.tokens('text')} > {C.JSON_MIN_TOKENS} AND {D.json_looking('text')} AND json_valid(text)
                       THEN {D.jrender('text')} END AS tbl FROM {P} x),
o AS (SELECT *, CASE WHEN tbl IS NOT NULL AND {D.tokens('tbl')} < before_tokens THEN
        '[JSON → table — ' || {D.fmt_int('before_tokens')} || ' tokens → ' || {D.fmt_int(D.tokens('tbl'))} || ']' || chr(10) || tbl
      END AS out FROM t)
SELECT json_id, before_tokens, CASE WHEN out IS NOT NULL THEN {D.tokens('out')} END AS table_tokens,
       md5(out) AS table_md5 FROM o""")
def json_to_table(spark, sf_dir):
    p = J.with_table(json_payloads(spark, sf_dir), "text", "out")
    return p.select("json_id", F.expr(E.token_estimate("text")).alias("before_tokens"),
                    F.when(F.col("out").isNotNull(), F.expr(E.token_estimate("out"))).alias("table_tokens"),
                    F.md5("out").alias("table_md5"))


@query("json_array_sample", oracle=f"""
WITH arrays AS (
  SELECT json_id, '$' AS path, text AS t FROM {P} x WHERE json_type(text) = 'ARRAY'
  UNION ALL
  SELECT json_id, '$.' || k, json_extract(text, {D.kpath('k')})
  FROM (SELECT json_id, text, unnest(json_keys(text)) AS k FROM {P} y WHERE json_type(text) = 'OBJECT')
  WHERE json_type(text, {D.kpath('k')}) = 'ARRAY'),
e AS (SELECT json_id, path, json_extract(t, '$[*]') AS a FROM arrays)
SELECT json_id, path, CAST(len(a) AS INTEGER) AS n_items,
  CASE WHEN coalesce({D.homog('a')}, false)
       THEN '... ' || CAST(len(a) - {C.JSON_MAX_ARRAY_ITEMS} AS VARCHAR) || ' more items with same shape {{' || array_to_string(json_keys(a[1]), ', ') || '}}'
       ELSE '... ' || CAST(len(a) - {C.JSON_MAX_ARRAY_ITEMS} AS VARCHAR) || ' more items (' || CAST(len(a) AS VARCHAR) || ' total)' END AS line
FROM e WHERE len(a) > {C.JSON_ARRAY_THRESHOLD}""")
def json_array_sample(spark, sf_dir):
    p = json_payloads(spark, sf_dir)
    top = p.filter(F.expr(f"{J.kind('try_parse_json(text)')} = 'array'")).select(
        "json_id", F.lit("$").alias("path"), F.col("text").alias("t"))
    members = (J.children(p.filter(F.expr(f"{J.kind('try_parse_json(text)')} = 'object'"))
                          .withColumn("path", F.lit("$")), "text", "path")
               .filter(F.col("child_kind") == "array")
               .select("json_id", F.col("child_path").alias("path"), F.col("child_value").alias("t")))
    arrays = top.unionByName(members)
    return (arrays.withColumn("n_items", F.size(F.expr("from_json(t, 'array<string>')")))
            .withColumn("line", F.expr(J.sample_line_expr("t")))
            .filter(F.col("n_items") > C.JSON_ARRAY_THRESHOLD)
            .select("json_id", "path", "n_items", "line"))


@query("json_strip_empty", oracle=f"""
WITH o AS (SELECT json_id, text, json_keys(text) AS ks FROM {P} x WHERE json_type(text) = 'OBJECT'),
k AS (SELECT json_id, ks, list_filter(ks, lambda k: NOT ({D.jkind('text', D.kpath('k'))} = 'null'
        OR ({D.jkind('text', D.kpath('k'))} = 'string' AND json_extract_string(text, {D.kpath('k')}) = '')
        OR ({D.jkind('text', D.kpath('k'))} = 'array' AND json_array_length(text, {D.kpath('k')}) = 0))) AS kept FROM o)
SELECT json_id, array_to_string(kept, ',') AS kept_keys, CAST(len(ks) - len(kept) AS INTEGER) AS n_dropped FROM k""")
def json_strip_empty(spark, sf_dir):
    p = json_payloads(spark, sf_dir).filter(F.expr(f"{J.kind('try_parse_json(text)')} = 'object'"))
    k = p.withColumn("kept", F.expr(J.strip_empty_expr("text"))).withColumn(
        "n_keys", F.size(F.expr("from_json(text, 'map<string,string>')")))
    return k.select("json_id", F.array_join("kept", ",").alias("kept_keys"),
                    (F.col("n_keys") - F.size("kept")).alias("n_dropped"))


def _duck_shred() -> str:
    def level(src: str, depth: int) -> str:
        return f"""
  SELECT json_id, path AS parent, path || '.' || k AS path, {depth} AS depth, k AS key, CAST(i AS INTEGER) AS pos,
         {D.jkind('value', D.kpath('k'))} AS kind, json_extract(value, {D.kpath('k')}) AS v
  FROM (SELECT json_id, path, value, unnest(json_keys(value)) AS k, unnest(range(len(json_keys(value)))) AS i
        FROM {src} WHERE json_type(value) = 'OBJECT')
  UNION ALL
  SELECT json_id, path, path || '[' || CAST(i AS VARCHAR) || ']', {depth}, CAST(NULL AS VARCHAR), CAST(i AS INTEGER),
         {D.jkind('e')}, e
  FROM (SELECT json_id, path, unnest(json_extract(value, '$[*]')) AS e, unnest(range(CAST(json_array_length(value) AS BIGINT))) AS i
        FROM {src} WHERE json_type(value) = 'ARRAY')"""
    ctes, depths = [f"l0 AS (SELECT json_id, '$' AS path, text AS value FROM {P} x)"], range(1, C.JSON_MAX_DEPTH + 1)
    for d in depths:
        ctes.append(f"n{d} AS ({level(f'l{d - 1}', d)})")
        ctes.append(f"l{d} AS (SELECT json_id, path, v AS value FROM n{d} WHERE kind IN ('object', 'array'))")
    ctes.append("n AS (" + " UNION ALL ".join(f"SELECT * FROM n{d}" for d in depths) + ")")
    return f"""
WITH {", ".join(ctes)}
SELECT json_id, path, depth, parent, key, pos, kind,
       CASE WHEN kind NOT IN ('object', 'array') THEN json_extract_string(v, '$') END AS scalar,
       CAST(CASE kind WHEN 'object' THEN len(json_keys(v)) WHEN 'array' THEN json_array_length(v) ELSE 0 END AS INTEGER) AS n_children
FROM n"""


@query("json_shred", oracle=_duck_shred())
def json_shred(spark, sf_dir):
    return J.shred(spread(json_payloads(spark, sf_dir), "json_id"), "json_id", "text")


@query("json_shape_profile", oracle=f"""
WITH s AS ({_duck_shred()})
SELECT split_part(json_id, ':', 1) AS payload_kind, depth, kind, count(*) AS n_nodes,
       sum(n_children) AS n_children, count(DISTINCT json_id) AS n_payloads
FROM s GROUP BY ALL""")
def json_shape_profile(spark, sf_dir):
    s = J.shred(spread(json_payloads(spark, sf_dir), "json_id"), "json_id", "text")
    return (s.groupBy(F.split("json_id", ":")[0].alias("payload_kind"), "depth", "kind")
            .agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("n_children").alias("n_children"),
                 F.countDistinct("json_id").alias("n_payloads")))


def duck_reduced(src: str, id_col: str) -> str:
    """SQL: id, before, reduced of the JSON texts of ``src``."""
    return f"""
WITH p AS MATERIALIZED (SELECT {id_col}, text, {D.tokens('text')} AS before,
             CASE WHEN {D.tokens('text')} > {C.JSON_MIN_TOKENS} AND {D.json_looking('text')} AND json_valid(text) THEN {D.jrender('text')} END AS tbl FROM {src} x),
t AS MATERIALIZED (SELECT *, CASE WHEN tbl IS NOT NULL AND {D.tokens('tbl')} < before THEN
        '[JSON → table — ' || {D.fmt_int('before')} || ' tokens → ' || {D.fmt_int(D.tokens('tbl'))} || ']' || chr(10) || tbl END AS t1 FROM p),
c AS MATERIALIZED (SELECT *, CASE WHEN t1 IS NULL AND before > {C.JSON_MIN_TOKENS} AND {D.json_looking('text')} AND json_valid(text)
                     THEN {D.jprinted('text::JSON', 0)} END AS body FROM t)
SELECT {id_col}, before, coalesce(t1, CASE WHEN {D.tokens('body')} < before THEN
        '[JSON collapsed — original had ' || {D.fmt_int('before')} || ' tokens]' || chr(10) || body END, text) AS reduced FROM c"""


@query("json_reduced_text", oracle=f"""
SELECT json_id, before, {D.tokens('reduced')} AS after, md5(reduced) AS reduced_md5 FROM ({duck_reduced(P, 'json_id')})""")
def json_reduced_text(spark, sf_dir):
    """K7 → K5 → K4 end to end."""
    p = J.reduce_json(json_payloads(spark, sf_dir), "text")
    return p.select("json_id", F.expr(E.token_estimate("text")).alias("before"),
                    F.expr(E.token_estimate("reduced")).alias("after"), F.md5("reduced").alias("reduced_md5"))
