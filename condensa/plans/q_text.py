"""Text queries: tokens, chunks, BM25, budgets and the long-text reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..config import FIXTURE_CONFIG as CFG
from ..functions import exprs as E
from ..functions import keywords as K
from ..operators import bm25 as BM
from ..operators import search_index as SI
from ..operators import text as T
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources.tables import spread, table
from . import duck as D
from .registry import query

TGT, OVL = CFG.chunk_target, CFG.chunk_overlap

# DuckDB twin of FX.document_calls.
DOC_CALLS = """(
SELECT doc_id, 'read_document' AS tool_name,
       json_object('path', 'corpus/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt',
                   'query', split_part(text, '.', 1)) AS args, text
FROM documents)"""


def _doc_query_terms(df):
    """Query terms of a hook-mode call: own arguments, and the call itself as history."""
    q = K.synthetic_query("tool_name", "args", ["args"])
    return df.withColumn("query", F.expr(q)).withColumn("q", F.expr(E.tokenize("query")))


def _duck_doc_q(src=DOC_CALLS):
    return (f"(SELECT *, {D.synthetic_query('tool_name', 'args', ['args'])} AS query FROM {src})", )


def _duck_docs_with_chunks(extra_cols: str = "") -> str:
    """CTEs: d (calls + query + q), c (chunks). Chunks at the fixture size."""
    return f"""
d AS (SELECT *, {D.synthetic_query('tool_name', 'args', ['args'])} AS query FROM {DOC_CALLS} x),
dq AS (SELECT *, {D.tokenize('query')} AS q FROM d),
c0 AS (SELECT *, {D.chunk_fold('text', TGT, OVL)} AS m FROM dq),
c AS (SELECT * EXCLUDE (m), {D.chunk_finish('m')} AS chunks FROM c0)"""


# X1 ---------------------------------------------------------------------------
@query("tokenize_terms", oracle=f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, array_to_string(t, ' ') AS terms
FROM (SELECT doc_id, {D.tokenize('text')} AS t FROM documents)""")
def tokenize_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = d.select("doc_id", F.expr(E.tokenize("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_terms"), F.array_join("t", " ").alias("terms"))


# X4 / X5 / X7 -----------------------------------------------------------------
@query("url_keywords", oracle=f"SELECT page_id, {D.url_kw('url')} AS keywords FROM pages")
def url_keywords(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.expr(K.url_keywords("url")).alias("keywords"))


@query("path_keywords", oracle=f"""
SELECT doc_id, {D.path_kw("json_extract_string(args, '$.path')")} AS keywords FROM {DOC_CALLS} x""")
def path_keywords(spark, sf_dir):
    d = FX.document_calls(spark, sf_dir)
    return d.select("doc_id", F.expr(K.path_keywords("get_json_object(args, '$.path')")).alias("keywords"))


@query("synthetic_query", oracle=f"""
SELECT doc_id, {D.synthetic_query('tool_name', 'args', ['args'])} AS query FROM {DOC_CALLS} x""")
def synthetic_query(spark, sf_dir):
    d = FX.document_calls(spark, sf_dir)
    return _doc_query_terms(d).select("doc_id", "query")


# C1 ---------------------------------------------------------------------------
@query("chunk_text", oracle=f"""
WITH c0 AS (SELECT doc_id, {D.chunk_fold('text', TGT, OVL)} AS m FROM documents),
c AS (SELECT doc_id, {D.chunk_finish('m')} AS chunks FROM c0),
u AS (SELECT doc_id, unnest(range(len(chunks))) AS chunk_index, unnest(chunks) AS text FROM c)
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, {D.tokens('text')} AS tokens, text FROM u""")
def chunk_text(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    c = T.with_chunks(d, "text", "chunks", TGT, OVL)
    return T.explode_chunks(c, ["doc_id"]).select("doc_id", "chunk_index", "tokens", "text")


# X2 + W3 ------------------------------------------------------------------------
def _ranked_docs(spark, sf_dir):
    d = spread(FX.document_calls(spark, sf_dir), "doc_id")
    d = _doc_query_terms(d)
    d = d.withColumn("_r", F.expr(T.ranked_chunks_expr("text", "q", TGT, OVL)))
    return d.select("*", F.col("_r.chunks").alias("chunks"), F.col("_r.ranked").alias("ranked")).drop("_r")


_BM25_CTES, _BM25_LAST = D.bm25_ctes("c")


@query("bm25_rank_chunks", oracle=f"""
WITH {_duck_docs_with_chunks()}, {_BM25_CTES},
u AS (SELECT doc_id, unnest(range(len(ranked))) AS r, unnest(ranked) AS x FROM {_BM25_LAST})
SELECT doc_id, CAST(x.idx AS INTEGER) AS chunk_index, round(0.0 - x.neg, 6) AS score,
       CAST(r + 1 AS INTEGER) AS rank FROM u""")
def bm25_rank_chunks(spark, sf_dir):
    d = _ranked_docs(spark, sf_dir)
    # The outer form: an inner explode makes Spark infer a size(...) > 0 filter and push it
    # below the shuffle, which would evaluate the whole ranking there a second time.
    u = (d.select("doc_id", F.posexplode_outer("ranked").alias("r", "x")).filter(F.col("r").isNotNull()))
    return u.select("doc_id", F.col("x.idx").alias("chunk_index"), F.round(-F.col("x.neg"), 6).alias("score"),
                    (F.col("r") + 1).alias("rank"))


# W4 + J7 ------------------------------------------------------------------------
@query("greedy_budget", oracle=f"""
WITH {_duck_docs_with_chunks()}, {_BM25_CTES},
p AS (SELECT doc_id, chunks, CAST(ceil({D.tokens('text')} / 4) AS BIGINT) AS budget, ranked FROM {_BM25_LAST}),
g AS (SELECT *, {D.greedy('ranked', 'budget')} AS picked FROM p)
SELECT doc_id, CAST(len(chunks) AS INTEGER) AS n_chunks, budget,
       array_to_string(picked, ',') AS picked,
       CAST(coalesce(list_sum(list_transform(picked, lambda i: {D.tokens('chunks[i + 1]')})), 0) AS BIGINT) AS picked_tokens,
       {D.tokens(D.reassemble('chunks', 'picked'))} AS text_tokens
FROM g""")
def greedy_budget(spark, sf_dir):
    d = _ranked_docs(spark, sf_dir)
    d = d.withColumn("budget", F.expr(f"CAST(ceil({E.token_estimate('text')} / 4) AS BIGINT)"))
    d = d.withColumn("picked", F.expr(T.greedy_pick_expr("ranked", "budget")))
    return d.select(
        "doc_id", F.size("chunks").alias("n_chunks"), "budget",
        F.array_join("picked", ",").alias("picked"),
        F.expr(f"aggregate(picked, 0L, (a, i) -> a + {E.token_estimate('chunks[i]')})").alias("picked_tokens"),
        F.expr(E.token_estimate(T.reassemble_expr("chunks", "picked"))).alias("text_tokens"))


# T4 ---------------------------------------------------------------------------
def _duck_hmt(src: str, text: str, h: int, t: int, w: int = 200) -> str:
    hc, tc = h * 4, t * 4
    return f"""
h0 AS (SELECT *, length({text}) AS _l, strpos(substr({text}, {max(hc - w, 0) + 1}), chr(10)) AS _p FROM {src}),
h1 AS (SELECT *, CASE WHEN _p > 0 THEN _p - 1 + {max(hc - w, 0)} ELSE -1 END AS _hn FROM h0),
h2 AS (SELECT *, CASE WHEN _hn > 0 AND _hn < {hc + w} THEN _hn + 1 ELSE {hc} END AS _head_end,
              _l - {tc} AS _ts0, greatest(_l - {tc} - {w - 1}, 0) AS _ws FROM h1),
h3 AS (SELECT *, substr({text}, _ws + 1, greatest(_ts0 + {w} - _ws + 1, 0)) AS _win FROM h2),
h4 AS (SELECT *, strpos(reverse(_win), chr(10)) AS _r FROM h3),
h5 AS (SELECT *, CASE WHEN _r > 0 THEN _ws + length(_win) - _r ELSE -1 END AS _tn FROM h4),
h6 AS (SELECT *, CASE WHEN _tn > _ts0 - {w} AND _tn > _head_end THEN _tn + 1 ELSE _ts0 END AS _tail_start FROM h5),
hmt AS (SELECT *, (_l <= {hc + tc} OR _tail_start <= _head_end) AS _whole FROM h6),
split AS (SELECT * EXCLUDE (_l, _p, _hn, _head_end, _ts0, _ws, _win, _r, _tn, _tail_start, _whole),
  CASE WHEN _whole THEN {text} ELSE substr({text}, 1, _head_end) END AS head,
  CASE WHEN _whole THEN '' ELSE substr({text}, _head_end + 1, _tail_start - _head_end) END AS middle,
  CASE WHEN _whole THEN '' ELSE substr({text}, _tail_start + 1) END AS tail FROM hmt)"""


@query("head_middle_tail", oracle=f"""
WITH {_duck_hmt('documents', 'text', CFG.head_tokens, CFG.tail_tokens)}
SELECT doc_id, CAST(length(head) AS INTEGER) AS head_chars, CAST(length(middle) AS INTEGER) AS middle_chars,
       CAST(length(tail) AS INTEGER) AS tail_chars, md5(head) AS head_md5, md5(tail) AS tail_md5 FROM split""")
def head_middle_tail(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = T.with_head_middle_tail(d, "text", CFG.head_tokens, CFG.tail_tokens)
    return s.select("doc_id", F.length("head").alias("head_chars"), F.length("middle").alias("middle_chars"),
                    F.length("tail").alias("tail_chars"), F.md5("head").alias("head_md5"),
                    F.md5("tail").alias("tail_md5"))


# T5 ---------------------------------------------------------------------------
def _duck_budget(src: str) -> str:
    return f"""
bud0 AS (SELECT *, {D.tokens('text')} AS total_tokens FROM {src}),
bud AS (SELECT *, {D.js_round('total_tokens * 0.5')} AS target_tokens, {D.tokens('middle')} AS middle_tokens,
        greatest({D.js_round('total_tokens * 0.5')} - {D.tokens('head')} - {D.tokens('tail')}, {CFG.min_middle_target}) AS middle_target
        FROM bud0)"""


@query("truncate_budget", oracle=f"""
WITH large AS (SELECT * FROM documents WHERE {D.tokens('text')} > {CFG.text_threshold}),
{_duck_hmt('large', 'text', CFG.head_tokens, CFG.tail_tokens)}, {_duck_budget('split')}
SELECT doc_id, total_tokens, target_tokens, middle_tokens, middle_target,
       middle_tokens > middle_target * 3 AS preselect, middle_tokens > middle_target AS over_budget FROM bud""")
def truncate_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.filter(F.expr(f"{E.token_estimate('text')} > {CFG.text_threshold}"))
    s = T.with_budget(T.with_head_middle_tail(d, "text", CFG.head_tokens, CFG.tail_tokens), "text", CFG)
    return s.select("doc_id", "total_tokens", "target_tokens", "middle_tokens", "middle_target",
                    F.expr("middle_tokens > middle_target * 3").alias("preselect"),
                    F.expr("middle_tokens > middle_target").alias("over_budget"))


# C2 ---------------------------------------------------------------------------
def _duck_reduce_ctes(src: str, summaries: str | None = None, first_only: bool = False) -> str:
    """CTEs from a relation with (doc_id, text, q[, summary]) to ``red`` with ``reduced``."""
    bm1, last1 = D.bm25_ctes("r1", p="_a")
    budget1 = "middle_target * 2" if summaries else "middle_target"
    out = f"""
{_duck_hmt(src, 'text', CFG.head_tokens, CFG.tail_tokens)}, {_duck_budget('split')},
r0 AS (SELECT *, CASE WHEN middle_tokens > middle_target THEN {D.chunk_fold('middle', TGT, OVL)}
                      ELSE {{'chunks': []::VARCHAR[], 'cur': ''}} END AS m FROM bud),
r1 AS (SELECT * EXCLUDE (m), {D.chunk_finish('m')} AS chunks FROM r0), {bm1},
r2 AS (SELECT * EXCLUDE (ct, dfs, avgdl, scores),
              {D.reassemble('chunks', D.greedy('ranked', budget1))} AS bm1 FROM {last1}),
r3 AS (SELECT *, CASE WHEN middle_tokens > middle_target * 3 THEN bm1 ELSE middle END AS mid FROM r2),
r4 AS (SELECT *, {D.tokens('mid')} AS after1 FROM r3)"""
    if first_only:
        return out
    if summaries:
        bm2, last2 = D.bm25_ctes("r5", p="_b")
        out += f""",
r5 AS (SELECT * EXCLUDE (chunks, ranked), CASE WHEN after1 > middle_target THEN {D.chunk_finish(D.chunk_fold('middle', TGT, OVL))}
                      ELSE []::VARCHAR[] END AS chunks FROM r4), {bm2},
r6 AS (SELECT * EXCLUDE (ct, dfs, avgdl, scores),
              {D.reassemble('chunks', D.greedy('ranked', 'middle_target'))} AS bm2 FROM {last2}),
r7 AS (SELECT *, CASE WHEN after1 > middle_target AND after1 >= 5000 THEN coalesce(summary, bm2)
                      WHEN after1 > middle_target THEN bm2 ELSE mid END AS compressed_middle FROM r6)"""
    else:
        out += """,
r7 AS (SELECT *, CASE WHEN after1 > middle_target THEN bm1 ELSE mid END AS compressed_middle FROM r4)"""
    out += f""",
red AS (SELECT *, {D.tokens('compressed_middle')} AS final_middle_tokens,
  CASE WHEN middle = '' OR total_tokens <= target_tokens THEN text
       ELSE head || chr(10) || '[... middle compressed: ' || {D.fmt_int('middle_tokens')} || '→'
            || {D.fmt_int(D.tokens('compressed_middle'))} || ' tokens ...]' || chr(10) || compressed_middle || tail
  END AS reduced FROM r7)"""
    return out


@query("reduce_long_text", oracle=f"""
WITH d AS (SELECT *, {D.synthetic_query('tool_name', 'args', ['args'])} AS query FROM {DOC_CALLS} x
           WHERE {D.tokens('text')} > {CFG.text_threshold}),
dq AS (SELECT doc_id, text, {D.tokenize('query')} AS q FROM d),
{_duck_reduce_ctes('dq')}
SELECT doc_id, total_tokens AS before, {D.tokens('reduced')} AS after, final_middle_tokens, md5(reduced) AS reduced_md5
FROM red""")
def reduce_long_text(spark, sf_dir):
    d = FX.document_calls(spark, sf_dir)
    d = d.filter(F.expr(f"{E.token_estimate('text')} > {CFG.text_threshold}"))
    d = _doc_query_terms(spread(d, "doc_id"))
    r = T.reduce_long_text(d, "text", "q", CFG)
    return r.select("doc_id", F.col("total_tokens").alias("before"),
                    F.expr(E.token_estimate("reduced")).alias("after"), "final_middle_tokens",
                    F.md5("reduced").alias("reduced_md5"))


# X3 ---------------------------------------------------------------------------
def _duck_search(k: int = 10) -> str:
    return f"""
WITH qt AS (SELECT item_id AS query_id, term, count(*) AS qtf
            FROM (SELECT item_id, unnest({D.tokenize('text')}) AS term FROM benchmark) GROUP BY ALL),
dt AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM (SELECT doc_id, {D.tokenize('text')} AS t FROM documents)),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n_docs, avg(len({D.tokenize('text')})) AS avgdl FROM documents),
sc AS (SELECT query_id, doc_id,
         sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1.0)
             * (tf * {1.5 + 1}) / (tf + 1.5 * (1.0 - 0.75 + 0.75 * (dl / avgdl)))) AS s
       FROM qt JOIN tf USING (term) JOIN dfq USING (term) CROSS JOIN st GROUP BY query_id, doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM sc)
SELECT query_id, doc_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= {k}"""


@query("bm25_corpus_search", oracle=_duck_search(10))
def bm25_corpus_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return BM.search(docs, "doc_id", "text", bench, "item_id", "text", top_k=10)


@query("bm25_index_search", oracle=_duck_search(10))
def bm25_index_search(spark, sf_dir):
    """X3 through the stored index: built from the documents, then searched for every benchmark item."""
    path = scratch_path(spark, "search-index")
    SI.build(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", path)
    return SI.search(spark, path, table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text", top_k=10)


# T5 second pass + J6 ----------------------------------------------------------------------
def _summaries(spark, sf_dir):
    """External summaries stand-in: documents with a quality label of 1 have one."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").filter("quality = 1")
    return d.join(lab, "doc_id", "left_semi").select(
        "doc_id", F.concat(F.lit("Summary of document "), F.col("doc_id").cast("string"), F.lit(": "),
                           F.substring_index("text", ".", 1)).alias("summary"))


DUCK_SUMMARIES = """(SELECT doc_id, 'Summary of document ' || CAST(doc_id AS VARCHAR) || ': ' || split_part(text, '.', 1) AS summary
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"""


def _second_pass_input(spark, sf_dir):
    d = FX.document_calls(spark, sf_dir)
    d = d.filter(F.expr(f"{E.token_estimate('text')} > {CFG.text_threshold}"))
    return _doc_query_terms(spread(d, "doc_id"))


@query("second_pass_candidates", oracle=f"""
WITH d AS (SELECT *, {D.synthetic_query('tool_name', 'args', ['args'])} AS query FROM {DOC_CALLS} x
           WHERE {D.tokens('text')} > {CFG.text_threshold}),
dq AS (SELECT doc_id, text, {D.tokenize('query')} AS q FROM d),
{_duck_reduce_ctes('dq', summaries='s', first_only=True)}
SELECT doc_id, middle_tokens, middle_target, after1 AS after_first_pass,
       length(replace({D.s(C.DEFAULT_COMPRESSION_PROMPT)}, '{{TARGET}}', {D.fmt_int('middle_target')})) AS prompt_chars
FROM r4 WHERE middle <> '' AND after1 > middle_target AND after1 >= {C.MIN_SECOND_PASS_INPUT}""")
def second_pass_candidates(spark, sf_dir):
    """T5: middles still over budget after the first BM25 pass (to twice the budget) and
    large enough for an external summary; the prompt carries the target."""
    d = _second_pass_input(spark, sf_dir)
    d = T.with_budget(T.with_head_middle_tail(d, "text", CFG.head_tokens, CFG.tail_tokens), "text", CFG)
    d = d.withColumn("_b2", F.expr("middle_target * 2"))
    d = T.bm25_select(d, "middle", "q", "_b2", "_bm1", TGT, OVL, when="middle_tokens > middle_target * 3")
    d = d.withColumn("after_first_pass", F.expr(f"{E.token_estimate('IF(middle_tokens > middle_target * 3, _bm1, middle)')}"))
    prompt = F.expr(f"replace({E.sql_str(C.DEFAULT_COMPRESSION_PROMPT)}, '{{TARGET}}', {E.fmt_int('middle_target')})")
    return (d.filter(F.expr(f"middle <> '' AND after_first_pass > middle_target AND after_first_pass >= {C.MIN_SECOND_PASS_INPUT}"))
            .select("doc_id", "middle_tokens", "middle_target", "after_first_pass", F.length(prompt).alias("prompt_chars")))


@query("summary_fallback", oracle=f"""
WITH d AS (SELECT *, {D.synthetic_query('tool_name', 'args', ['args'])} AS query FROM {DOC_CALLS} x
           WHERE {D.tokens('text')} > {CFG.text_threshold}),
dq AS (SELECT d.doc_id, d.text, {D.tokenize('d.query')} AS q, s.summary FROM d LEFT JOIN {DUCK_SUMMARIES} s ON s.doc_id = d.doc_id),
{_duck_reduce_ctes('dq', summaries='s')}
SELECT doc_id, (summary IS NOT NULL AND after1 > middle_target AND after1 >= {C.MIN_SECOND_PASS_INPUT}) AS used_summary,
       {D.tokens('reduced')} AS after, md5(reduced) AS reduced_md5
FROM red""")
def summary_fallback(spark, sf_dir):
    """Where a summary exists for a second-pass candidate it replaces the middle;
    elsewhere BM25 runs again at the budget."""
    d = _second_pass_input(spark, sf_dir).join(_summaries(spark, sf_dir), "doc_id", "left")
    r = T.reduce_long_text(d, "text", "q", CFG, summaries_col="summary")
    used = F.expr(f"summary IS NOT NULL AND first_pass_tokens > middle_target AND first_pass_tokens >= {C.MIN_SECOND_PASS_INPUT}")
    return r.select("doc_id", used.alias("used_summary"), F.expr(E.token_estimate("reduced")).alias("after"),
                    F.md5("reduced").alias("reduced_md5"))
