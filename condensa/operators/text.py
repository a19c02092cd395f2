"""Long-text jobs: chunking (C1/W5), in-row BM25 (X1/X2/W3), greedy budget pick (W4),
reassembly (J7), head/middle/tail split (T4), budgeting (T5) and the reduction (C2).

A document is reduced independently of every other document, so the whole job is a
narrow, per-row projection: chunks, their terms, the statistics of the document's
own chunk collection, the ranking and the pick are arrays inside the row. No shuffle,
no join, and no skew from a document that splits into many chunks — the row is the
unit of work, as it is for the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import Config
from ..functions import exprs as E


def _tok(x: str) -> str:
    return f"CAST(ceil(octet_length({x}) / 4) AS BIGINT)"


def _piece_pattern(sep: str) -> str:
    """Pieces that end with ``sep`` (kept on the left piece), else the rest of the text."""
    esc = {"\n\n": "\\n\\n", "\n": "\\n", ". ": "\\. ", " ": " "}[sep]
    return "(?s)(.*?" + esc + "|.+)"


def chunk_expr(text: str, target: int = C.CHUNK_TARGET_TOKENS, overlap: int = C.CHUNK_OVERLAP_TOKENS) -> str:
    """ARRAY<STRING> of chunk texts for one text (structure-aware, with overlap).

    Text within the target is one chunk. Otherwise pieces over the target are split on
    blank lines, then lines, then sentences, then spaces (separator kept on the left);
    pieces still over 1.5x the target in characters are cut every target*4 characters;
    then pieces are merged left to right into chunks within the target, each new chunk
    starting with the last overlap*4 characters of the previous one. Overlap 0 means no
    overlap.
    """
    t = int(target)
    tc = t * 4
    oc = int(overlap) * 4
    segs = "array(_txt)"
    for sep in C.CHUNK_SEPARATORS:
        pat = E.sql_str(_piece_pattern(sep))
        segs = (f"flatten(transform({segs}, s -> IF({_tok('s')} > {t}, "
                f"regexp_extract_all(s, {pat}, 1), array(s))))")
    hard = (f"flatten(transform({segs}, s -> IF(length(s) > {tc * 1.5}, "
            f"regexp_extract_all(s, '(?s)(.{{1,{tc}}})', 1), array(s))))")
    tail = f"right(acc.cur, {oc})" if oc > 0 else "''"
    # Each step of a fold copies its state, so pieces go in slices of about the root of their number: a slice's
    # fold carries that slice's chunks only, and all chunks are copied once a slice.
    empty = "CAST(array() AS ARRAY<STRING>)"
    part = (
        f"aggregate(slice(_p, k * _w + 1, _w), named_struct('chunks', {empty}, 'cur', o.cur), "
        f"(acc, seg) -> IF(octet_length(acc.cur) + octet_length(seg) > {t * 4} AND acc.cur <> '', "
        f"named_struct('chunks', array_append(acc.chunks, acc.cur), 'cur', concat({tail}, seg)), "
        f"named_struct('chunks', acc.chunks, 'cur', concat(acc.cur, seg))))"
    )
    fold = (
        f"aggregate(sequence(0, CAST(ceil(size(_p) / _w) AS INT) - 1), named_struct('chunks', {empty}, 'cur', ''), "
        f"(o, k) -> " + E.let(part, "_s", "named_struct('chunks', concat(o.chunks, _s.chunks), 'cur', _s.cur)") + ", "
        f"o -> IF(o.cur <> '', array_append(o.chunks, o.cur), o.chunks))"
    )
    merged = E.let(hard, "_p", E.let("CAST(ceil(sqrt(size(_p))) AS INT)", "_w", fold))
    return E.let(text, "_txt", f"IF({_tok('_txt')} <= {t}, array(_txt), {merged})")


def with_chunks(df: DataFrame, text_col: str, out_col: str = "chunks",
                target: int = C.CHUNK_TARGET_TOKENS, overlap: int = C.CHUNK_OVERLAP_TOKENS) -> DataFrame:
    return df.withColumn(out_col, F.expr(chunk_expr(text_col, target, overlap)))


def explode_chunks(df: DataFrame, key_cols: list[str], chunks_col: str = "chunks") -> DataFrame:
    """Chunk table ``(keys..., chunk_index, text, tokens)``."""
    return (df.select(*key_cols, F.posexplode_outer(chunks_col).alias("chunk_index", "text"))
            .filter(F.col("chunk_index").isNotNull())
            .withColumn("tokens", F.expr(_tok("text"))))


# --- in-row BM25 over one document's chunks -------------------------------------
def scores_expr(chunks: str, query_terms: str, k1: float = C.BM25_K1, b: float = C.BM25_B) -> str:
    """ARRAY<DOUBLE>: BM25 score of every chunk against the query terms (a multiset).

    Statistics (N, average length, document frequency) are those of the row's own
    chunks; document frequencies are computed once per query term. An empty query
    scores every chunk 0.
    """
    # of a chunk's terms only their number and those that the query has are kept: each query term is counted among these
    counted = f"transform({chunks}, c -> " + E.let(E.tokenize("c"), "_all", "named_struct('n', size(_all), 'hits', filter(_all, w -> array_contains(_qd, w)))") + ")"
    body = (
        f"transform(_ts, t -> aggregate("
        f"transform(_qd, (x, j) -> named_struct('tf', size(filter(t.hits, w -> w = x)), 'df', _st.dfs[j], "
        f"'qtf', _st.qtf[j])), 0.0D, "
        f"(acc, y) -> acc + IF(y.tf = 0, 0.0D, y.qtf * "
        f"ln((_st.n - y.df + 0.5D) / (y.df + 0.5D) + 1.0D) * "
        f"(y.tf * {k1 + 1}D) / (y.tf + {k1}D * (1.0D - {b}D + {b}D * coalesce(try_divide(t.n, _st.avgdl), 0.0D))))))"
    )
    stats = (f"named_struct('n', size(_ts), "
             f"'avgdl', try_divide(CAST(aggregate(_ts, 0L, (a, t) -> a + t.n) AS DOUBLE), size(_ts)), "
             f"'dfs', transform(_qd, x -> size(filter(_ts, t -> array_contains(t.hits, x)))), "
             f"'qtf', transform(_qd, x -> size(filter(_q, y -> y = x))))")
    return E.let(f"coalesce({query_terms}, CAST(array() AS ARRAY<STRING>))", "_q",
                 E.let("array_distinct(_q)", "_qd",
                       E.let(counted, "_ts", E.let(stats, "_st", body))))


def with_chunk_scores(df: DataFrame, chunks_col: str, query_terms_col: str, out_col: str = "scores",
                      k1: float = C.BM25_K1, b: float = C.BM25_B) -> DataFrame:
    return df.withColumn(out_col, F.expr(scores_expr(chunks_col, query_terms_col, k1, b)))


def ranked_expr(chunks_col: str, scores_col: str) -> str:
    """Chunks ordered by score descending, ties in chunk order: ARRAY<STRUCT<neg, idx, tokens>>."""
    return E.let(scores_col, "_sc",
                 f"sort_array(transform({chunks_col}, (c, i) -> named_struct("
                 f"'neg', 0.0D - _sc[i], 'idx', i, 'tokens', {_tok('c')})))")


def greedy_pick_expr(ranked: str, budget: str) -> str:
    """Walk by rank; take a chunk when it fits the remaining budget, skip it otherwise.

    Returns the picked chunk indices in original order. Not a running sum: a chunk
    that does not fit is skipped and later, smaller chunks can still be taken.
    """
    return (f"array_sort(aggregate({ranked}, named_struct('rem', CAST({budget} AS BIGINT), "
            f"'picked', CAST(array() AS ARRAY<INT>)), "
            f"(acc, x) -> IF(acc.rem > 0 AND x.tokens <= acc.rem, "
            f"named_struct('rem', acc.rem - x.tokens, 'picked', array_append(acc.picked, x.idx)), acc), "
            f"acc -> acc.picked))")


def reassemble_expr(chunks_col: str, picked: str) -> str:
    """Picked chunks in original order, joined by the empty string (overlaps repeat)."""
    return E.let(chunks_col, "_ch", f"array_join(transform({picked}, i -> _ch[i]), '')")


def ranked_chunks_expr(text: str, query_terms: str, target: int, overlap: int) -> str:
    """STRUCT(chunks, ranked) of one text in one expression (each piece computed once)."""
    return E.let(chunk_expr(text, target, overlap), "_chs",
                 E.let(scores_expr("_chs", query_terms), "_scs",
                       f"named_struct('chunks', _chs, 'ranked', {ranked_expr('_chs', '_scs')})"))


def bm25_select_expr(text: str, query_terms: str, budget: str, target: int, overlap: int) -> str:
    """One expression: chunk, score, rank, pick within budget, reassemble."""
    return E.let(chunk_expr(text, target, overlap), "_chs",
                 E.let(scores_expr("_chs", query_terms), "_scs",
                       f"array_join(transform({greedy_pick_expr(ranked_expr('_chs', '_scs'), budget)}, "
                       f"i -> _chs[i]), '')"))


def bm25_select(df: DataFrame, text_col: str, query_terms_col: str, budget_col: str, out_col: str,
                target: int, overlap: int, when: str | None = None) -> DataFrame:
    """Chunk, rank and pick within a token budget; one output text per row.

    ``when`` (SQL) limits the work to rows that need it; other rows get ''.
    """
    e = bm25_select_expr(text_col, query_terms_col, budget_col, target, overlap)
    if when:
        e = f"IF({when}, {e}, '')"
    return df.withColumn(out_col, F.expr(e))


# --- T4: head / middle / tail --------------------------------------------------------
def with_head_middle_tail(df: DataFrame, text_col: str, head_tokens: int, tail_tokens: int,
                          window: int = C.NEWLINE_WINDOW) -> DataFrame:
    """Split by characters; boundaries move to a newline within +-window characters.

    Adds ``head``, ``middle``, ``tail``; ``middle`` is '' when the whole text is kept
    (short text, or boundaries that cross).
    """
    hc, tc, w = head_tokens * 4, tail_tokens * 4, window
    L = f"length({text_col})"
    df = df.withColumn("_hn", F.expr(f"locate('\\n', {text_col}, {max(hc - w, 0) + 1}) - 1"))
    df = df.withColumn("_head_end", F.expr(f"IF(_hn > 0 AND _hn < {hc + w}, _hn + 1, {hc})"))
    df = df.withColumn("_ts0", F.expr(f"{L} - {tc}"))
    df = df.withColumn("_ws", F.expr(f"greatest(_ts0 - {w - 1}, 0)"))
    df = df.withColumn("_win", F.expr(f"substring({text_col}, _ws + 1, greatest(_ts0 + {w} - _ws + 1, 0))"))
    df = df.withColumn("_r", F.expr("locate('\\n', reverse(_win))"))
    df = df.withColumn("_tn", F.expr("IF(_r > 0, _ws + length(_win) - _r, -1)"))
    df = df.withColumn("_tail_start", F.expr(f"IF(_tn > _ts0 - {w} AND _tn > _head_end, _tn + 1, _ts0)"))
    whole = f"({L} <= {hc + tc} OR _tail_start <= _head_end)"
    df = (df.withColumn("head", F.expr(f"IF({whole}, {text_col}, substring({text_col}, 1, _head_end))"))
            .withColumn("middle", F.expr(f"IF({whole}, '', substring({text_col}, _head_end + 1, _tail_start - _head_end))"))
            .withColumn("tail", F.expr(f"IF({whole}, '', substring({text_col}, _tail_start + 1))")))
    return df.drop("_hn", "_head_end", "_ts0", "_ws", "_win", "_r", "_tn", "_tail_start")


# --- T5: budgets ---------------------------------------------------------------------
def with_budget(df: DataFrame, text_col: str, cfg: Config) -> DataFrame:
    """Adds ``total_tokens``, ``target_tokens``, ``middle_tokens``, ``middle_target``."""
    return (df.withColumn("total_tokens", F.expr(_tok(text_col)))
              .withColumn("target_tokens", F.expr(E.js_round(f"total_tokens * {C.TRUNCATE_RATIO}")))
              .withColumn("middle_tokens", F.expr(_tok("middle")))
              .withColumn("middle_target", F.expr(
                  f"greatest(target_tokens - {_tok('head')} - {_tok('tail')}, {cfg.min_middle_target})")))


def marker_expr(before: str, after: str) -> str:
    return (f"concat('\\n[... middle compressed: ', {E.fmt_int(before)}, '→', {E.fmt_int(after)}, "
            f"' tokens ...]\\n')")


def reduce_long_text(df: DataFrame, text_col: str, query_terms_col: str, cfg: Config,
                     summaries_col: str | None = None, out_col: str = "reduced") -> DataFrame:
    """Head + marker + relevance-ranked middle within budget + tail.

    With ``summaries_col`` (an externally produced summary of the middle, may be NULL)
    the second-pass path is taken: BM25 first narrows to twice the budget, then the
    summary replaces the middle where present, else BM25 runs again at the budget.
    Rows whose text fits head + tail are returned unchanged.
    """
    df = with_head_middle_tail(df, text_col, cfg.head_tokens, cfg.tail_tokens)
    df = with_budget(df, text_col, cfg)
    first_budget = "middle_target * 2" if summaries_col else "middle_target"
    df = df.withColumn("_budget1", F.expr(first_budget))
    df = bm25_select(df, "middle", query_terms_col, "_budget1", "_bm25_1", cfg.chunk_target, cfg.chunk_overlap,
                     when="middle_tokens > middle_target * 3" if summaries_col else "middle_tokens > middle_target")
    df = df.withColumn("_mid", F.expr("IF(middle_tokens > middle_target * 3, _bm25_1, middle)"))
    df = df.withColumn("_after1", F.expr(_tok("_mid")))
    if summaries_col:
        df = bm25_select(df, "middle", query_terms_col, "middle_target", "_bm25_2", cfg.chunk_target,
                         cfg.chunk_overlap, when="_after1 > middle_target")
        second = (f"CASE WHEN _after1 > middle_target AND _after1 >= {C.MIN_SECOND_PASS_INPUT} "
                  f"THEN coalesce(nullif({summaries_col}, ''), _bm25_2) "
                  f"WHEN _after1 > middle_target THEN _bm25_2 ELSE _mid END")
        df = df.withColumn("compressed_middle", F.expr(second)).drop("_bm25_2")
    else:
        # Without a second pass, a middle over budget is re-ranked at the budget: the
        # first pass already ran at the budget, so its picks are the answer.
        df = df.withColumn("compressed_middle", F.expr(
            "IF(_after1 > middle_target, _bm25_1, _mid)"))
    df = df.withColumn("final_middle_tokens", F.expr(_tok("compressed_middle")))
    out = (f"IF(middle = '' OR total_tokens <= target_tokens, {text_col}, "
           f"concat(head, {marker_expr('middle_tokens', 'final_middle_tokens')}, compressed_middle, tail))")
    return (df.withColumn(out_col, F.expr(out)).withColumn("first_pass_tokens", F.col("_after1"))
              .drop("_budget1", "_bm25_1", "_mid", "_after1"))
