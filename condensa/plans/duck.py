"""DuckDB SQL fragments for the oracle queries.

The oracle runs each query's plain-SQL twin in DuckDB over the same parquet tables.
These helpers mirror ``condensa.functions.exprs`` and ``condensa.sources.fixtures`` in
DuckDB's dialect (RE2 regexes, 1-based lambdas, ``list_*`` functions).
"""

from __future__ import annotations

from .. import config as C


def s(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(s(v) for v in values) + "]"


def tokens(x: str) -> str:
    return f"CAST(ceil(strlen(coalesce({x}, '')) / 4) AS BIGINT)"


def block_tokens(t: str, x: str, d: str) -> str:
    return (f"CASE WHEN {t} = 'image' AND coalesce({d}, '') <> '' THEN CAST(ceil(length({d}) / 4) AS BIGINT) "
            f"WHEN coalesce({x}, '') <> '' THEN {tokens(x)} ELSE CAST(0 AS BIGINT) END")


def dom_signal(x: str) -> str:
    return "(" + " OR ".join(f"contains(coalesce({x}, ''), {s(v)})" for v in C.DOM_SIGNALS) + ")"


def json_looking(x: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), {s('^' + C.JS_WS + '*[{\\[]')})"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, {s('^' + C.JS_WS + '+|' + C.JS_WS + '+$')}, '', 'g')"


def classify(t: str, x: str, thr: int) -> str:
    tok = tokens(x)
    js = json_looking(x)
    return (f"CASE WHEN {t} = 'image' THEN 'image' WHEN {dom_signal(x)} THEN 'dom-snapshot' "
            f"WHEN {tok} > {int(thr)} THEN CASE WHEN {js} THEN 'large-json' ELSE 'large-text' END "
            f"WHEN {tok} > {C.JSON_MIN_TOKENS} AND {js} THEN 'large-json' ELSE 'small-text' END")


def strategy_for(ct: str, image_ocr: bool = True, json_collapse: bool = True) -> str:
    img = "'ocr'" if image_ocr else "'passthrough'"
    js = "'json-collapse'" if json_collapse else "'passthrough'"
    return (f"CASE {ct} WHEN 'image' THEN {img} WHEN 'dom-snapshot' THEN 'dom-cleanup' "
            f"WHEN 'large-json' THEN {js} WHEN 'large-text' THEN 'truncate' ELSE 'passthrough' END")


def short_name(n: str) -> str:
    parts = f"string_split({n}, '__')"
    return (f"CASE WHEN starts_with({n}, 'mcp__') AND len({parts}) >= 3 "
            f"THEN array_to_string({parts}[3:], '__') ELSE {n} END")


def screenshot_tool(n: str) -> str:
    return "(" + " OR ".join(f"contains({n}, {s(t)})" for t in C.SCREENSHOT_TOOLS) + ")"


def has_image_path(t: str, x: str) -> str:
    return f"({t} = 'text' AND coalesce({x}, '') <> '' AND regexp_matches({x}, {s(C.FILE_PATH_PATTERN)}))"


def rule_case(n: str, rules) -> str:
    whens = []
    for r in rules:
        conds = []
        if r.tool_name:
            conds.append(f"{n} = {s(r.tool_name)}")
        if r.tool_name_pattern:
            conds.append(f"regexp_matches({n}, {s(r.tool_name_pattern)})")
        if conds:
            whens.append(f"WHEN {' OR '.join(conds)} THEN {s(r.strategy)}")
    return "CASE " + " ".join(whens) + " ELSE 'auto' END" if whens else "'auto'"


def tokenize(x: str) -> str:
    stop = arr(C.STOP_WORDS)
    return (f"list_filter(string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[^\\w\\s-]', ' ', 'g'), "
            f"'\\s+'), lambda w: length(w) > 1 AND NOT list_contains({stop}, w))")


def js_round(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def fmt_int(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


# Fixtures -------------------------------------------------------------------
DOC_BLOCKS = """
SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS result_id, 'documents' AS source, 0 AS pos,
       'mcp__corpus__read_document' AS tool_name,
       json_object('path', 'corpus/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt',
                   'query', split_part(text, '.', 1)) AS args,
       'text' AS type, text, CAST(NULL AS VARCHAR) AS data, CAST(NULL AS VARCHAR) AS mime_type
FROM documents"""

PAGE_BLOCKS = """
SELECT 'page:' || CAST(page_id AS VARCHAR) AS result_id, 'pages' AS source, 0 AS pos,
       'mcp__web__fetch_page' AS tool_name, json_object('url', url) AS args,
       'text' AS type, html AS text, CAST(NULL AS VARCHAR) AS data, CAST(NULL AS VARCHAR) AS mime_type
FROM pages"""

CONV_BLOCKS = """
SELECT 'conv:' || CAST(conv_id AS VARCHAR) AS result_id, 'conversations' AS source, CAST(turn AS INTEGER) AS pos,
       'mcp__chat__read_history' AS tool_name, json_object('conversation', CAST(conv_id AS VARCHAR)) AS args,
       'text' AS type, text, CAST(NULL AS VARCHAR) AS data, CAST(NULL AS VARCHAR) AS mime_type
FROM conversations"""

TEXT_BLOCKS = f"({DOC_BLOCKS}\nUNION ALL{PAGE_BLOCKS}\nUNION ALL{CONV_BLOCKS})"

SHOT_BLOCKS = """(
WITH p AS (
  SELECT page_id, url, html, 'shot:' || CAST(page_id AS VARCHAR) AS result_id,
         CASE WHEN page_id % 3 = 0 THEN 'mcp__playwright__browser_take_screenshot'
              ELSE 'mcp__images__generate_image' END AS tool_name,
         CASE WHEN page_id % 2 = 0 THEN json_object('filename', '/tmp/shots/page-' || CAST(page_id AS VARCHAR) || '.png')
              ELSE json_object('url', url) END AS args
  FROM pages)
SELECT result_id, 'screenshots' AS source, 0 AS pos, tool_name, args, 'text' AS type,
       CASE WHEN page_id % 2 = 0 THEN 'Saved screenshot to /tmp/shots/page-' || CAST(page_id AS VARCHAR) || '.png'
            ELSE 'Captured ' || url END AS text,
       CAST(NULL AS VARCHAR) AS data, CAST(NULL AS VARCHAR) AS mime_type FROM p
UNION ALL
SELECT result_id, 'screenshots', 1, tool_name, args, 'image', CAST(NULL AS VARCHAR),
       to_base64(encode(html)), 'image/png' FROM p)"""

EVENT_TOOL_NAMES = """(
SELECT event_id, user_id, event_type,
       CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'mcp__srv__' || event_type
            WHEN 2 THEN 'mcp__srv__' || event_type || '__v2' ELSE 'mcp__' || event_type END AS full_name
FROM events)"""


def annotated_blocks(src: str, thr: int, image_ocr: bool = True, json_collapse: bool = True) -> str:
    return f"""(
SELECT b.*, {block_tokens('type', 'text', 'data')} AS before,
       {classify('type', 'text', thr)} AS content_type
FROM {src} b)"""


# Text jobs -------------------------------------------------------------------
def _piece(sep: str) -> str:
    esc = {"\n\n": "\\n\\n", "\n": "\\n", ". ": "\\. ", " ": " "}[sep]
    return "(?s)(.*?" + esc + "|.+)"


def chunk_fold(text: str, target: int, overlap: int) -> str:
    """STRUCT(chunks, cur) of the chunk fold; finish with ``chunk_finish``."""
    t, tc, oc = int(target), int(target) * 4, int(overlap) * 4
    segs = f"[{text}]"
    for sep in C.CHUNK_SEPARATORS:
        segs = (f"flatten(list_transform({segs}, lambda s: CASE WHEN {tokens('s')} > {t} "
                f"THEN regexp_extract_all(s, {s(_piece(sep))}, 1) ELSE [s] END))")
    hard = (f"flatten(list_transform({segs}, lambda s: CASE WHEN length(s) > {tc * 1.5} THEN "
            f"list_transform(range(0, CAST(ceil(length(s) / {tc}) AS BIGINT)), "
            f"lambda k: substr(s, CAST(k * {tc} + 1 AS BIGINT), {tc})) ELSE [s] END))")
    tail = f"right(acc.cur, {oc})" if oc > 0 else "''"
    red = (f"list_reduce({hard}, lambda acc, seg: CASE WHEN {tokens('acc.cur || seg')} > {t} AND length(acc.cur) > 0 "
           f"THEN {{'chunks': list_append(acc.chunks, acc.cur), 'cur': {tail} || seg}} "
           f"ELSE {{'chunks': acc.chunks, 'cur': acc.cur || seg}} END, {{'chunks': []::VARCHAR[], 'cur': ''}})")
    return f"(CASE WHEN {tokens(text)} <= {t} THEN {{'chunks': [{text}], 'cur': ''}} ELSE {red} END)"


def chunk_finish(m: str) -> str:
    return f"(CASE WHEN length({m}.cur) > 0 THEN list_append({m}.chunks, {m}.cur) ELSE {m}.chunks END)"


def bm25_ctes(prev: str, k1: float = C.BM25_K1, b: float = C.BM25_B, p: str = "_s") -> tuple[str, str]:
    """CTEs adding ``scores`` and ``ranked`` to a relation with ``chunks`` and ``q``.

    Returns (cte_text, last_cte_name).
    """
    d = lambda x: f"CAST({x} AS DOUBLE)"
    score = (f"list_transform(ct, lambda t: list_reduce(list_transform(qd, lambda x, j: "
             f"{{'tf': len(list_filter(t, lambda w: w = x)), 'df': dfs[j], 'qtf': qtf[j]}}), lambda acc, y: acc + "
             f"CASE WHEN y.tf = 0 THEN {d(0)} ELSE y.qtf * ln((len(ct) - y.df + {d(0.5)}) / (y.df + {d(0.5)}) + {d(1)}) * "
             f"(y.tf * {d(k1 + 1)}) / (y.tf + {d(k1)} * ({d(1)} - {d(b)} + {d(b)} * (len(t) / avgdl))) END, {d(0)}))")
    ctes = f"""
{p}1 AS (SELECT *, list_transform(chunks, lambda c: {tokenize('c')}) AS ct, list_filter(q, lambda x, i: list_position(q, x) = i) AS qd FROM {prev}),
{p}2 AS (SELECT *, list_transform(qd, lambda x: len(list_filter(ct, lambda t: list_contains(t, x)))) AS dfs,
               list_transform(qd, lambda x: len(list_filter(q, lambda y: y = x))) AS qtf,
               CAST(list_sum(list_transform(ct, lambda t: len(t))) AS DOUBLE) / len(ct) AS avgdl FROM {p}1),
{p}3 AS (SELECT * EXCLUDE (qd, qtf), {score} AS scores FROM {p}2),
{p}4 AS (SELECT *, list_sort(list_transform(chunks, lambda c, i: {{'neg': {d(0)} - scores[i],
               'idx': CAST(i - 1 AS BIGINT), 'tokens': {tokens('c')}}})) AS ranked FROM {p}3)"""
    return ctes, f"{p}4"


def greedy(ranked: str, budget: str) -> str:
    return (f"list_sort(list_reduce({ranked}, lambda acc, x: CASE WHEN acc.rem > 0 AND x.tokens <= acc.rem "
            f"THEN {{'rem': acc.rem - x.tokens, 'picked': list_append(acc.picked, x.idx)}} ELSE acc END, "
            f"{{'rem': CAST({budget} AS BIGINT), 'picked': []::BIGINT[]}}).picked)")


def reassemble(chunks_col: str, picked: str) -> str:
    return f"array_to_string(list_transform({picked}, lambda i: {chunks_col}[i + 1]), '')"


def url_kw(u: str) -> str:
    scheme = "'^[A-Za-z][A-Za-z0-9+.-]*://'"
    host = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
    path = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    parts = f"list_transform(list_filter(string_split({path}, '/'), lambda p: length(p) > 1), lambda p: translate(p, '-_', '  '))"
    return (f"(CASE WHEN NOT regexp_matches({u}, {scheme}) THEN {u} "
            f"ELSE array_to_string(list_concat({parts}, [regexp_replace({host}, '^(.*?)www\\.', '\\1')]), ' ') END)")


def path_kw(p: str) -> str:
    return (f"array_to_string(list_transform(list_filter(string_split({p}, '/'), "
            f"lambda x: length(x) > 0 AND NOT starts_with(x, '.')), lambda x: translate(x, '-_.', '   ')), ' ')")


def arg_kw(a: str) -> str:
    v = f"json_extract_string({a}, '$.\"' || k || '\"')"
    kw = (f"CASE WHEN k IN ('url', 'uri', 'href') THEN {url_kw(v)} "
          f"WHEN k IN ('path', 'file', 'file_path', 'filepath') THEN {path_kw(v)} "
          f"WHEN k IN ('query', 'search', 'pattern', 'selector', 'command') THEN {v} "
          f"WHEN length({v}) < 200 THEN {v} END")
    return (f"list_filter(list_transform(coalesce(json_keys({a}), []::VARCHAR[]), lambda k: "
            f"CASE WHEN json_type({a}, '$.\"' || k || '\"') = 'VARCHAR' THEN {kw} END), lambda x: x IS NOT NULL)")


def synthetic_query(name: str, own: str, inherited: list[str]) -> str:
    parts = [f"[translate({name}, '_-', '  ')]", arg_kw(own)] + [f"coalesce({arg_kw(a)}, [])" for a in inherited]
    return js_trim(f"array_to_string(list_concat({', '.join(parts)}), ' ')")


# JSON jobs -------------------------------------------------------------------
def let(value: str, var: str, body: str) -> str:
    return f"list_transform([{value}], lambda {var}: {body})[1]"


def jkind(x: str, path: str | None = None) -> str:
    t = f"json_type({x}, {path})" if path else f"json_type({x})"
    return (f"(CASE WHEN {t} IS NULL THEN 'missing' WHEN {t} = 'OBJECT' THEN 'object' WHEN {t} = 'ARRAY' THEN 'array' "
            f"WHEN {t} = 'VARCHAR' THEN 'string' WHEN {t} = 'BOOLEAN' THEN 'boolean' WHEN {t} = 'NULL' THEN 'null' "
            f"ELSE 'number' END)")


def kpath(k: str) -> str:
    return f"('$.\"' || {k} || '\"')"


def homog(a: str) -> str:
    return (f"(len({a}) > 0 AND list_bool_and(list_transform({a}, lambda e: json_type(e) = 'OBJECT')) AND "
            f"list_bool_and(list_transform({a}, lambda e: list_sort(json_keys(e)) = list_sort(json_keys({a}[1])))))")


def scalar_share(a: str, sch: str) -> str:
    cnt = (f"list_sum(list_transform({a}[1:{C.TABULAR_SAMPLE_ROWS}], lambda e: "
           f"len(list_filter({sch}, lambda k: {jkind('e', kpath('k'))} NOT IN ('object', 'array')))))")
    return f"(CAST({cnt} AS DOUBLE) / (len({a}[1:{C.TABULAR_SAMPLE_ROWS}]) * len({sch})))"


def number_text(v: str) -> str:
    """Shortest digits without a trailing ``.0`` (the fixtures hold no number of 1e15 or more)."""
    d = f"CAST({v} AS DOUBLE)"
    return f"CASE WHEN {d} = floor({d}) THEN CAST(CAST({d} AS BIGINT) AS VARCHAR) ELSE CAST({d} AS VARCHAR) END"


def jprinted(x: str, depth: int) -> str:
    """Indented, reduced JSON text of the JSON value ``x`` at ``depth``."""
    kd = jkind(x)
    if depth >= C.JSON_MAX_DEPTH:
        nested = (f"CASE WHEN {kd} = 'array' THEN '\"[... ' || CAST(json_array_length({x}) AS VARCHAR) || ' items]\"' "
                  f"ELSE to_json('{{' || array_to_string(json_keys({x}), ', ') || ' — ' || CAST(len(json_keys({x})) AS VARCHAR) || ' keys}}')::VARCHAR END")
    else:
        it, a, lines = f"_i{depth}", f"_a{depth}", f"_l{depth}"
        pad, outer = "  " * (depth + 1), "  " * depth
        rest = (f"CASE WHEN coalesce({homog(a)}, false) THEN '... ' || CAST(len({a}) - {C.JSON_MAX_ARRAY_ITEMS} AS VARCHAR) || ' more items with same shape {{' "
                f"|| array_to_string(json_keys({a}[1]), ', ') || '}}' ELSE '... ' || CAST(len({a}) - {C.JSON_MAX_ARRAY_ITEMS} AS VARCHAR) || ' more items (' "
                f"|| CAST(len({a}) AS VARCHAR) || ' total)' END")
        keys = (f"list_filter(json_keys({x}), lambda k: NOT ({jkind(x, kpath('k'))} = 'null' OR json_extract_string({x}, {kpath('k')}) = '' "
                f"OR ({jkind(x, kpath('k'))} = 'array' AND json_array_length({x}, {kpath('k')}) = 0)))")
        items = (f"CASE WHEN {kd} = 'array' THEN list_transform(CASE WHEN len({a}) > {C.JSON_ARRAY_THRESHOLD} THEN {a}[1:{C.JSON_MAX_ARRAY_ITEMS}] ELSE {a} END, "
                 f"lambda e: {{'k': NULL::VARCHAR, 'v': e}}) ELSE list_transform({keys}, lambda k: {{'k': k, 'v': json_extract({x}, {kpath('k')})}}) END")
        shown = (f"list_concat(list_transform({items}, lambda {it}: '{pad}' || CASE WHEN {it}.k IS NULL THEN '' ELSE to_json({it}.k)::VARCHAR || ': ' END "
                 f"|| {jprinted(f'{it}.v', depth + 1)}), CASE WHEN {kd} = 'array' AND len({a}) > {C.JSON_ARRAY_THRESHOLD} THEN ['{pad}' || to_json({rest})::VARCHAR] ELSE [] END)")
        left, right = f"CASE WHEN {kd} = 'array' THEN '[' ELSE '{{' END", f"CASE WHEN {kd} = 'array' THEN ']' ELSE '}}' END"
        nested = let(f"CASE WHEN {kd} = 'array' THEN json_extract({x}, '$[*]') END", a, let(shown, lines, (
            f"CASE WHEN len({lines}) = 0 THEN {left} || {right} ELSE {left} || chr(10) || array_to_string({lines}, ',' || chr(10)) || chr(10) || '{outer}' || {right} END")))
    return (f"CASE {kd} WHEN 'string' THEN ({x})::VARCHAR WHEN 'boolean' THEN ({x})::VARCHAR WHEN 'null' THEN 'null' "
            f"WHEN 'number' THEN {number_text(f'({x})::VARCHAR')} ELSE {nested} END")


def jcell(e: str, k: str) -> str:
    v = f"json_extract_string({e}, {kpath(k)})"
    kd = jkind(e, kpath(k))
    return (f"(CASE WHEN {kd} IN ('null', 'missing') THEN '' WHEN {kd} IN ('object', 'array') THEN "
            f"CASE WHEN length({v}) > {C.CELL_MAX_CHARS} THEN substr({v}, 1, {C.CELL_CUT_CHARS}) || '...' ELSE {v} END "
            f"WHEN {kd} = 'number' THEN {number_text(v)} ELSE replace(replace({v}, '|', '\\|'), chr(10), ' ') END)")


def jtable(t: str) -> str:
    row = f"'| ' || array_to_string(list_transform(_sch, lambda k: {jcell('e', 'k')}), ' | ') || ' |'"
    render = (f"concat_ws(chr(10), '| ' || array_to_string(_sch, ' | ') || ' |', "
              f"'| ' || array_to_string(list_transform(_sch, lambda k: '---'), ' | ') || ' |', "
              f"array_to_string(list_transform(_a[1:{C.TABLE_MAX_ROWS}], lambda e: {row}), chr(10)), "
              f"CASE WHEN len(_a) > {C.TABLE_MAX_ROWS} THEN '| ... ' || CAST(len(_a) - {C.TABLE_MAX_ROWS} AS VARCHAR) "
              f"|| ' more rows (' || CAST(len(_a) AS VARCHAR) || ' total) | ' || "
              f"array_to_string(list_transform(_sch[2:], lambda k: ''), ' | ') || ' |' END)")
    tab = (f"(len(_sch) <= {C.TABLE_MAX_COLS} AND len(_a) >= 2 AND "
           f"{scalar_share('_a', '_sch')} >= {C.TABULAR_MIN_SCALAR_SHARE})")
    inner = let("json_keys(_a[1])", "_sch", f"CASE WHEN {tab} THEN {render} END")
    return let(f"CASE WHEN json_type({t}) = 'ARRAY' THEN json_extract({t}, '$[*]') END", "_a",
               f"CASE WHEN coalesce({homog('_a')}, false) THEN {inner} END")


def jrender(t: str) -> str:
    hits = (f"list_filter(list_transform(json_keys({t}), lambda k: {{'k': k, 't': CASE WHEN "
            f"{jkind(t, kpath('k'))} = 'array' AND json_array_length({t}, {kpath('k')}) >= 2 "
            f"THEN {jtable(f'json_extract({t}, {kpath(chr(107))})')} END}}), lambda x: x.t IS NOT NULL)")
    meta = (f"array_to_string(list_transform(list_filter(json_keys({t}), lambda k: k <> _h[1].k AND "
            f"{jkind(t, kpath('k'))} NOT IN ('object', 'array')), lambda k: k || ': ' || "
            f"CASE WHEN {jkind(t, kpath('k'))} = 'number' THEN {number_text(f'json_extract_string({t}, {kpath(chr(107))})')} "
            f"ELSE coalesce(json_extract_string({t}, {kpath('k')}), 'null') END), ' | ')")
    obj = let(hits, "_h", f"CASE WHEN len(_h) = 0 THEN NULL ELSE " +
              let(meta, "_meta", "CASE WHEN _meta = '' THEN _h[1].t ELSE _meta || chr(10) || chr(10) || _h[1].t END")
              + " END")
    return f"(CASE json_type({t}) WHEN 'ARRAY' THEN {jtable(t)} WHEN 'OBJECT' THEN {obj} END)"


# Snapshot jobs -----------------------------------------------------------------
def snap_parse(l: str) -> str:
    attr_re = r"\[(" + "|".join(C.SNAPSHOT_ATTRS) + r")\]"
    c = f"regexp_extract({l}, {s(r'^\s*-\s+(.+)$')}, 1)"
    ac = js_trim(f"regexp_replace(regexp_extract(_c, {s(r':\s+(.+?)\s*$')}, 1), {s(r'\[[\w=]+\]')}, '', 'g')")
    return let(c, "_c", (
        f"{{'line': {l}, 'blank': {js_trim(l)} = '', "
        f"'node': regexp_matches({l}, {s(r'^\s*-\s+.+$')}) AND regexp_matches(_c, {s(r'^/?[\w-]+')}), "
        f"'indent': length(replace(regexp_extract({l}, {s(r'^(\s*)-\s+.+$')}, 1), chr(9), '  ')), "
        f"'role': regexp_extract(_c, {s(r'^(/?[\w-]+)')}, 1), "
        f"'name': coalesce(nullif(regexp_extract(_c, {s(r'^[\w-]+\s+\"((?:[^\"\\]|\\.)*)\"')}, 1), ''), "
        f"regexp_extract(_c, {s(r"^[\w-]+\s+'((?:[^'\\]|\\.)*)'")}, 1)), "
        f"'ref': regexp_extract(_c, {s(r'\[ref=(\w+)\]')}, 1), "
        f"'level': coalesce(CAST(nullif(regexp_extract(_c, {s(r'\[level=(\d+)\]')}, 1), '') AS INTEGER), 0), "
        f"'attrs': regexp_extract_all(_c, {s(attr_re)}, 1), "
        f"'inline': " + let(ac, "_ac", f"CASE WHEN _ac <> '' AND NOT regexp_matches(_ac, {s(r'^[\s\[\]]*$')}) THEN _ac ELSE '' END") + "}"))


def snap_fold(p: str) -> str:
    step = (f"CASE WHEN {p}[j + 1].blank THEN {{'st': s.st, 'anc': list_append(s.anc, s.st), 'pairs': s.pairs}} ELSE "
            + let(f"CASE WHEN {p}[j + 1].node THEN list_filter(s.st, lambda x: {p}[x + 1].indent < {p}[j + 1].indent) "
                  f"ELSE []::BIGINT[] END", "_keep",
                  f"{{'st': CASE WHEN {p}[j + 1].node THEN list_append(_keep, j) ELSE _keep END, "
                  f"'anc': list_append(s.anc, _keep), "
                  f"'pairs': list_concat(s.pairs, list_transform(list_filter(s.st, lambda x: NOT list_contains(_keep, x)), "
                  f"lambda x: {{'i': x, 'e': j}}))}}") + " END")
    init = "{'st': []::BIGINT[], 'anc': []::BIGINT[][], 'pairs': []::STRUCT(i BIGINT, e BIGINT)[]}"
    return f"list_reduce(range(len({p})), lambda s, j: {step}, {init})"


def snap_line_ctes(src: str, id_col: str, text_col: str) -> str:
    consumers = arr(C.FOOTER_ROLES + ["heading", "table", "strong", "paragraph"] + C.INTERACTIVE_ROLES)
    footers = arr(C.FOOTER_ROLES)
    return f"""
sb AS (SELECT {id_col} AS block_id, list_transform(string_split({text_col}, chr(10)), lambda l: {snap_parse('l')}) AS P FROM {src}),
sf AS (SELECT block_id, P, {snap_fold('P')} AS s FROM sb),
sl AS (SELECT block_id, P, s.anc AS anc,
              list_transform(range(len(P)), lambda i: coalesce(list_filter(s.pairs, lambda x: x.i = i)[1].e, len(P))) AS ends
       FROM sf),
lines AS (SELECT block_id, unnest(range(len(P))) AS line_no, unnest(P) AS x, unnest(anc) AS a, unnest(ends) AS e, P FROM sl),
line_table AS (SELECT block_id, CAST(line_no AS INTEGER) AS line_no, x.line AS line, x.blank AS blank, x.node AS node,
       CAST(x.indent AS INTEGER) AS indent, x.role AS role, x.name AS name, x.ref AS ref, x.level AS level,
       array_to_string(x.attrs, ',') AS attrs, x.inline AS inline_text,
       CAST(coalesce(a[-1], -1) AS INTEGER) AS parent, CAST(len(a) AS INTEGER) AS depth, CAST(e AS INTEGER) AS subtree_end,
       coalesce(list_bool_or(list_transform(a, lambda y: P[y + 1].node AND list_contains({consumers}, P[y + 1].role))), false) AS hidden,
       coalesce(list_bool_or(list_transform(a, lambda y: P[y + 1].node AND list_contains({footers}, P[y + 1].role))), false) AS under_footer
FROM lines)"""


def snap_cleanup(x: str) -> str:
    """DuckDB twin of the line cleanup profile (D10); NULL when not shorter."""
    footer = r"^[\t ]*- contentinfo\b|^[\t ]*- heading \"Footer\"|^[\t ]*- navigation \"Footer\""
    inter = arr(C.INTERACTIVE_ROLES)
    skip = (f"list_reduce(range(len(_ls)), lambda s, i: CASE WHEN s.u >= 0 AND _in[i + 1] > s.u "
            f"THEN {{'u': s.u, 'f': list_append(s.f, true)}} "
            f"WHEN regexp_matches(_ls[i + 1], {s(footer)}) THEN {{'u': _in[i + 1], 'f': list_append(s.f, true)}} "
            f"ELSE {{'u': -1, 'f': list_append(s.f, false)}} END, {{'u': -1, 'f': []::BOOLEAN[]}}).f")
    c1 = f"regexp_replace(_ls[i + 1], {s(r'\s*\[cursor=pointer\]')}, '', 'g')"
    c2 = (f"CASE WHEN list_contains({inter}, regexp_extract(_c1, {s(r'^[\t ]*-\s+(\w+)')}, 1)) "
          f"AND regexp_matches(_c1, {s(r'^[\t ]*-\s+\w+')}) THEN _c1 "
          f"ELSE regexp_replace(_c1, {s(r'\s*\[ref=\w+\]')}, '', 'g') END")
    c3 = f"regexp_replace(_c2, {s(r'\s*role=\"(?:generic|none)\"')}, '', 'g')"
    c5 = (f"regexp_replace(regexp_replace(_c3, {s(r"^([\t ]*-\s+)'row \".*?\"(\s*\[ref=\w+\])?'")}, '\\1row\\2'), "
          f"{s(r'^([\t ]*-\s+)row \".*?\"(\s*\[ref=\w+\])?:')}, '\\1row\\2:')")
    cnt = ("list_reduce(_in[i + 2:], lambda s, v: CASE WHEN s.stop OR s.n > 1 THEN s "
           "WHEN v <= _in[i + 1] THEN {'n': s.n, 'stop': true} "
           "ELSE {'n': s.n + CASE WHEN v = _in[i + 1] + 2 THEN 1 ELSE 0 END, 'stop': false} END, "
           "{'n': 0, 'stop': false}).n")
    wrapper = (f"(regexp_matches(_c5, {s(r'^([\t ]*)-\s+generic\s*:?\s*$')}) AND i + 1 < len(_ls) "
               f"AND _in[i + 2] > _in[i + 1] AND {cnt} <= 1)")
    c7 = f"regexp_replace(_c5, {s(r'^([\t ]*-\s+)generic(?:\s*\[ref=\w+\])?\s*:\s*(.+)')}, '\\1\\2')"
    c8 = f"regexp_replace(_c7, {s(r'^([\t ]*)-\s+text:\s*')}, '\\1  ')"
    per = let(c1, "_c1", let(c2, "_c2", let(c3, "_c3", (
        f"CASE WHEN regexp_matches(_c3, {s(r'^[\t ]*-\s+img\s*$')}) THEN NULL ELSE " + let(c5, "_c5", (
            f"CASE WHEN {wrapper} THEN NULL ELSE " + let(c7, "_c7", let(
                c8, "_c8", f"CASE WHEN {js_trim('_c8')} = '' THEN NULL ELSE _c8 END")) + " END")) + " END"))))
    body = f"list_filter(list_transform(range(len(_ls)), lambda i: CASE WHEN _sk[i + 1] THEN NULL ELSE {per} END), lambda v: v IS NOT NULL)"
    out = f"regexp_replace(array_to_string({body}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    ind = "list_transform(_ls, lambda l: length(replace(regexp_extract(l, '^([\\t ]*)', 1), chr(9), '  ')))"
    return let(x, "_x", let(f"string_split(_x, chr(10))", "_ls", let(ind, "_in", let(skip, "_sk", let(
        out, "_o", "CASE WHEN length(_o) >= length(_x) THEN NULL ELSE _o END")))))


# Snapshot outline twin (D3, D5-D9): mirrors condensa.operators.snapshot line by line.
# Line numbers are 0-based in both engines; every list access adds 1.
_EMPTY = "[]::VARCHAR[]"


def _o_range(i: str) -> str:
    return f"CASE WHEN _en[{i} + 1] > {i} + 1 THEN generate_series({i} + 1, _en[{i} + 1] - 1) ELSE []::BIGINT[] END"


def _o_ni(j: str) -> str:
    return f"CASE WHEN _p[{j} + 1].name <> '' THEN _p[{j} + 1].name ELSE _p[{j} + 1].inline END"


def _o_nz(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN [{x}] ELSE {_EMPTY} END"


def _o_meta(i: str, prefix: str) -> str:
    hit = f"list_filter({_o_range(i)}, lambda k: starts_with({js_trim('_p[k + 1].line')}, {s(prefix)}))"
    val = js_trim(f"substr({js_trim('_p[_h[1] + 1].line')}, {len(prefix) + 1})")
    return let(hit, "_h", f"CASE WHEN len(_h) = 0 THEN '' ELSE regexp_replace({val}, '^\"(.*)\"$', '\\1') END")


def _o_flat(k: str) -> str:
    return (f"array_to_string(list_transform(list_filter({_o_range(k)}, lambda m: _p[m + 1].node "
            f"AND NOT starts_with(_p[m + 1].role, '/') AND {_o_ni('m')} <> ''), lambda m: {_o_ni('m')}), ' ')")


def _o_collect(i: str) -> str:
    top = (f"list_filter({_o_range(i)}, lambda j: _p[j + 1].node AND len(list_filter(list_filter(_an[j + 1], "
           f"lambda x: x > {i}), lambda x: NOT (_p[x + 1].role IN ('text', 'img') OR starts_with(_p[x + 1].role, '/')))) = 0)")
    transparent = arr(C.TRANSPARENT_ROLES)
    part = (
        f"CASE WHEN starts_with(_p[j + 1].role, '/') THEN '' "
        f"WHEN _p[j + 1].role = 'text' THEN {_o_ni('j')} "
        f"WHEN _p[j + 1].role = 'img' THEN CASE WHEN _p[j + 1].name = '' THEN '' ELSE '![' || _p[j + 1].name || ']' END "
        f"WHEN _p[j + 1].role = 'strong' THEN " + let(
            f"CASE WHEN {_o_ni('j')} <> '' THEN {_o_ni('j')} ELSE {_o_flat('j')} END", "_t",
            "CASE WHEN _t <> '' THEN '**' || _t || '**' ELSE '' END") + " "
        f"WHEN _p[j + 1].role = 'link' THEN " + let(
            f"CASE WHEN _p[j + 1].name <> '' THEN _p[j + 1].name ELSE {_o_flat('j')} END", "_t",
            let(_o_meta("j", "- /url:"), "_u",
                "'[' || _t || ']' || CASE WHEN _u <> '' THEN '(' || _u || ')' ELSE '' END || "
                "CASE WHEN _p[j + 1].ref <> '' THEN ' [' || _p[j + 1].ref || ']' ELSE '' END")) + " "
        f"WHEN list_contains({transparent}, _p[j + 1].role) THEN "
        f"CASE WHEN {_o_ni('j')} <> '' THEN {_o_ni('j')} ELSE {_o_flat('j')} END "
        f"ELSE {_o_ni('j')} END")
    joined = f"array_to_string(list_filter(list_transform({top}, lambda j: {part}), lambda x: x <> ''), ' ')"
    return js_trim(f"regexp_replace({joined}, {s(r'\s+')}, ' ', 'g')")


def _o_attrs(i: str) -> str:
    return f"CASE WHEN len(_p[{i} + 1].attrs) > 0 THEN ' (' || array_to_string(_p[{i} + 1].attrs, ', ') || ')' ELSE '' END"


def _o_refp(i: str) -> str:
    return f"CASE WHEN _p[{i} + 1].ref <> '' THEN '[' || _p[{i} + 1].ref || '] ' ELSE '' END"


def _o_parent(j: str) -> str:
    return f"coalesce(_an[{j} + 1][-1], -1)"


def _o_cell(x: str) -> str:
    header = f"CASE WHEN _p[{x} + 1].name <> '' THEN _p[{x} + 1].name ELSE _ci[{x} + 1] END"
    fold = (f"list_reduce({_o_range(x)}, lambda s, k: CASE WHEN _p[k + 1].node AND _p[k + 1].role = 'link' THEN "
            f"{{'t': CASE WHEN _p[k + 1].name <> '' THEN _p[k + 1].name ELSE s.t END, 'r': _p[k + 1].ref}} "
            f"WHEN _p[k + 1].node AND _p[k + 1].role = 'button' THEN {{'t': s.t, 'r': _p[k + 1].ref}} ELSE s END, "
            f"{{'t': CASE WHEN {_o_ni(x)} <> '' THEN {_o_ni(x)} ELSE '' END, 'r': ''}})")
    fin = let(fold, "_cs", "CASE WHEN _cs.r <> '' THEN _cs.t || ' [' || _cs.r || ']' ELSE _cs.t END")
    return f"CASE WHEN _p[{x} + 1].role = 'columnheader' THEN {header} ELSE {fin} END"


def _o_rows(c: str) -> str:
    rows = (f"list_filter(list_transform(list_filter({_o_range(c)}, lambda r: _p[r + 1].node AND _p[r + 1].role = 'row' "
            f"AND {_o_parent('r')} = {c}), lambda r: " + let(
                f"list_filter({_o_range('r')}, lambda x: _p[x + 1].node AND _p[x + 1].role IN ('cell', 'columnheader') "
                f"AND {_o_parent('x')} = r)", "_cx",
                f"{{'cells': list_transform(_cx, lambda x: {_o_cell('x')}), "
                f"'hdr': len(list_filter(_cx, lambda x: _p[x + 1].role = 'columnheader')) > 0}}") + "), lambda z: len(z.cells) > 0)")
    body = let("list_max(list_transform(_rows, lambda z: len(z.cells)))", "_w",
               "flatten(list_transform(_rows, lambda z, ri: " + let(
                   "list_concat(z.cells, list_transform(range(_w - len(z.cells)), lambda q: ''))", "_pc",
                   "CASE WHEN z.hdr OR (ri = 1 AND len(_rows) > 1) THEN "
                   "['| ' || array_to_string(_pc, ' | ') || ' |', "
                   "'| ' || array_to_string(list_transform(_pc, lambda q: '---'), ' | ') || ' |'] "
                   "ELSE ['| ' || array_to_string(_pc, ' | ') || ' |'] END") + "))")
    return let(rows, "_rows", f"CASE WHEN len(_rows) = 0 THEN {_EMPTY} ELSE {body} END")


def _o_table(t: str) -> str:
    groups = f"list_filter({_o_range(t)}, lambda g: _p[g + 1].node AND _p[g + 1].role = 'rowgroup' AND {_o_parent('g')} = {t})"
    return f"list_concat(flatten(list_transform({groups}, lambda g: {_o_rows('g')})), {_o_rows(t)})"


def _o_emission(i: str) -> str:
    r = f"_p[{i} + 1].role"
    nm = f"_p[{i} + 1].name"
    inl = f"_p[{i} + 1].inline"
    ni = _o_ni(i)
    ci = f"_ci[{i} + 1]"
    footers = arr(C.FOOTER_ROLES)
    inter = arr(C.INTERACTIVE_ROLES)
    sections = arr(C.SECTION_ROLES)
    transparent = arr(C.TRANSPARENT_ROLES)
    return (
        f"CASE WHEN _p[{i} + 1].blank THEN {_EMPTY} "
        f"WHEN NOT _p[{i} + 1].node THEN {_o_nz(js_trim(f'_p[{i} + 1].line'))} "
        f"WHEN list_contains({footers}, {r}) OR starts_with({r}, '/') THEN {_EMPTY} "
        f"WHEN {r} = 'text' THEN {_o_nz(ni)} "
        f"WHEN {r} = 'heading' THEN [repeat('#', least(CASE WHEN _p[{i} + 1].level = 0 THEN 1 ELSE _p[{i} + 1].level END, 6)) "
        f"|| ' ' || CASE WHEN {nm} <> '' THEN {nm} WHEN _en[{i} + 1] > {i} + 1 THEN {ci} ELSE '' END] "
        f"WHEN {r} = 'link' THEN ['[' || CASE WHEN {nm} <> '' THEN {nm} ELSE {ci} END || ']' || "
        f"CASE WHEN _url[{i} + 1] <> '' THEN '(' || _url[{i} + 1] || ')' ELSE '' END || "
        f"CASE WHEN _p[{i} + 1].ref <> '' THEN ' [' || _p[{i} + 1].ref || ']' ELSE '' END] "
        f"WHEN {r} = 'button' THEN [{_o_refp(i)} || 'button \"' || CASE WHEN {nm} <> '' THEN {nm} ELSE {ci} END || '\"' "
        f"|| {_o_attrs(i)}] "
        f"WHEN list_contains({inter}, {r}) THEN [{_o_refp(i)} || {r} || ' \"' || {nm} || '\"' || "
        f"CASE WHEN _ph[{i} + 1] <> '' THEN ' — \"' || _ph[{i} + 1] || '\"' ELSE '' END || {_o_attrs(i)}] "
        f"WHEN {r} = 'strong' THEN ['**' || CASE WHEN {ni} <> '' THEN {ni} ELSE {ci} END || '**'] "
        f"WHEN {r} = 'paragraph' THEN {_o_nz(f'(CASE WHEN {ni} <> {chr(39)}{chr(39)} THEN {ni} ELSE {ci} END)')} "
        f"WHEN {r} = 'img' THEN CASE WHEN {nm} <> '' THEN ['![' || {nm} || ']'] ELSE {_EMPTY} END "
        f"WHEN {r} = 'table' THEN {_o_table(i)} "
        f"WHEN {r} IN ('list', 'listitem', 'tablist') THEN {_EMPTY} "
        f"WHEN list_contains({sections}, {r}) THEN CASE WHEN {nm} <> '' THEN ['', '**' || {nm} || ':**'] ELSE {_EMPTY} END "
        f"WHEN list_contains({transparent}, {r}) THEN {_o_nz(f'(CASE WHEN {inl} <> {chr(39)}{chr(39)} THEN {inl} ELSE {nm} END)')} "
        f"ELSE {_o_nz(ni)} END")


def _o_gather() -> str:
    render = f"CASE WHEN len(_b) > 0 THEN ['- ' || array_to_string(_b, ' ')] ELSE {_EMPTY} END"
    close = ("list_reduce(list_reverse(list_filter(s.st, lambda x: x.e <= j)), lambda c, x: "
             + let("list_concat(x.b, c)", "_b", render) + f", {_EMPTY})")
    add = ("CASE WHEN len(_keep) = 0 THEN {'out': list_concat(s.out, _add), 'st': _keep} "
           "ELSE {'out': s.out, 'st': list_concat(_keep[1:len(_keep) - 1], "
           "[{'e': _keep[-1].e, 'b': list_concat(_keep[-1].b, _add)}])} END")
    step = let(close, "_closed", let(
        "list_filter(s.st, lambda x: x.e > j)", "_keep", let(
            f"CASE WHEN j < len(_p) THEN CASE WHEN _hd[j + 1] OR (_p[j + 1].node AND _p[j + 1].role = 'listitem') "
            f"THEN {_EMPTY} ELSE _em[j + 1] END ELSE {_EMPTY} END", "_ej", let(
                "list_concat(_closed, _ej)", "_add", let(
                    add, "_s1",
                    "CASE WHEN j < len(_p) AND NOT _hd[j + 1] AND _p[j + 1].node AND _p[j + 1].role = 'listitem' "
                    "THEN {'out': _s1.out, 'st': list_concat(_s1.st, [{'e': _en[j + 1], 'b': []::VARCHAR[]}])} "
                    "ELSE _s1 END")))))
    init = "{'out': []::VARCHAR[], 'st': []::STRUCT(e BIGINT, b VARCHAR[])[]}"
    return f"list_reduce(generate_series(0, len(_p)), lambda s, j: {step}, {init}).out"


def _o_convert(text: str) -> list[tuple[str, str]]:
    consumers = arr(C.FOOTER_ROLES + ["heading", "table", "strong", "paragraph"] + C.INTERACTIVE_ROLES)
    parsed = f"list_transform(string_split({text}, chr(10)), lambda l: {snap_parse('l')})"
    ends = "list_transform(range(len(_p)), lambda i: coalesce(list_filter(_tf.pairs, lambda x: x.i = i)[1].e, len(_p)))"
    hidden = (f"list_transform(range(len(_p)), lambda i: len(list_filter(_an[i + 1], lambda x: _p[x + 1].node "
              f"AND list_contains({consumers}, _p[x + 1].role))) > 0)")
    em = f"list_transform(range(len(_p)), lambda i: CASE WHEN _hd[i + 1] THEN {_EMPTY} ELSE {_o_emission('i')} END)"
    ci = f"list_transform(range(len(_p)), lambda i: {_o_collect('i')})"
    url = f"list_transform(range(len(_p)), lambda i: {_o_meta('i', '- /url:')})"
    ph = f"list_transform(range(len(_p)), lambda i: {_o_meta('i', '- /placeholder:')})"
    return [("_p", parsed), ("_tf", snap_fold("_p")), ("_an", "_tf.anc"), ("_en", ends), ("_hd", hidden), ("_ci", ci), ("_url", url), ("_ph", ph),
            ("_em", em), ("_cv", f"array_to_string({_o_gather()}, chr(10))")]


def snap_outline_ctes(src: str, id_col: str, text_col: str) -> str:
    """CTE form of the outline twin (DuckDB binds nested lambda lets slowly at this size)."""
    fence = "```yaml" + "\n"
    # one column per step: bound as columns, not as nested lambda lets
    steps = "".join(f"c{i + 1} AS (SELECT *, {e} AS {n} FROM c{i}),\n" for i, (n, e) in enumerate(_o_convert("_tree")))
    last = len(_o_convert("_tree"))
    return f"""
o0 AS (SELECT {id_col} AS block_id, {text_col} AS _x, strpos({text_col}, '```yaml' || chr(10)) - 1 AS _s,
              CASE WHEN strpos(reverse({text_col}), '```' || chr(10)) = 0 THEN -1
                   ELSE length({text_col}) - strpos(reverse({text_col}), '```' || chr(10)) - 3 END AS _e FROM {src}),
o1 AS (SELECT *, NOT (_s = -1 OR _e = -1 OR _e <= _s) AS _f FROM o0),
o2 AS (SELECT *, CASE WHEN _f THEN substr(_x, _s + {len(fence) + 1}, _e - _s - {len(fence)}) ELSE _x END AS _tree FROM o1),
c0 AS (SELECT * FROM o2),
{steps}o3 AS (SELECT * FROM c{last}),
o4 AS (SELECT *, {js_trim("regexp_replace(CASE WHEN _f THEN " + js_trim("substr(_x, 1, _s) || _cv || substr(_x, _e + 5)") + " ELSE _cv END, '\\n{3,}', chr(10) || chr(10), 'g')")} AS _o FROM o3),
outline AS (SELECT block_id, _x AS text, CASE WHEN length(_o) >= length(_x) THEN NULL ELSE _o END AS outline FROM o4)"""
