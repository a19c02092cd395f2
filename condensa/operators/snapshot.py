"""Page-snapshot jobs.

A snapshot block is reduced inside its own row: the lines are split and parsed (D1),
one stack fold gives every line its ancestors and the end of its subtree (D2), and the
Markdown outline is then a per-line projection over contiguous subtree slices
(D5-D8) followed by a fold that gathers list items. No shuffle and no join; a block's
lines never leave the task that read the block.

Inline content of a consumer (heading, link, button, strong, paragraph, column header)
renders nested inline markup to any depth: one fold from the last line to the first
hands each node the finished texts of its children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as E

S = E.sql_str

INTERACTIVE = E.sql_array(C.INTERACTIVE_ROLES)
TRANSPARENT = E.sql_array(C.TRANSPARENT_ROLES)
SECTIONS = E.sql_array(C.SECTION_ROLES)
FOOTERS = E.sql_array(C.FOOTER_ROLES)
ATTR_RE = r"\[(" + "|".join(C.SNAPSHOT_ATTRS) + r")\]"
# Roles that swallow their subtree in the outline.
MAIN_CONSUMERS = E.sql_array(C.FOOTER_ROLES + ["heading", "table", "strong", "paragraph"] + C.INTERACTIVE_ROLES)


# D1 ------------------------------------------------------------------------------------
def parse_line(l: str) -> str:
    """STRUCT of one snapshot line: blank, node, indent (tab = 2), role, quoted name
    (double, else single), ref, heading level, state attributes, trailing text after ': '."""
    content = f"regexp_extract({l}, {S(r'^\s*-\s+(.+)$')}, 1)"
    return E.let(content, "_c", (
        f"named_struct('line', {l}, 'blank', {E.js_trim(l)} = '', "
        f"'node', {l} rlike {S(r'^\s*-\s+.+$')} AND _c rlike {S(r'^/?[\w-]+')}, "
        f"'indent', length(replace(regexp_extract({l}, {S(r'^(\s*)-\s+.+$')}, 1), '\\t', '  ')), "
        f"'role', regexp_extract(_c, {S(r'^(/?[\w-]+)')}, 1), "
        f"'name', coalesce(nullif(regexp_extract(_c, {S(r'^[\w-]+\s+\"((?:[^\"\\]|\\.)*)\"')}, 1), ''), "
        f"regexp_extract(_c, {S(r"^[\w-]+\s+'((?:[^'\\]|\\.)*)'")}, 1)), "
        f"'ref', regexp_extract(_c, {S(r'\[ref=(\w+)\]')}, 1), "
        f"'level', coalesce(try_cast(nullif(regexp_extract(_c, {S(r'\[level=(\d+)\]')}, 1), '') AS INT), 0), "
        f"'attrs', regexp_extract_all(_c, {S(ATTR_RE)}, 1), "
        f"'inline', " + E.let(
            E.js_trim(f"regexp_replace(regexp_extract(_c, {S(r':\s+(.+?)\s*$')}, 1), {S(r'\[[\w=]+\]')}, '')"), "_ac",
            f"IF(_ac <> '' AND NOT _ac rlike {S(r'^[\s\[\]]*$')}, _ac, '')") + ")"))


def parsed_lines(text: str) -> str:
    return f"transform(split({text}, '\\n'), l -> {parse_line('l')})"


# D2 ------------------------------------------------------------------------------------
def tree_fold(p: str) -> str:
    """STRUCT(anc ARRAY<ARRAY<INT>>, ends ARRAY<INT>) from parsed lines ``p``.

    A subtree ends at the first later non-blank line that is not a node or is indented
    no deeper than its root; blank lines do not end it. ``anc[j]`` lists the open
    nodes above line j (the last one is its parent).
    """
    step = (
        f"IF({p}[j].blank, named_struct('st', s.st, 'anc', array_append(s.anc, s.st), 'pairs', s.pairs), "
        + E.let(f"IF({p}[j].node, filter(s.st, x -> {p}[x].indent < {p}[j].indent), CAST(array() AS ARRAY<INT>))", "_keep",
                f"named_struct('st', IF({p}[j].node, array_append(_keep, j), _keep), "
                f"'anc', array_append(s.anc, _keep), "
                f"'pairs', concat(s.pairs, transform(filter(s.st, x -> NOT array_contains(_keep, x)), "
                f"x -> named_struct('i', x, 'e', j))))") + ")")
    init = ("named_struct('st', CAST(array() AS ARRAY<INT>), 'anc', CAST(array() AS ARRAY<ARRAY<INT>>), "
            "'pairs', CAST(array() AS ARRAY<STRUCT<i: INT, e: INT>>))")
    fin = (f"named_struct('anc', s.anc, 'ends', " + E.let(
        "map_from_entries(transform(s.pairs, x -> struct(x.i, x.e)))", "_m",
        f"transform({p}, (x, i) -> coalesce(try_element_at(_m, i), size({p})))") + ")")
    return f"aggregate(sequence(0, size({p}) - 1), {init}, (s, j) -> {step}, s -> {fin})"


def _parent(a: str, j: str) -> str:
    return f"coalesce(try_element_at({a}[{j}], -1), -1)"


def _range(i: str, en: str) -> str:
    """Indices of the subtree of line i (exclusive of i)."""
    return f"IF({en}[{i}] > {i} + 1, sequence({i} + 1, {en}[{i}] - 1), CAST(array() AS ARRAY<INT>))"


def _nz(x: str) -> str:
    return f"IF({x} <> '', array({x}), CAST(array() AS ARRAY<STRING>))"


def _name_or_inline(p: str, j: str) -> str:
    return f"IF({p}[{j}].name <> '', {p}[{j}].name, {p}[{j}].inline)"


def _meta_value(p: str, i: str, en: str, prefix: str) -> str:
    """First line under i starting with ``prefix`` (after trim): its value, unquoted."""
    hit = f"filter({_range(i, en)}, k -> startswith({E.js_trim(f'{p}[k].line')}, {S(prefix)}))"
    val = E.js_trim(f"substring({E.js_trim(f'{p}[_h[0]].line')}, {len(prefix) + 1})")
    return E.let(hit, "_h", f"IF(size(_h) = 0, '', regexp_replace({val}, '^\"(.*)\"$', '$1'))")


def inline_fold(p: str, en: str) -> str:
    """MAP<INT, STRING>: the inline content of each line that shows it (D6), markup nested to any depth.

    Lines are taken from the last to the first with a stack of finished nodes, so a
    node finds the finished texts of its children on top: each text is built once.
    text, img and attribute lines leave their children to the node above them.
    """
    ni = _name_or_inline(p, "j")
    joined = E.js_trim(f"regexp_replace(array_join(filter(transform(_kids, x -> x.t), x -> x <> ''), ' '), {S(r'\s+')}, ' ')")
    link = E.let(f"IF({p}[j].name <> '', {p}[j].name, _in)", "_t", E.let(
        _meta_value(p, "j", en, "- /url:"), "_u",
        f"concat('[', _t, ']', IF(_u <> '', concat('(', _u, ')'), ''), IF({p}[j].ref <> '', concat(' [', {p}[j].ref, ']'), ''))"))
    text = (f"CASE WHEN startswith({p}[j].role, '/') THEN '' WHEN {p}[j].role = 'text' THEN {ni} "
            f"WHEN {p}[j].role = 'img' THEN IF({p}[j].name = '', '', concat('![', {p}[j].name, ']')) "
            f"WHEN {p}[j].role = 'strong' THEN " + E.let(f"IF({ni} <> '', {ni}, _in)", "_t", "IF(_t <> '', concat('**', _t, '**'), '')") +
            f" WHEN {p}[j].role = 'link' THEN {link} "
            f"WHEN array_contains({TRANSPARENT}, {p}[j].role) THEN IF({ni} <> '', {ni}, _in) ELSE {ni} END")
    flat = f"({p}[j].role IN ('text', 'img') OR startswith({p}[j].role, '/'))"
    entry = "array(named_struct('i', j, 't', _own))"
    shown = f"({p}[j].role IN ('heading', 'link', 'button', 'strong', 'paragraph', 'columnheader'))"
    step = E.let(f"filter(s.st, x -> x.i < {en}[j])", "_kids", E.let(joined, "_in", E.let(
        text, "_own",
        f"named_struct('st', IF({flat}, concat({entry}, s.st), concat({entry}, filter(s.st, x -> x.i >= {en}[j]))), "
        f"'out', IF({shown} AND _in <> '', array_append(s.out, named_struct('i', j, 't', _in)), s.out))")))
    none = "CAST(array() AS ARRAY<STRUCT<i: INT, t: STRING>>)"
    return (f"aggregate(sequence(size({p}) - 1, 0, -1), named_struct('st', {none}, 'out', {none}), "
            f"(s, j) -> IF({p}[j].node, {step}, s), s -> map_from_entries(transform(s.out, x -> struct(x.i, x.t))))")


def collect_inline(i: str) -> str:
    """Inline content under line i, from the map ``_ct`` of ``inline_fold``."""
    return f"coalesce(try_element_at(_ct, {i}), '')"


def _attrs(p: str, i: str) -> str:
    return f"IF(size({p}[{i}].attrs) > 0, concat(' (', array_join({p}[{i}].attrs, ', '), ')'), '')"


def _ref_prefix(p: str, i: str) -> str:
    return f"IF({p}[{i}].ref <> '', concat('[', {p}[{i}].ref, '] '), '')"


# D7 ------------------------------------------------------------------------------------
def _cell_text(p: str, a: str, en: str, x: str) -> str:
    header = f"IF({p}[{x}].name <> '', {p}[{x}].name, {collect_inline(x)})"
    fold = (f"aggregate({_range(x, en)}, named_struct('t', IF({_name_or_inline(p, x)} <> '', {_name_or_inline(p, x)}, ''), "
            f"'r', ''), (s, k) -> CASE WHEN {p}[k].node AND {p}[k].role = 'link' THEN "
            f"named_struct('t', IF({p}[k].name <> '', {p}[k].name, s.t), 'r', {p}[k].ref) "
            f"WHEN {p}[k].node AND {p}[k].role = 'button' THEN named_struct('t', s.t, 'r', {p}[k].ref) ELSE s END, "
            f"s -> IF(s.r <> '', concat(s.t, ' [', s.r, ']'), s.t))")
    return f"IF({p}[{x}].role = 'columnheader', {header}, {fold})"


def _render_rows(p: str, a: str, en: str, c: str) -> str:
    """Markdown lines of the rows directly under line c."""
    rows = (f"filter(transform(filter({_range(c, en)}, r -> {p}[r].node AND {p}[r].role = 'row' "
            f"AND {_parent(a, 'r')} = {c}), r -> " + E.let(
                f"filter({_range('r', en)}, x -> {p}[x].node AND {p}[x].role IN ('cell', 'columnheader') "
                f"AND {_parent(a, 'x')} = r)", "_cx",
                f"named_struct('cells', transform(_cx, x -> {_cell_text(p, a, en, 'x')}), "
                f"'hdr', exists(_cx, x -> {p}[x].role = 'columnheader'))") + "), z -> size(z.cells) > 0)")
    body = E.let("array_max(transform(_rows, z -> size(z.cells)))", "_w",
                 "flatten(transform(_rows, (z, ri) -> " + E.let(
                     "concat(z.cells, array_repeat('', _w - size(z.cells)))", "_pc",
                     "IF(z.hdr OR (ri = 0 AND size(_rows) > 1), "
                     "array(concat('| ', array_join(_pc, ' | '), ' |'), "
                     "concat('| ', array_join(transform(_pc, q -> '---'), ' | '), ' |')), "
                     "array(concat('| ', array_join(_pc, ' | '), ' |')))") + "))")
    return E.let(rows, "_rows", f"IF(size(_rows) = 0, CAST(array() AS ARRAY<STRING>), {body})")


def render_table(p: str, a: str, en: str, t: str) -> str:
    """Rows of the rowgroups under line t, at any depth (an inner group before the rows of
    the one around it), then the table's own rows."""
    groups = (f"filter({_range(t, en)}, g -> {p}[g].node AND {p}[g].role = 'rowgroup' "
              f"AND forall(filter({a}[g], x -> x > {t}), x -> {p}[x].role = 'rowgroup'))")
    ordered = f"transform(array_sort(transform({groups}, g -> struct({en}[g] AS e, -g AS o))), z -> -z.o)"
    return f"concat(flatten(transform({ordered}, g -> {_render_rows(p, a, en, 'g')})), {_render_rows(p, a, en, t)})"


# D5 ------------------------------------------------------------------------------------
def emission(p: str, a: str, en: str, i: str) -> str:
    """ARRAY<STRING> a processed line emits (list items are gathered later)."""
    r = f"{p}[{i}].role"
    nm = f"{p}[{i}].name"
    inl = f"{p}[{i}].inline"
    ni = _name_or_inline(p, i)
    ci = collect_inline(i)
    empty = "CAST(array() AS ARRAY<STRING>)"
    return (
        f"CASE WHEN {p}[{i}].blank THEN {empty} "
        f"WHEN NOT {p}[{i}].node THEN {_nz(E.js_trim(f'{p}[{i}].line'))} "
        f"WHEN array_contains({FOOTERS}, {r}) OR startswith({r}, '/') THEN {empty} "
        f"WHEN {r} = 'text' THEN {_nz(ni)} "
        f"WHEN {r} = 'heading' THEN array(concat(repeat('#', least(IF({p}[{i}].level = 0, 1, {p}[{i}].level), 6)), ' ', "
        f"IF({nm} <> '', {nm}, IF({en}[{i}] > {i} + 1, {ci}, '')))) "
        f"WHEN {r} = 'link' THEN " + E.let(_meta_value(p, i, en, "- /url:"), "_u", E.let(
            f"IF({nm} <> '', {nm}, {ci})", "_t",
            f"array(concat('[', _t, ']', IF(_u <> '', concat('(', _u, ')'), ''), "
            f"IF({p}[{i}].ref <> '', concat(' [', {p}[{i}].ref, ']'), '')))")) + " "
        f"WHEN {r} = 'button' THEN array(concat({_ref_prefix(p, i)}, 'button \"', IF({nm} <> '', {nm}, {ci}), '\"', "
        f"{_attrs(p, i)})) "
        f"WHEN array_contains({INTERACTIVE}, {r}) THEN " + E.let(
            _meta_value(p, i, en, "- /placeholder:"), "_ph",
            f"array(concat({_ref_prefix(p, i)}, {r}, ' \"', {nm}, '\"', "
            f"IF(_ph <> '', concat(' — \"', _ph, '\"'), ''), {_attrs(p, i)}))") + " "
        f"WHEN {r} = 'strong' THEN array(concat('**', IF({ni} <> '', {ni}, {ci}), '**')) "
        f"WHEN {r} = 'paragraph' THEN {_nz(f'IF({ni} <> {chr(39)}{chr(39)}, {ni}, {ci})')} "
        f"WHEN {r} = 'img' THEN IF({nm} <> '', array(concat('![', {nm}, ']')), {empty}) "
        f"WHEN {r} = 'table' THEN {render_table(p, a, en, i)} "
        f"WHEN {r} IN ('list', 'listitem', 'tablist') THEN {empty} "
        f"WHEN array_contains({SECTIONS}, {r}) THEN IF({nm} <> '', array('', concat('**', {nm}, ':**')), {empty}) "
        f"WHEN array_contains({TRANSPARENT}, {r}) THEN {_nz(f'IF({inl} <> {chr(39)}{chr(39)}, {inl}, {nm})')} "
        f"ELSE {_nz(ni)} END")


def hidden(p: str, a: str, j: str) -> str:
    """Line j sits under a node that swallows its subtree (J8 for footers)."""
    return f"exists({a}[{j}], x -> {p}[x].node AND array_contains({MAIN_CONSUMERS}, {p}[x].role))"


def gather(p: str, en: str, em: str, hid: str) -> str:
    """Fold emissions in line order; a list item's lines become one '- ...' line."""
    render = "IF(size(_b) > 0, array(concat('- ', array_join(_b, ' '))), CAST(array() AS ARRAY<STRING>))"
    close = (
        "aggregate(reverse(filter(s.st, x -> x.e <= j)), CAST(array() AS ARRAY<STRING>), "
        "(c, x) -> " + E.let("concat(x.b, c)", "_b", render) + ")")
    keep = "filter(s.st, x -> x.e > j)"
    add = ("IF(size(_keep) = 0, named_struct('out', concat(s.out, _add), 'st', _keep), "
           "named_struct('out', s.out, 'st', concat(slice(_keep, 1, size(_keep) - 1), "
           "array(named_struct('e', element_at(_keep, -1).e, 'b', concat(element_at(_keep, -1).b, _add))))))")
    step = E.let(close, "_closed", E.let(keep, "_keep0", E.let(
        # emission of the closed items first, then of line j (if any)
        f"IF(j < size({p}), IF({hid}[j] OR ({p}[j].node AND {p}[j].role = 'listitem'), "
        f"CAST(array() AS ARRAY<STRING>), {em}[j]), CAST(array() AS ARRAY<STRING>))", "_ej",
        E.let("_keep0", "_keep", E.let("concat(_closed, _ej)", "_add", E.let(
            add, "_s1",
            f"IF(j < size({p}) AND NOT {hid}[j] AND {p}[j].node AND {p}[j].role = 'listitem', "
            f"named_struct('out', _s1.out, 'st', concat(_s1.st, array(named_struct('e', {en}[j], "
            f"'b', CAST(array() AS ARRAY<STRING>))))), _s1)"))))))
    init = ("named_struct('out', CAST(array() AS ARRAY<STRING>), "
            "'st', CAST(array() AS ARRAY<STRUCT<e: INT, b: ARRAY<STRING>>>))")
    return f"aggregate(sequence(0, size({p})), {init}, (s, j) -> {step}, s -> s.out)"


def convert_tree(text: str) -> str:
    """Markdown outline of a snapshot tree text (lines joined by newline)."""
    return E.let(parsed_lines(text), "_p", E.let(tree_fold("_p"), "_tf", E.let(
        "_tf.anc", "_an", E.let("_tf.ends", "_en", E.let(
            f"transform(_p, (x, i) -> {hidden('_p', '_an', 'i')})", "_hd", E.let(inline_fold("_p", "_en"), "_ct", E.let(
                f"transform(_p, (x, i) -> IF(_hd[i], CAST(array() AS ARRAY<STRING>), {emission('_p', '_an', '_en', 'i')}))",
                "_em", f"array_join({gather('_p', '_en', '_em', '_hd')}, '\\n')")))))))


# D3 + D9 -------------------------------------------------------------------------------
def outline_expr(text: str) -> str:
    """Snapshot → Markdown with the fence split (D3) and the whole-block guard.

    Returns the reduced text, or NULL when the conversion is not shorter.
    """
    fence = "```yaml\n"
    start = f"(locate({S(fence)}, _x) - 1)"
    end = f"IF(locate({S('```' + chr(10))}, reverse(_x)) = 0, -1, length(_x) - locate({S('```' + chr(10))}, reverse(_x)) - 3)"
    fenced = "NOT (_s = -1 OR _e = -1 OR _e <= _s)"
    # The tree text is cut out first so the conversion appears once in the expression.
    conv = E.let(start, "_s", E.let(end, "_e", E.let(
        f"IF({fenced}, substring(_x, _s + {len(fence) + 1}, _e - _s - {len(fence)}), _x)", "_tree",
        E.let(convert_tree("_tree"), "_cv",
              f"IF({fenced}, " + E.js_trim("concat(substring(_x, 1, _s), _cv, substring(_x, _e + 5))") + ", _cv)"))))
    cleaned = E.js_trim(f"regexp_replace({conv}, '\\n{{3,}}', '\\n\\n')")
    return E.let(text, "_x", E.let(cleaned, "_o", "IF(length(_o) >= length(_x), NULL, _o)"))


def with_outline(df: DataFrame, text_col: str, out_col: str = "outline") -> DataFrame:
    return df.withColumn(out_col, F.expr(outline_expr(text_col)))


# Line table (D1, D2, J8, A13) -------------------------------------------------------------
def line_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per snapshot line: parsed fields, parent, depth, subtree end, hidden flags."""
    arrays = E.let(parsed_lines(text_col), "_p", E.let(tree_fold("_p"), "_tf", (
        "transform(_p, (x, i) -> named_struct('i', i, 'x', x, 'anc', _tf.anc[i], 'end', _tf.ends[i], "
        f"'hidden', {hidden('_p', '_tf.anc', 'i')}, "
        "'under_footer', exists(_tf.anc[i], y -> _p[y].node AND array_contains("
        f"{FOOTERS}, _p[y].role))))")))
    t = (df.select(F.col(id_col).alias("block_id"), F.explode_outer(F.expr(arrays)).alias("_l"))
         .filter(F.col("_l").isNotNull()))
    return t.select(
        "block_id", F.col("_l.i").alias("line_no"), F.col("_l.x.line").alias("line"),
        F.col("_l.x.blank").alias("blank"), F.col("_l.x.node").alias("node"),
        F.col("_l.x.indent").alias("indent"), F.col("_l.x.role").alias("role"), F.col("_l.x.name").alias("name"),
        F.col("_l.x.ref").alias("ref"), F.col("_l.x.level").alias("level"),
        F.array_join("_l.x.attrs", ",").alias("attrs"), F.col("_l.x.inline").alias("inline_text"),
        F.coalesce(F.expr("try_element_at(_l.anc, -1)"), F.lit(-1)).alias("parent"),
        F.size("_l.anc").alias("depth"), F.col("_l.end").alias("subtree_end"),
        F.col("_l.hidden").alias("hidden"), F.col("_l.under_footer").alias("under_footer"))


# D10 -----------------------------------------------------------------------------------
FOOTER_LINE = r"^[\t ]*- contentinfo\b|^[\t ]*- heading \"Footer\"|^[\t ]*- navigation \"Footer\""


def _clean_indent(l: str) -> str:
    return f"length(replace(regexp_extract({l}, {S(r'^([\t ]*)')}, 1), '\\t', '  '))"


def cleanup_expr(text: str) -> str:
    """Line cleanup profile (D10); NULL when the result is not shorter."""
    lines = f"split(_x, '\\n')"
    ind = f"transform(_ls, l -> {_clean_indent('l')})"
    # Footer skip: a footer line hides every later line indented deeper than it.
    skip = ("aggregate(sequence(0, size(_ls) - 1), named_struct('u', -1, 'f', CAST(array() AS ARRAY<BOOLEAN>)), "
            "(s, i) -> " + E.let(
                "IF(s.u >= 0 AND _in[i] > s.u, true, false)", "_sk",
                f"IF(_sk, named_struct('u', s.u, 'f', array_append(s.f, true)), "
                f"IF(_ls[i] rlike {S(FOOTER_LINE)}, named_struct('u', _in[i], 'f', array_append(s.f, true)), "
                "named_struct('u', -1, 'f', array_append(s.f, false))))") + ", s -> s.f)")
    step1 = f"regexp_replace(_ls[i], {S(r'\s*\[cursor=pointer\]')}, '')"
    inter = (f"array_contains({INTERACTIVE}, regexp_extract(_c1, {S(r'^[\t ]*-\s+(\w+)')}, 1)) "
             f"AND _c1 rlike {S(r'^[\t ]*-\s+\w+')}")
    step2 = f"IF({inter}, _c1, regexp_replace(_c1, {S(r'\s*\[ref=\w+\]')}, ''))"
    step3 = f"regexp_replace(_c2, {S(r'\s*role=\"(?:generic|none)\"')}, '')"
    step5 = (f"regexp_replace(regexp_replace(_c3, {S(r"^([\t ]*-\s+)'row \".*?\"(\s*\[ref=\w+\])?'")}, '$1row$2'), "
             f"{S(r'^([\t ]*-\s+)row \".*?\"(\s*\[ref=\w+\])?:')}, '$1row$2:')")
    # A bare generic line whose next line is deeper and with at most one child at +2.
    wrapper = (f"_c5 rlike {S(r'^([\t ]*)-\s+generic\s*:?\s*$')} AND i + 1 < size(_ls) AND _in[i + 1] > _in[i] AND "
               + E.let("aggregate(slice(_in, i + 2, size(_ls)), named_struct('n', 0, 'stop', false), "
                       "(s, v) -> IF(s.stop OR s.n > 1, s, IF(v <= _in[i], named_struct('n', s.n, 'stop', true), "
                       "named_struct('n', s.n + IF(v = _in[i] + 2, 1, 0), 'stop', false))), s -> s.n)",
                       "_cc", "_cc <= 1"))
    step7 = f"regexp_replace(_c5, {S(r'^([\t ]*-\s+)generic(?:\s*\[ref=\w+\])?\s*:\s*(.+)')}, '$1$2')"
    step8 = f"regexp_replace(_c7, {S(r'^([\t ]*)-\s+text:\s*')}, '$1  ')"
    per_line = E.let(step1, "_c1", E.let(step2, "_c2", E.let(step3, "_c3", (
        f"IF(_c3 rlike {S(r'^[\t ]*-\s+img\s*$')}, NULL, " + E.let(step5, "_c5", (
            f"IF({wrapper}, NULL, " + E.let(step7, "_c7", E.let(
                step8, "_c8", f"IF({E.js_trim('_c8')} = '', NULL, _c8)")) + ")")) + ")"))))
    body = (f"filter(transform(sequence(0, size(_ls) - 1), i -> IF(_sk[i], NULL, {per_line})), v -> v IS NOT NULL)")
    out = f"regexp_replace(array_join({body}, '\\n'), '\\n{{3,}}', '\\n\\n')"
    return E.let(text, "_x", E.let(lines, "_ls", E.let(ind, "_in", E.let(skip, "_sk", E.let(
        out, "_o", "IF(length(_o) >= length(_x), NULL, _o)")))))
