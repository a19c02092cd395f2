"""Query synthesis from a tool call: URL, path and argument keywords."""

from __future__ import annotations

from ..functions.exprs import js_trim, sql_array

URL_KEYS = ["url", "uri", "href"]
PATH_KEYS = ["path", "file", "file_path", "filepath"]
VERBATIM_KEYS = ["query", "search", "pattern", "selector", "command"]


def url_keywords(u: str) -> str:
    """Path parts longer than 1 (``-``/``_`` to space), then the host without ``www.``.

    A value that does not parse as a URL is returned as is.
    """
    path = f"try_parse_url({u}, 'PATH')"
    host = f"try_parse_url({u}, 'HOST')"
    parts = f"transform(filter(split(coalesce({path}, ''), '/'), p -> length(p) > 1), p -> translate(p, '-_', '  '))"
    return (f"IF({host} IS NULL, {u}, "
            f"array_join(concat({parts}, array(regexp_replace({host}, '^(.*?)www\\\\.', '$1'))), ' '))")


def path_keywords(p: str) -> str:
    """Non-empty parts not starting with ``.``; ``-``, ``_`` and ``.`` to space."""
    return (f"array_join(transform(filter(split({p}, '/'), x -> length(x) > 0 AND NOT startswith(x, '.')), "
            f"x -> translate(x, '-_.', '   ')), ' ')")


def arg_keywords(args_json: str) -> str:
    """ARRAY<STRING> of keywords from a JSON object of arguments, in key order.

    Only string values count. url/uri/href → URL keywords; path/file/file_path/filepath
    → path keywords; query/search/pattern/selector/command → verbatim; any other string
    shorter than 200 characters → verbatim.
    """
    m = f"from_json({args_json}, 'map<string,variant>')"
    v = "variant_get(e.value, '$', 'string')"
    kw = (f"CASE WHEN array_contains({sql_array(URL_KEYS)}, e.key) THEN {url_keywords(v)} "
          f"WHEN array_contains({sql_array(PATH_KEYS)}, e.key) THEN {path_keywords(v)} "
          f"WHEN array_contains({sql_array(VERBATIM_KEYS)}, e.key) THEN {v} "
          f"WHEN length({v}) < 200 THEN {v} END")
    return (f"filter(transform(coalesce(map_entries({m}), array()), "
            f"e -> IF(schema_of_variant(e.value) = 'STRING', {kw}, NULL)), x -> x IS NOT NULL)")


def synthetic_query(tool_name: str, own_args: str, inherited_args: list[str]) -> str:
    """Tool name with ``_``/``-`` as spaces, own keywords, inherited keywords; trimmed."""
    parts = [f"array(translate({tool_name}, '_-', '  '))", arg_keywords(own_args)]
    parts += [f"coalesce({arg_keywords(a)}, array())" for a in inherited_args]
    return js_trim(f"array_join(concat({', '.join(parts)}), ' ')")
