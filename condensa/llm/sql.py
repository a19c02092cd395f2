"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import licences, mix, quality

_WORD = r"[^\x20\x09-\x0D]+"

OP5_MIX = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|{mix.SEED}'), 1, 12))::BIGINT AS key
  FROM documents),
per_source AS (SELECT source, sum(size)::HUGEINT AS s FROM sized GROUP BY source),
weighted AS (SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::HUGEINT AS w FROM per_source),
levels AS (
  SELECT *, sum(s) OVER o AS s_upto, sum(w) OVER o AS w_upto, sum(s) OVER () AS total, sum(w) OVER () AS all_w
  FROM weighted WINDOW o AS (ORDER BY s * (10 // w), coalesce('v' || source, 'n') ROWS UNBOUNDED PRECEDING)),
marked AS (SELECT *, 3 * s_upto * w + 3 * s * (all_w - w_upto) <= total * w AS is_full FROM levels),
opened AS (SELECT *, total - 3 * coalesce(sum(s) FILTER (is_full) OVER (), 0) AS open_total, all_w - coalesce(sum(w) FILTER (is_full) OVER (), 0) AS open_w FROM marked),
targets AS (SELECT source, s, CASE WHEN is_full THEN (3 * s)::DOUBLE ELSE (w * open_total)::DOUBLE / greatest(open_w, 1)::DOUBLE END AS target FROM opened),
budgets AS (SELECT *, CASE WHEN s > 0 THEN least(floor(target)::HUGEINT // s, 3) ELSE 0 END AS epochs FROM targets),
rests AS (SELECT *, CASE WHEN epochs >= 3 THEN 0 ELSE floor(target)::HUGEINT - epochs * s END AS rest FROM budgets),
placed AS (
  SELECT d.doc_id, d.size, r.s, r.target, r.epochs, r.rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, s::BIGINT AS source_size, target, (epochs * size + greatest(0, least(size, rest - upto + size)))::BIGINT AS taken
FROM placed"""


def _rate(times: int, part: str, whole: str) -> str:
    return f"CASE WHEN base_failed THEN NULL ELSE {times} * {part} // greatest({whole}, 1) END"


_FEATURE_SLACK = ", ".join(f"({i}, {slack}, {f in quality.LOW})" for i, (f, slack) in enumerate(quality.FEATURES.items()))


def _quartiles(source: str, keys: str) -> str:
    group = f"{keys}, feature" if keys else "feature"
    return f"""(SELECT {group}, any_value(n_all) AS n_all, min(bucket) FILTER (4 * upto >= n_all) AS q1,
        min(bucket) FILTER (4 * upto >= 2 * n_all) AS q2, min(bucket) FILTER (4 * upto >= 3 * n_all) AS q3
      FROM (SELECT *, sum(n) OVER (PARTITION BY {group}) AS n_all,
                   sum(n) OVER (PARTITION BY {group} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto
            FROM (SELECT {group}, bucket, sum(n) AS n FROM {source} GROUP BY {group}, bucket))
      GROUP BY {group})"""


OP2_QUALITY = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('v' || lang, 'n') AS lang, coalesce('v' || source, 'n') AS source,
         coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
          FROM (SELECT r, unnest(string_split(body, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
windows AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM docs)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n_rep FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM again) GROUP BY r),
counted AS (
  SELECT d.r, doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(body, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(body, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))::BIGINT AS n_stutter,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words
  FROM docs d LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
rates AS (
  SELECT *, [{_rate(1000, 'n_symbols', 'n_words')}, {_rate(1000, 'n_repeat_words', 'n_words')}, {_rate(100, 'word_chars', 'n_words')},
             {_rate(1000, 'n_capitals', 'word_chars')}, {_rate(1000, 'n_dup_lines', 'n_lines')}, {_rate(1000, 'n_stutter', 'n_words')}] AS vals FROM failed),
long AS (SELECT lang, source, feature, vals[feature + 1] AS v FROM (SELECT lang, source, vals, unnest(range({len(quality.FEATURES)})) AS feature FROM rates WHERE NOT base_failed)),
sketch AS (SELECT lang, source, feature, v >> greatest(length(bin(v)) - {quality.SUB_BITS}, 0) << greatest(length(bin(v)) - {quality.SUB_BITS}, 0) AS bucket, count(*) AS n FROM long GROUP BY ALL),
slack(feature, slack, has_low) AS (VALUES {_FEATURE_SLACK}),
picked AS (
  SELECT g.lang, g.source, feature, CASE WHEN g.n_all >= {quality.MIN_GROUP} THEN g.q1 WHEN l.n_all >= {quality.MIN_GROUP} THEN l.q1 ELSE t.q1 END AS q1,
         CASE WHEN g.n_all >= {quality.MIN_GROUP} THEN g.q2 WHEN l.n_all >= {quality.MIN_GROUP} THEN l.q2 ELSE t.q2 END AS q2,
         CASE WHEN g.n_all >= {quality.MIN_GROUP} THEN g.q3 WHEN l.n_all >= {quality.MIN_GROUP} THEN l.q3 ELSE t.q3 END AS q3
  FROM {_quartiles('sketch', 'lang, source')} g JOIN {_quartiles('sketch', 'lang')} l USING (lang, feature) JOIN {_quartiles('sketch', '')} t USING (feature)),
limits AS (SELECT lang, source, feature, CASE WHEN has_low THEN q2 - {quality.SPREAD} * (q2 - q1) - slack END AS low, q2 + {quality.SPREAD} * (q3 - q2) + slack AS high FROM picked JOIN slack USING (feature)),
bad AS (SELECT DISTINCT r FROM (SELECT r, lang, source, vals, unnest(range({len(quality.FEATURES)})) AS feature FROM rates WHERE NOT base_failed) v
        JOIN limits USING (lang, source, feature) WHERE vals[feature + 1] > high OR vals[feature + 1] < low)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept
FROM rates"""

OP9_JACCARD = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
grams AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 2)) AS i FROM docs WHERE len(w) >= 4)
  UNION ALL SELECT r, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 3),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
shares AS (SELECT a.r AS a, b.r AS b, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM shares JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT a AS r, min(doc_id) AS m FROM reach JOIN docs ON docs.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(doc_id, m), doc_id) AS component_id
FROM docs LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)"""

OP4_TOPK = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.r, q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score
          FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.r <> x.r AND len(q.e) = len(x.e)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


def _licences() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in licences.KNOWN.items())
    keywords = " OR ".join(f"contains(lower(text), '{k}')" for k in licences.KEYWORDS)
    steps = """SELECT r, doc_id, sentences, CASE WHEN sentences = '' THEN '' ELSE '|' || replace(sentences, ',', '||') || '|' END AS l0 FROM joined"""
    for n, (_, ids) in enumerate(licences.RULES):
        steps = f"SELECT *, replace(l{n}, '{''.join(f'|{i}|' for i in ids)}', '') AS l{n + 1} FROM ({steps})"
    names = ", ".join(f"CASE WHEN l{n + 1} <> l{n} THEN '{name}' END" for n, (name, _) in enumerate(licences.RULES))
    last = f"l{len(licences.RULES)}"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
pieces AS (
  SELECT r, list_transform(string_split(regexp_replace(text, '([.!?;:])[\\x20\\x09-\\x0D]', '\\1' || chr(10), 'g'), chr(10)),
                           lambda s: regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')) AS p
  FROM docs WHERE {keywords}),
known(s, id) AS (VALUES {known}),
places AS (SELECT r, p, unnest(range(1, len(p) + 1)) AS i FROM pieces),
runs AS (SELECT r, i, n, array_to_string(list_filter(p[i:i + n - 1], lambda x: x <> ''), ' ') AS s
         FROM (SELECT r, p, i, unnest(range(1, {licences.MAX_LINES + 1})) AS n FROM places WHERE p[i] <> '')),
found AS (SELECT r, i, arg_max(id, n) AS id FROM runs JOIN known USING (s) GROUP BY r, i),
joined AS (SELECT d.r, d.doc_id, coalesce(string_agg(id, ',' ORDER BY i), '') AS sentences FROM docs d LEFT JOIN found f ON d.r = f.r GROUP BY d.r, d.doc_id),
steps AS ({steps}),
named AS (SELECT *, list_filter([{names}], lambda x: x IS NOT NULL) AS names FROM steps)
SELECT doc_id, sentences, array_to_string(list_filter(names, lambda x, i: i = 1 OR NOT list_contains(names[1:i - 1], x)), ',') AS licences,
       ((length({last}) - length(replace({last}, '|', ''))) // 2)::BIGINT AS n_unknown
FROM named"""


OP3_LICENCES = _licences()


OP11_HARD_NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 5"""


def _value(cost: str, audit: str, line: str, rest: str) -> str:
    """A suffix's cost, audit and repaired lines after one edit; ``line`` is empty for a deleted row."""
    lines = f"{rest}.t" if not line else f"{line} || CASE WHEN {rest}.t = '' THEN '' ELSE chr(10) || {rest}.t END"
    return f"{{'c': {rest}.c + {cost}, 'a': '{audit}' || {rest}.a, 't': {lines}}}"


def _inserted(q: int, after: str) -> str:
    """State ``q``'s value with an inserted row before ``after``, the value of the state that it leads to."""
    return _value("2", "I", "'assistant:'" if q == 2 else "'user:'", after)


# states: 0 start, 1 after s, 2 after u, 3 after ua; what an inserted or reroled row leads to
_LEADS = (2, 2, 3, 2)


def _edits(q: int) -> str:
    to = _LEADS[q]
    role = "'assistant:'" if q == 2 else "'user:'"
    options = [f"CASE WHEN fault <= 1 THEN {_value('2 + fault', 'R', role + ' || text', f's{to}')} END"]
    for initial, state in {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[q]:
        options.append(f"CASE WHEN fault <= 1 AND initial = '{initial}' THEN " + _value("fault", "K", "role || ':' || text", f"s{state}") + " END")
    options.append(_value("3", "D", "", f"s{q}"))
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"


_BITS = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"

OP13_CONVERSATIONS = f"""
WITH RECURSIVE coded AS (
  SELECT coalesce('v' || conv_id, 'n') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
  FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: {_BITS}), 4294967295) % 20 AS kind FROM coded),
damaged AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0),
ordered AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM damaged),
placed AS (
  SELECT conv, turn, role, text, initial, n, lag(initial) OVER (PARTITION BY conv ORDER BY n) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 2
              WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 THEN 3
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 1 ELSE 0 END AS fault
  FROM ordered),
totals AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 2) AS blank,
         count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
         count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM placed GROUP BY conv),
suffixes AS (
  SELECT conv, max(n) AS n, {{'c': 0, 'a': '', 't': ''}} AS s0, {{'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS s1,
         {{'c': 2, 'a': 'I', 't': 'assistant:'}} AS s2, {{'c': 0, 'a': '', 't': ''}} AS s3
  FROM placed GROUP BY conv
  UNION ALL
  SELECT conv, n - 1, list_min([e0, {_inserted(0, "e2")}, {_inserted(0, f"({_inserted(2, 'e3')})")}]), list_min([e1, {_inserted(1, "e2")}, {_inserted(1, f"({_inserted(2, 'e3')})")}]),
         list_min([e2, {_inserted(2, "e3")}]), list_min([e3, {_inserted(3, "e2")}])
  FROM (SELECT s.conv, s.n, {", ".join(f"{_edits(q)} AS e{q}" for q in range(4))} FROM suffixes s JOIN placed p ON p.conv = s.conv AND p.n = s.n)),
ids AS (SELECT DISTINCT conv_id, coalesce('v' || conv_id, 'n') AS conv FROM conversations)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(s0.t, '')) AS repaired_sha256
FROM ids LEFT JOIN totals USING (conv) LEFT JOIN (SELECT * FROM suffixes WHERE n = 0) USING (conv)"""
