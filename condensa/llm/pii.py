"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Method:

1. Candidate spans are the matches of the base patterns, the tokens with a digit, keys of known shape,
   what is assigned (= or :) to a secret word, and the names and places of the gazetteers.
   Regex, gazetteer and context labelers vote on each: yes, no, or no vote.
2. All spans of the corpus are counted by vote pattern (at most 3^labelers rows).
   Expectation-maximisation over the counts estimates, with no labels given, each
   labeler's reliability (its rates of yes, no and no vote for either class).
3. A logistic classifier over the spans' own shapes and contexts is fitted to the posteriors. It is fitted on
   TRAIN_ROWS different spans (all, if there are fewer), those of the least hashes; counts and EM use all.
4. The classifier decides on every candidate. Matches of the base patterns stay whatever it says.

Base patterns (leftmost, non-overlapping, per kind; a match that fails its check is
dropped without another try): email, ip, card, phone. They are searched from their fixed character
('@', '+') or from the beginning of a run of digits, so that long texts take linear time.
Other spans that the classifier accepts are of kind ``contact`` if they have a phone number's shape
(the base pattern drops one that is followed by more digits), ``name`` or ``place`` if a gazetteer has them, else ``secret``.

A null text is an empty one and has no spans; ``redact`` keeps it null. Repeated rows are
rows of their own; an empty table gives no rows and a classifier that accepts nothing.
Extra columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.shipping import ship

from .common import stage

KINDS = ("email", "ip", "card", "phone")
OTHERS = ("secret", "contact", "name", "place")
TRAIN_ROWS = 20_000
EM_ROUNDS = 100

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DIALLED = re.compile(r"\+[0-9]{1,3}[ -]?\([0-9]{2,4}\)[ -]?[0-9]{3,4}-[0-9]{3,4}(?![0-9])")
_TOKEN = re.compile(r"""[^\s"'<>()\[\]{},;|]+""")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            pos = m.end()
            yield start, pos
        at = text.find("@", max(at + 1, pos))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _byte(digits: str) -> bool:
    """At most 255; leading zeros count nothing, however many (int() takes no more than some thousand digits)."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the four kinds, by kind, then start."""
    spans = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return spans
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(_byte(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(_DIGIT.findall(m.group()))
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return spans


@dataclass(frozen=True)
class Candidate:
    """A span, the text just before it, and the base kind that it has, if any."""

    start: int
    end: int
    body: str
    before: str
    kind: str | None


CONTEXT = 32


def candidates(text: str, base: list[Span]) -> list[Candidate]:
    """Base spans, then what touches none of them or of those before: dialled numbers, values assigned to secret
    words and keys (those that the tokens with a digit do not give), tokens with a digit, names and places.
    Of key=value the value counts."""
    found = [Candidate(a, b, text[a:b], text[max(0, a - CONTEXT):a], kind) for kind, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []

    def add(spans: Iterator[tuple[int, int]]) -> None:
        nonlocal taken, starts, reach
        new = []
        for a, b in spans:
            i = bisect_left(starts, b)
            if not (i and reach[i - 1] > a):
                new.append((a, b))
                found.append(Candidate(a, b, text[a:b], text[max(0, a - CONTEXT):a], None))
        if new:
            taken = sorted([*taken, *new])
            starts = [a for a, _ in taken]
            reach = np.maximum.accumulate([b for _, b in taken]).tolist()

    digits = bool(_DIGIT.search(text))
    if digits and "+" in text:
        add(m.span() for m in _DIALLED.finditer(text))
    if "=" in text or ":" in text:
        lower = text.lower()
        if any(w in lower for w in _SECRET_STEMS):
            add(_assigned(text))
    if max(map(len, text.split()), default=0) >= 16:  # the shortest key
        add(m.span() for m in _KEY.finditer(text) if not _DIGIT.search(m.group()))
    if digits:
        add(_digit_tokens(text))
    add(_listed(text))
    return found


def _digit_tokens(text: str) -> Iterator[tuple[int, int]]:
    begin = 0
    for line in text.split("\n"):
        if _DIGIT.search(line):
            for m in _TOKEN.finditer(line):
                token = m.group()
                if not _DIGIT.search(token):
                    continue
                a = m.start() + (token.rfind("=", 0, -1) + 1)
                body = line[a:m.end()].rstrip(_TAIL)
                if _DIGIT.search(body):
                    yield begin + a, begin + a + len(body)
        begin += len(line) + 1


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """Values of secret words that are no token with a digit: without a digit, or of several words in quotes."""
    for m in _ASSIGNMENT.finditer(text):
        if _SECRET_KEY.search(m.group("key")):
            kind = "quoted" if m.group("quoted") else "plain"
            body = m.group(kind) if kind == "quoted" else m.group(kind).rstrip(_TAIL)
            if body.strip() and (not _DIGIT.search(body) or len(body.split()) > 1):
                yield m.start(kind), m.start(kind) + len(body)


def _listed(text: str) -> Iterator[tuple[int, int]]:
    """Names and places of the gazetteers; a given name takes the capitalised words after it along."""
    end = 0
    for m in _CAPITALISED.finditer(text):
        word = m.group().capitalize()
        if m.start() >= end and word in LISTED:
            end = _MORE_NAME.match(text, m.end()).end() if word in GIVEN else m.end()
            yield m.start(), end


# Gazetteers and shapes of the labelers.
_KEY_SHAPE = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z-]{16,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{30,}")
_HEX = re.compile(r"(?:[0-9a-f]{16,}|[0-9A-F]{16,})")
_KEY = re.compile(rf"(?<![\w-])(?:{_KEY_SHAPE.pattern}|{_HEX.pattern})(?![\w-])")
_PERSON_NUMBER = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")  # as a social security number
_PLAIN_NUMBER = re.compile(rf"(?!{_PERSON_NUMBER.pattern}$)[vV]?[0-9]{{1,7}}(?:[.:/-][0-9]{{1,4}}){{0,2}}(?:st|nd|rd|th|s|%)?")
_SECRET_WORDS = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth|bearer|credential|private)", re.I)
_PERSON_WORDS = re.compile(r"(?:e-?mail|mail|phone|tel|mobile|call|card|visa|account|iban|passport|ssn|address|contact|\bip\b)", re.I)
_PUBLIC_WORDS = re.compile(r"(?:version|licen[sc]e|copyright|chapter|section|page|figure|table|isbn|\bcc\b|by-nc|\bno\.|release)", re.I)
_ASSIGNED = re.compile(r"""[=:]\s*["']?$""")
_TAIL = ".:!?=*%&$#"
_SECRET_KEY = re.compile(r"(?:pass(?:word|wd|phrase|code)|(?<![a-z])pass(?![a-z])|pwd|token|secret|api[_-]?key|access[_-]?key|auth(?!or)|bearer|credential|private)", re.I)
_SECRET_STEMS = ("pass", "pwd", "token", "secret", "key", "auth", "bearer", "credential", "private")  # one is in each match of _SECRET_KEY
_ASSIGNMENT = re.compile(r"""(?<![\w-])(?P<key>[\w-]++)["']?[ \t]*+(?::=|=>|[=:])[ \t]*+(?:(?P<quote>["'])(?P<quoted>(?:(?!(?P=quote))[^\n])++)(?P=quote)|["']?(?P<plain>[^\s"'<>()\[\]{},;|]+))""")
_CAPITALISED = re.compile(r"(?<![^\W_])[^\W\d_a-z][^\W\d_]++")
_MORE_NAME = re.compile(r"(?:(?:-|[ \t]+(?:(?:von|van|der|den|de|da|del|la|le|du|di)[ \t]+)*+)(?:[A-Z]\.|[A-ZÀ-ÖØ-Þ][^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*(?:['’][^\W\d_]+)?)){0,3}")
GIVEN = frozenset("""Adam Agnes Ahmed Alejandro Alexander Alice Amélie Andrea Andreas Andrew Angela Anna Anne Anthony Antoine Antonio Barbara Beatriz Benjamin Birgit Brian Camille
Carlos Carmen Catherine Charles Charlotte Christian Christine Christopher Claire Claudia Daniel David Deborah Diego Dieter Dominique Donald Dorothy Edward Elena Elizabeth Emily Emma Eric
Fatima Felix Fernando Florian Francisco Franz François Françoise Frédéric Gabriel Gary George Gérard Guillaume Hannah Hans Heike Heinz Helen Helga Henri Ingrid Isabel Isabelle Jacques James
Javier Jean Jeffrey Jennifer Jessica Joan Johannes John Jonathan Jorge Joseph José Juan Julia Julie Julien Jürgen Karen Karin Karl Kenneth Kevin Klaus Laura Laurent Linda Lisa Lucía Luis
Lukas Manfred Manuel Margaret Maria Marie Mario Mark Martin Martina Mary María Matthew Matthias Michael Michel Michelle Miguel Mohammed Monika Nancy Nathalie Nicolas Nicole Olivia Olivier
Pablo Patricia Patrick Paul Paula Pedro Peter Petra Philippe Pierre Rachel Rafael Raúl Rebecca Renate Richard Robert Roberto Ronald Rosa Ruth Sabine Samuel Sandra Sarah Sebastian Sergio
Sofía Sophia Sophie Stefan Stephanie Stephen Steven Susan Susanne Sylvie Teresa Thomas Timothy Ursula Uwe Valérie Walter Werner William Wolfgang Yasmin""".split())
FAMILY = frozenset("""Anderson Bauer Becker Bernard Brown Clark Davies Davis Dubois Dupont Durand Díaz Evans Fernández Fischer Fournier Garcia García Girard Gomez Gonzalez González Gómez
Harris Hernandez Hernández Hoffmann Jackson Jiménez Johnson Jones Khan Klein Koch Krüger Lefebvre Leroy Lewis Lopez López Martinez Martín Martínez Meyer Mitchell Moreau Moreno Muñoz Müller
Nguyen Patel Pérez Ramirez Ramírez Richter Robinson Rodriguez Rodríguez Romero Roberts Rousseau Ruiz Sánchez Schmidt Schmitz Schneider Schröder Schulz Schäfer Singh Smith Taylor Thompson
Torres Wagner Weber Williams Wilson Zimmermann Álvarez""".split())
PLACES = frozenset("""Amsterdam Athens Atlanta Barcelona Beijing Berlin Bilbao Bogotá Bordeaux Boston Brussels Budapest Cairo Chicago Copenhagen Dallas Delhi Denver Dresden Dublin Dubai
Düsseldorf Edinburgh Frankfurt Geneva Glasgow Hamburg Helsinki Houston Istanbul Jakarta Johannesburg Karachi Köln Lagos Leipzig Lille Lima Lisbon Liverpool London Lyon Madrid Manchester
Marseille Melbourne Miami Milan Montreal Moscow Mumbai Munich München Málaga Nairobi Nantes Naples Oslo Paris Philadelphia Prague Rome Rotterdam Seattle Seoul Sevilla Shanghai Singapore
Stockholm Strasbourg Stuttgart Sydney Tokyo Toronto Toulouse Valencia Vancouver Vienna Warsaw Wien Zaragoza Zurich Zürich""".split())
LISTED = GIVEN | FAMILY | PLACES


def _words(body: str) -> set[str]:
    return {m.group().capitalize() for m in _CAPITALISED.finditer(body)}


def _turns(body: str) -> int:
    """Changes between letters, digits and the rest."""
    kinds = ["d" if c.isdigit() else "a" if c.isalpha() else "o" for c in body]
    return sum(a != b for a, b in zip(kinds, kinds[1:]))


def votes(c: Candidate) -> str:
    """One letter per labeler: y, n, or - for no vote."""
    turns, words = _turns(c.body), _words(c.body)
    named = bool(words & (GIVEN | FAMILY))
    return "".join((
        "y" if c.kind else "-",
        "y" if _KEY_SHAPE.fullmatch(c.body) else "-",
        "y" if _HEX.fullmatch(c.body) and not c.body.isdigit() else "-",
        "n" if _PLAIN_NUMBER.fullmatch(c.body) and not c.kind else "-",
        "y" if _SECRET_WORDS.search(c.before) else "-",
        "y" if _PERSON_WORDS.search(c.before) else "-",
        "n" if _PUBLIC_WORDS.search(c.before) else "-",
        "y" if _ASSIGNED.search(c.before) and len(c.body) >= 8 else "-",
        "y" if _DIALLED.fullmatch(c.body) else "-",
        "n" if not c.kind and c.body.isdigit() and 13 <= len(c.body) <= 19 and not luhn(c.body) else "-",
        "y" if len(c.body) >= 14 and turns >= 4 else "n" if len(c.body) < 8 or turns == 0 else "-",
        "y" if words & GIVEN else "-",
        "y" if words & FAMILY else "-",
        "n" if words & PLACES and not named else "-",
        "y" if _PERSON_NUMBER.fullmatch(c.body) else "-",
    ))


def features(c: Candidate) -> list[float]:
    """Shape and context of a span, all between 0 and about 1; the first is the constant."""
    n = max(1, len(c.body))
    words = _words(c.body)
    named = bool(words & (GIVEN | FAMILY))
    digits, upper, lower = (sum(map(f, c.body)) for f in (str.isdigit, str.isupper, str.islower))
    return [1.0, min(n, 40) / 40, float(n >= 8), float(n >= 14), digits / n, upper / n, lower / n, min(_turns(c.body), 12) / 12, float("@" in c.body),
            float(c.body.startswith("+")), float(c.body.count(".") == 3 and digits + 3 == n), float(bool(_HEX.fullmatch(c.body))),
            float(bool(_PLAIN_NUMBER.fullmatch(c.body))), float(bool(_ASSIGNED.search(c.before))), float(bool(_SECRET_WORDS.search(c.before))),
            float(bool(_PUBLIC_WORDS.search(c.before))), float(bool(_DIALLED.fullmatch(c.body))), float(bool(_KEY_SHAPE.fullmatch(c.body))),
            float(c.body.isdigit()), float(c.body.isdigit() and 13 <= len(c.body) <= 19 and luhn(c.body)),
            float(bool(words & GIVEN)), float(bool(words & FAMILY)), float(bool(words & PLACES) and not named), float(bool(_PERSON_NUMBER.fullmatch(c.body)))]


def other_kind(c: Candidate) -> str:
    """The kind of an accepted span that no base pattern has."""
    if _DIALLED.fullmatch(c.body):
        return "contact"
    words = _words(c.body) if not _SECRET_WORDS.search(c.before) or not _ASSIGNED.search(c.before) else set()
    return "name" if words & (GIVEN | FAMILY) else "place" if words & PLACES else "secret"


def estimate(counts: dict[str, int]) -> dict[str, float]:
    """Posterior of "personal" per vote pattern, by EM over the patterns' counts.

    Two classes; a labeler's rates of y, n and - per class are its reliability. They start
    from the share of yes among a pattern's votes and are smoothed by one vote each.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    codes = np.array([["y-n".index(c) for c in p] for p in patterns])
    yes, no = (codes == 0).sum(1), (codes == 2).sum(1)
    post = np.clip((yes + 0.5) / (yes + no + 1), 0.05, 0.95)
    for _ in range(EM_ROUNDS):
        mass = np.stack([(1 - post) * weight, post * weight])  # class, pattern
        prior = (mass.sum(1) + 1) / (mass.sum() + 2)
        score = np.log(prior)[:, None] * np.ones(len(patterns))
        for j in range(codes.shape[1]):
            rate = np.stack([mass[:, codes[:, j] == v].sum(1) for v in range(3)], 1) + 1
            score += np.log(rate / rate.sum(1, keepdims=True))[:, codes[:, j]]
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(patterns, post.tolist()))


def fit(rows: np.ndarray, target: np.ndarray, times: np.ndarray | None = None, rounds: int = 25) -> np.ndarray:
    """Logistic regression to soft targets of rows that occur ``times``: Newton steps with a small ridge."""
    w = np.zeros(rows.shape[1])
    times = np.ones(len(rows)) if times is None else times
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (times * (p - target)) + 0.1 * w
        hess = (rows * (times * (p * (1 - p) + 1e-6))[:, None]).T @ rows + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(spans: DataFrame, different: int, rows: int | None = None) -> pd.DataFrame:
    """The ``rows`` (TRAIN_ROWS) of least hash, or all: of the ``different`` rows only those below a share of the hashes are
    sorted, and the share is doubled until it holds enough."""
    rows = rows or TRAIN_ROWS
    share = min(1.0, 1.05 * rows / max(1, different))
    while True:
        some = (spans.where(F.col("hash") < int((1 << 32) * share)).orderBy("hash", "pattern", "features").limit(rows).toPandas())
        if share >= 1 or len(some) >= rows:
            return some
        share = min(1.0, 2 * share)


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Weights of the span classifier; ``docs`` is read once."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern, rows, order = [], [], []
            for t in batch.column(0).to_pylist():
                for c in candidates(t, base_spans(t)):
                    pattern.append(votes(c))
                    rows.append(features(c))
                    order.append(zlib.crc32(f"{c.before}|{c.body}|{c.start}".encode()))
            yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.string()), pa.array(rows, pa.list_(pa.float64())), pa.array(order, pa.int64())], names=["pattern", "features", "hash"])

    voted = stage(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
                  .mapInArrow(run, "pattern string, features array<double>, hash bigint"), "pii-votes")
    # equal spans are one row with their number
    spans = stage(voted.groupBy("hash", "pattern", "features").agg(F.count("*").alias("n")), "pii-spans")
    counts = spans.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("different")).toPandas()  # at most 3^labelers rows
    post = estimate(dict(zip(counts["pattern"], counts["n"].tolist())))
    some = sample(spans, int(counts["different"].sum()))
    if not len(some):
        return np.zeros(0)
    return fit(np.stack(some["features"].to_numpy()), some["pattern"].map(post).to_numpy(float), some["n"].to_numpy(float))


def spans_of(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans by kind and start)."""
    base = base_spans(text)
    more = []
    if len(weights):
        more = [(other_kind(c), c.start, c.end)
                for c in candidates(text, base) if c.kind is None and float(np.dot(features(c), weights)) > 0]
        more.sort(key=lambda s: (OTHERS.index(s[0]), s[1]))
    return base, base + more


def _join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, weights: np.ndarray, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, n_email, n_ip, n_card, n_phone, n_other, base (spans as text), spans."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["row_id"].dataType.simpleString()
    names = [f"n_{k}" for k in (*KINDS, "other")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(t.as_py(), weights) for t in batch.column(1)]
            counts = [pa.array([sum(k == s[0] for s in every) for _, every in found], pa.int64()) for k in KINDS]
            counts.append(pa.array([len(every) - len(base) for base, every in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([_join(b) for b, _ in found], pa.string()), pa.array([_join(e) for _, e in found], pa.string())],
                                             names=["row_id", *names, "base", "spans"])

    return rows.mapInArrow(run, f"row_id {kind}, {', '.join(n + ' bigint' for n in names)}, base string, spans string").withColumnRenamed("row_id", row_id)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap give one."""
    out, at, end = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = end = max(end, b)
    return "".join(out) + text[max(at, 0):]


def redact(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with the spans of the text masked."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else masked(t, spans_of(t, weights)[1]))

    return docs.withColumn(text, mask(text))
