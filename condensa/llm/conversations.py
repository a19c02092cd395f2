"""Conversation structure repair with a suffix-shared automaton.

A conversation's turns become a signature, one symbol a row: the role (system, user, assistant, other, by
its initial) and the row's first fault:

* blank: no character but separators; duplicate: role and text seen earlier; truncated: the last character
  that is no separator does not end a sentence.

The cheapest edits make the role initials match (s?(ua)+)?: Keep costs 0, Rerole (to user or assistant) 2, Delete 3,
Insert (an empty user or assistant row, anywhere) 2. Blank and duplicate rows must be deleted, a truncated row that
is not adds 1. Of equal costs the least audit string (initials of the edits, in order) wins.

Signatures are read from their end: a node of the automaton is a suffix, shared by all signatures that end
in it. Node by node, shorter suffixes first, the cost-to-go and the least audit are computed for each
state of the grammar from those of the next node: once for all conversations. The four states are:
start, after s, after u, after ua.

Signatures are cut into pieces of PIECE rows, counted from the end, so that the automaton's depth has a
bound and a long conversation is no group of one task. The last piece has costs to the end of the
conversation, other pieces have costs to each state in which the next one may begin; these tables are
joined as matrices (least cost, then least audit), BRANCH pieces at a time.

Rows are taken by turn (nulls first), equal turns by role, then by the text's digest. A repaired
conversation is hashed in one pass over its rows, sorted and streamed: a digest of one sequence cannot be
split, but its task holds no more than a batch of rows and the conversation's audit.

Null conv_id is a conversation of its own; null roles and texts are read as one space. Equal rows of one turn
are duplicates but for the first. An empty table gives no rows; extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.shipping import ship

from .common import SPACE_CLASS, join_small, null_key, partitions, prefix_scan, stage

PIECE = 16
BRANCH = 32
#: Costs beyond this mean that a state cannot be reached.
FAR = 1 << 40
#: Grammar states, and what an inserted row leads to: start -> u, s -> u, u -> ua, ua -> u.
START, SYSTEM, USER, PAIR = range(4)
_NEXT = (USER, USER, PAIR, USER)
#: Symbols: role class (sua or other) times fault (none, truncated, blank, duplicate).
ROLES, FAULTS = "suao", ("none", "truncated", "blank", "duplicate")


def damaged(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``chats`` with faults: by crc32("conv_id:turn") % 20 a row is dropped (0), emptied (1),
    loses its [.!?] (2), is there twice (3) or gets role user (4). Nulls are read as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = chats.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _least(options: list[str]) -> str:
    return f"least({', '.join(options)})" if len(options) > 1 else options[0]


def _entry(cost: str, audit: str) -> str:
    return f"named_struct('cost', cast({cost} as bigint), 'audit', {audit})"


def _with_inserts(row) -> str:
    """The table of a node from its entries without a leading insert: ``row(q)`` is the SQL of state q's entries.

    An insert leads to a state whose own first edit may be an insert; two in a row are enough, since a third
    leads back to a state that has been left."""
    def after(q: int, depth: int) -> str:
        here = [f"element_at({row(q)}, e)"]
        if depth:
            there = after(_NEXT[q], depth - 1)
            here.append(f"element_at(transform(array({there}), t -> {_entry('t.cost + 2', chr(39) + 'I' + chr(39) + ' || t.audit')}), 1)")
        return _least(here)

    return "array(" + ", ".join(f"transform(sequence(1, size({row(q)})), e -> {after(q, 2)})" for q in range(4)) + ")"


#: SQL of the empty suffix: costs to the end of the conversation, and to each state.
_UNREACHED = _entry(str(FAR), "''")
_END = _with_inserts(lambda q: f"array({_entry('0', chr(39) * 2) if q in (START, PAIR) else _UNREACHED})")
_ANY = "array(" + ", ".join("array(" + ", ".join(_entry("0", "''") if e == q else _UNREACHED for e in range(4)) + ")" for q in range(4)) + ")"


def _step() -> str:
    """SQL of a node's table from its first symbol (``symbol``: 4 * role + fault) and the next node's (``next``)."""
    def edit(letter: str, cost: str, state: int) -> str:
        return f"transform(next[{state}], t -> {_entry(f't.cost + {cost}', f'{chr(39)}{letter}{chr(39)} || t.audit')})"

    def state(q: int) -> str:
        # own role kept: s at the start, u but after u, a after u
        keep = {START: [(0, SYSTEM), (1, USER)], SYSTEM: [(1, USER)], USER: [(2, PAIR)], PAIR: [(1, USER)]}[q]
        drop, rerole = edit("D", "3", q), edit("R", "2 + symbol % 4", _NEXT[q])
        best = f"zip_with({drop}, {rerole}, (x, y) -> least(x, y))"
        kept = " ".join(f"when symbol div 4 = {role} then zip_with({best}, {edit('K', 'symbol % 4', to)}, (x, y) -> least(x, y))" for role, to in keep)
        return f"case when symbol % 4 >= 2 then {drop} {kept} else {best} end"

    rows = "array(" + ", ".join(state(q) for q in range(4)) + ")"
    return f"element_at(transform(array({rows}), plain -> {_with_inserts(lambda q: f'plain[{q}]')}), 1)"


def suffix_tables(signatures: DataFrame) -> DataFrame:
    """signature, last, value: the table of every signature (each pair of them once). ``last``: costs to the end.

    The nodes of one length are computed in one job from those of the length below."""
    wanted = signatures.select("signature", "last").distinct()
    nodes = wanted.select("last", F.explode(F.expr("transform(sequence(1, length(signature)), n -> right(signature, n))")).alias("suffix")).distinct()
    nodes = stage(nodes.withColumn("n", F.length("suffix")), "conversation-nodes")
    depth = nodes.agg(F.max("n")).first()[0] or 0
    below, done = None, []
    for n in range(1, depth + 1):
        here = nodes.where(F.col("n") == n).select("last", "suffix", F.conv(F.substring("suffix", 1, 1), 16, 10).cast("int").alias("symbol"), F.expr("substring(suffix, 2)").alias("rest"))
        if below is None:
            found = here.withColumn("next", F.expr(f"case when last then {_END} else {_ANY} end"))
        else:
            found = here.join(below.select("last", F.col("suffix").alias("rest"), F.col("value").alias("next")), ["last", "rest"])
        below = stage(found.select("last", "suffix", F.expr(_step()).alias("value")), "conversation-tables")
        done.append(below.select(F.col("suffix").alias("signature"), "last", "value"))
    out = done[0] if done else nodes.select(F.col("suffix").alias("signature"), "last", F.expr(_ANY).alias("value"))
    for more in done[1:]:
        out = out.union(more)
    return out


_JOINED = ("transform(sequence(0, 3), q -> transform(sequence(0, size(acc[0]) - 1), e -> array_min(transform(sequence(0, 3), s -> "
           + _entry("m[q][s].cost + acc[s][e].cost", "m[q][s].audit || acc[s][e].audit") + "))))")


def _whole(pieces: DataFrame) -> DataFrame:
    """conv, cost, audit from conv, piece (0 the last), value."""
    alone = pieces.where("pieces = 1").select("conv", "value")
    more = pieces.where("pieces > 1").select("conv", "piece", "value", "pieces")
    most = more.agg(F.max("pieces")).first()[0] or 0
    while most > 1:
        # from the last piece of a run to its first: each is put before what follows it
        folded = F.expr(f"aggregate(slice(sorted, 2, size(sorted)), sorted[0].value, (acc, p) -> element_at(transform(array(p.value), m -> {_JOINED}), 1))")
        more = (more.groupBy("conv", F.floor(F.col("piece") / BRANCH).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("piece", "value"))).alias("sorted"))
                .select("conv", "piece", folded.alias("value")))
        more, most = stage(more, "conversation-runs"), -(-most // BRANCH)
    return alone.union(more.select("conv", "value")).select("conv", F.expr(f"value[{START}][0].cost").alias("cost"), F.expr(f"value[{START}][0].audit").alias("audit"))


def _digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, repaired_sha256: the rows that the audit leaves, as role:text, joined by newlines."""
    ship(rows.sparkSession)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # conversation, audit, place in it, state, digest, whether a row was written

        def write(now: list, role: str, text: str) -> None:
            now[4].update((b"\n" if now[5] else b"") + role.encode("utf-8", "surrogatepass") + b":" + text.encode("utf-8", "surrogatepass"))
            now[5] = True

        def advance(now: list, role: str | None = None) -> None:
            now[3] = _NEXT[now[3]] if role is None else SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else PAIR

        def inserts(now: list) -> None:
            while now[1][now[2]:now[2] + 1] == "I":
                advance(now)
                write(now, "user" if now[3] == USER else "assistant", "")
                now[2] += 1

        for batch in batches:
            out = []
            for conv, audit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if audit is not None:
                    if now:
                        inserts(now)
                        out.append((now[0], now[4].hexdigest()))
                    now = [conv, audit, 0, START, hashlib.sha256(), False]
                    continue
                inserts(now)
                edit = now[1][now[2]]
                now[2] += 1
                if edit == "K":
                    advance(now, role)
                    write(now, role, text)
                elif edit == "R":
                    advance(now)
                    write(now, "user" if now[3] == USER else "assistant", text)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=["conv", "repaired_sha256"])
        if now:
            inserts(now)
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[4].hexdigest()])], names=["conv", "repaired_sha256"])

    heads = audits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    body = rows.select(null_key(F.col("conv_id")).alias("conv"), F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    both = heads.union(body).repartition(partitions(rows.sparkSession), "conv").withColumn("digest", F.sha2("text", 256))
    return both.sortWithinPartitions("conv", "kind", "turn", "role", "digest").select("conv", "audit", "role", "text").mapInArrow(streamed, "conv string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of
    ``rows`` (conv_id, turn, role, text).

    gaps: turn numbers missing between the least and the greatest; illegal: adjacent rows whose role initials are
    not su, ua or au."""
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    words = f"[^{SPACE_CLASS}]"
    fault = F.when(~F.col("text").rlike(words), 2).when(~F.col("text").rlike(rf"[.!?][{SPACE_CLASS}]*\z"), 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = rows.select(null_key(F.col("conv_id")).alias("conv"), "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), kind.alias("kind"), fault.alias("fault"))
    # equal rows of a turn are counted, the rest is about rows that differ
    lines = stage(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("copies")), "conversation-lines")
    first = lines.groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    placed = prefix_scan(lines, [F.col("conv"), F.col("turn"), F.col("role"), F.col("digest")], {"at": F.col("copies")}, "conversation-order")
    ended = placed.groupBy("conv").agg(F.max("at").alias("end"))
    placed = placed.join(ended, "conv").join(first, ["conv", "role", "digest"])
    copy = F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy")
    # after: rows of the conversation that follow
    seen = (F.col("copy") > 0) | ~F.col("turn").eqNullSafe(F.col("first.turn"))
    each = placed.select("conv", "kind", "fault", "turn", "first", "copies", "end", "at", copy).select(
        "conv", (F.col("end") - F.col("at") + F.col("copies") - 1 - F.col("copy")).alias("after"),
        F.lower(F.hex(F.col("kind") * 4 + F.when((F.col("fault") != 2) & seen, 3).otherwise(F.col("fault")))).alias("symbol"))
    # the row before a piece comes along for the pair that they make
    own, before = F.floor(F.col("after") / PIECE), F.col("after") / PIECE - 1
    to = F.explode(F.when((F.col("after") % PIECE == 0) & (F.col("after") > 0), F.array(own, before.cast("bigint"))).otherwise(F.array(own))).alias("piece")
    pieces = (each.select("conv", "after", "symbol", to).groupBy("conv", "piece")
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("after", "symbol")), asc=False), lambda r: r["symbol"]), "").alias("read"))
              .withColumn("signature", F.when(F.length("read") > PIECE, F.expr("substring(read, 2)")).otherwise(F.col("read"))).withColumn("last", F.col("piece") == 0))
    pieces = stage(pieces, "conversation-pieces")
    tables = suffix_tables(pieces)
    counts = pieces.groupBy("conv").agg(F.count("*").alias("pieces"))
    valued = join_small(pieces.select("conv", "piece", "last", "signature"), tables, ["last", "signature"], F.col("conv")).join(counts, "conv").select("conv", "piece", "pieces", "value")
    found = stage(_whole(stage(valued, "conversation-values")), "conversation-audits")

    def of_fault(n: int) -> str:
        return f"cast(sum(length(signature) - length(translate(signature, '{''.join(f'{4 * r + n:x}' for r in range(4))}', ''))) as bigint)"

    pair = "concat(substring('sua?', 1 + cast(conv(substring(read, i, 1), 16, 10) as int) div 4, 1), substring('sua?', 1 + cast(conv(substring(read, i + 1, 1), 16, 10) as int) div 4, 1))"
    illegal = f"cast(sum(case when length(read) < 2 then 0 else size(filter(sequence(1, length(read) - 1), i -> {pair} not in ('su', 'ua', 'au'))) end) as bigint)"
    faults = pieces.groupBy("conv").agg(*[F.expr(of_fault(n)).alias(name) for n, name in ((2, "blank"), (3, "duplicate"), (1, "truncated"))], F.expr(illegal).alias("illegal"))
    turns = lines.groupBy("conv", "conv_id", "turn").count().groupBy("conv", "conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    out = turns.join(faults, "conv").join(found, "conv").join(_digests(rows, found), "conv")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
