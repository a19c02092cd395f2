"""M2: keyed call history as streaming state (each call with the most recent calls of its session).

The state of a session is a ring: its last HISTORY_SIZE calls, whatever the session's age. A call that comes
after later ones is put in its place there, and those that it precedes are told again. A call from before
the ring is told as late, without its recent calls, and ``settled`` repairs its session in batch: no call is lost,
and files in any order give the batch result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config as C
from ..operators.session import recent_calls

OUT_SCHEMA = "session STRING, seq BIGINT, tool_name STRING, args STRING, recent STRING, recent_args ARRAY<STRING>, late BOOLEAN, version BIGINT"
STATE_SCHEMA = "seqs ARRAY<BIGINT>, tools ARRAY<STRING>, args ARRAY<STRING>, full BOOLEAN, version BIGINT"
COLUMNS = [c.split()[0] for c in OUT_SCHEMA.split(", ")]


def _update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    come = pd.concat(list(batches)).sort_values("seq")  # all Arrow batches of the micro-batch, in order
    *columns, full, version = state.get if state.exists else ([], [], [], False, 0)
    ring, version = sorted(zip(*columns)), int(version) + 1
    new = list(zip(map(int, come["seq"].tolist()), come["tool_name"].tolist(), come["args"].tolist()))
    # calls that have left the ring may lie between its first ones and a call from before them
    first = ring[C.RECENT_CALLS - 2][0] if full else None
    late = [c for c in new if full and c[0] < first]
    calls = sorted(ring + [c for c in new if not full or c[0] >= first], key=lambda c: c[0])
    seqs, tools, args = ([c[i] for c in calls] for i in range(3))
    # the calls that came, and those after them that have one among their recent calls
    told = sorted({j for c in new if not full or c[0] >= first for i in [bisect_left(seqs, c[0])] for j in range(i, min(i + C.RECENT_CALLS, len(seqs)))})
    rows = [(key[0], int(seqs[j]), tools[j], args[j], ",".join(tools[max(0, j + 1 - C.RECENT_CALLS):j + 1]), args[max(0, j + 1 - C.RECENT_CALLS):j + 1], False, version) for j in told]
    rows += [(key[0], c[0], c[1], c[2], None, None, True, version) for c in late]
    kept = calls[-C.HISTORY_SIZE:]
    state.update(([int(c[0]) for c in kept], [c[1] for c in kept], [c[2] for c in kept], bool(full or len(calls) > C.HISTORY_SIZE), version))
    yield pd.DataFrame(rows, columns=COLUMNS)


def call_history(calls: DataFrame, session_col: str = "session") -> DataFrame:
    """calls: stream of (session, seq, tool_name[, args]), ``seq`` once per session → each call with its 3 most recent tools and their arguments.

    A call is told again with a greater ``version`` when one comes that belongs before it; ``late`` calls
    have no recent calls yet. ``settled`` takes the last word on each and repairs sessions with late calls.
    """
    if "args" not in calls.columns:
        calls = calls.withColumn("args", F.lit(None).cast("string"))
    return calls.groupBy(session_col).applyInPandasWithState(_update, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def settled(rows: DataFrame) -> DataFrame:
    """The written rows of ``call_history`` with every call once: as last told, or, in a session with late calls,
    with the recent calls that the batch window gives."""
    late = rows.filter("late").select("session").distinct()
    last = rows.join(late, "session", "left_anti").groupBy("session", "seq").agg(F.max_by(F.struct("tool_name", "recent", "recent_args"), "version").alias("c"))
    calls = rows.join(late, "session", "left_semi").groupBy("session", "seq").agg(F.first("tool_name").alias("tool_name"), F.first("args").alias("args"))
    redone = recent_calls(calls, "session", "seq", ["tool_name", "args"], out_col="_recent")
    return last.select("session", "seq", "c.*").unionByName(redone.select(
        "session", "seq", "tool_name", F.expr("array_join(transform(_recent, c -> c.tool_name), ',')").alias("recent"), F.expr("transform(_recent, c -> c.args)").alias("recent_args")))
