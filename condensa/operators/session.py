"""Per-session call history (W1, W2, J3) and request/response correlation.

Both are ordered look-backs inside a key (a session, a connection + request id). A key
may be very hot, so neither puts a whole key into one window partition:

* recent calls: rows are windowed per (session, seq bucket). The last few rows of each bucket
  are kept as its tail; a bucket's context is taken from the tails of the buckets before
  it that have rows, however far back they are, so gaps in ``seq`` do no harm.
* as-of match: the previous event of a key is found inside its (key, seq bucket) first;
  only the first event of a bucket needs the last event of an earlier bucket, taken from
  a per-bucket aggregate (one row per bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as E
from ..functions import keywords as K

SEQ_BUCKET = 4096


def recent_calls(calls: DataFrame, session: str, seq: str, value_cols: list[str], n: int = C.RECENT_CALLS,
                 out_col: str = "recent", bucket: int = SEQ_BUCKET) -> DataFrame:
    """Adds ``out_col``: ARRAY<STRUCT<value_cols>> of the last ``n`` calls of the session up
    to and including this one, oldest first. ``seq`` orders a session's calls; gaps are allowed."""
    one = F.struct(*value_cols)
    own = calls.withColumn("_b", F.floor(F.col(seq) / bucket))
    in_bucket = Window.partitionBy(session, "_b").orderBy(seq)
    own = own.withColumn("_own", F.collect_list(one).over(in_bucket.rowsBetween(-(n - 1), 0)))
    # the list of a bucket's last row is its tail: every bucket here has a row, so n - 1 of them reach n - 1 calls back
    tails = own.groupBy(session, "_b").agg(F.max_by("_own", seq).alias("_tail"))
    earlier = Window.partitionBy(session).orderBy("_b").rowsBetween(-(n - 1), -1)
    context = tails.select(F.col(session), "_b", F.flatten(F.collect_list("_tail").over(earlier)).alias("_ctx"))
    joined = own.join(context, [session, "_b"])
    missing = f"({n} - size(_own))"
    recent = f"IF({missing} <= 0, _own, concat(slice(_ctx, greatest(size(_ctx) - {missing} + 1, 1), {missing}), _own))"
    return joined.withColumn(out_col, F.expr(recent)).select(*calls.columns, out_col)


def session_query(calls: DataFrame, tool_col: str = "tool_name", args_col: str = "args",
                  recent_col: str = "recent") -> DataFrame:
    """Synthetic query with intent inherited from the last two recent calls (the
    predecessor and the call itself; its own arguments therefore count twice)."""
    inherited = (f"flatten(transform(slice({recent_col}, greatest(size({recent_col}) - {C.INHERITED_CALLS} + 1, 1), "
                 f"{C.INHERITED_CALLS}), c -> coalesce({K.arg_keywords('c.args')}, array())))")
    parts = f"concat(array(translate({tool_col}, '_-', '  ')), {K.arg_keywords(args_col)}, {inherited})"
    return calls.withColumn("query", F.expr(E.js_trim(f"array_join({parts}, ' ')")))


def match_responses(events: DataFrame, key_cols: list[str], seq: str, kind_col: str,
                    bucket: int = SEQ_BUCKET, carry: tuple[str, ...] = ()) -> DataFrame:
    """For every event: the previous event of its key (prev_seq, prev_kind, prev_<each of carry>), found per bucket.

    ``kind_col`` is 'request' or 'response'. A response is matched when the previous
    event of its key is a request: a later request with the same key overwrites an
    earlier one, and a request is consumed by the first response after it.
    """
    kept = {"seq": seq, "kind": kind_col} | {c: c for c in carry}
    events = events.withColumn("_b", F.floor(F.col(seq) / bucket)).withColumn(
        "_this", F.struct(*[F.col(c).alias(f"prev_{name}") for name, c in kept.items()]))
    ev = events.withColumn("_prev", F.lag("_this").over(Window.partitionBy(*key_cols, "_b").orderBy(seq)))
    last = events.groupBy(*key_cols, "_b").agg(F.max_by("_this", seq).alias("_last"))
    before = last.select(*key_cols, "_b", F.lag("_last").over(Window.partitionBy(*key_cols).orderBy("_b")).alias("_carry"))
    return (ev.join(before, [*key_cols, "_b"], "left")
            .withColumn("_prev", F.coalesce("_prev", "_carry"))
            .select(*[c for c in events.columns if c not in ("_b", "_this")], "_prev.*"))
