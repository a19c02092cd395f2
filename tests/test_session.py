import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from condensa.operators import session as SS


def test_recent_calls_bucketed_equals_window(spark):
    rows = [(s, i, f"t{i % 5}") for s in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "s string, seq long, tool string")
    got = SS.recent_calls(df, "s", "seq", ["tool"], n=3, bucket=16)
    w = Window.partitionBy("s").orderBy("seq").rowsBetween(-2, 0)
    want = df.withColumn("recent", F.collect_list(F.struct("tool")).over(w))
    a = {(r["s"], r["seq"], tuple(x["tool"] for x in r["recent"])) for r in got.collect()}
    b = {(r["s"], r["seq"], tuple(x["tool"] for x in r["recent"])) for r in want.collect()}
    assert a == b


def test_asof_match_equals_lag(spark):
    import random
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 2), rnd.randint(0, 3), i, rnd.choice(["request", "response"])) for i in range(500)]
    df = spark.createDataFrame(rows, "conn int, rid int, seq long, kind string")
    got = SS.match_responses(df, ["conn", "rid"], "seq", "kind", bucket=8)
    w = Window.partitionBy("conn", "rid").orderBy("seq")
    want = df.withColumn("prev_seq", F.lag("seq").over(w)).withColumn("prev_kind", F.lag("kind").over(w))
    cols = ["conn", "rid", "seq", "prev_seq", "prev_kind"]
    assert {tuple(r) for r in got.select(cols).collect()} == {tuple(r) for r in want.select(cols).collect()}


def test_recent_calls_over_gaps(spark):
    import random
    r = random.Random(8)
    rows = [(s, i, f"t{i % 7}") for s in "abc" for i in sorted(r.sample(range(5000), 60))]
    df = spark.createDataFrame(rows, "s string, seq long, tool string")
    for n in (1, 3, 10):
        got = SS.recent_calls(df, "s", "seq", ["tool"], n=n, bucket=16)
        w = Window.partitionBy("s").orderBy("seq").rowsBetween(-(n - 1), 0)
        want = df.withColumn("recent", F.collect_list(F.struct("tool")).over(w))
        assert {(x.s, x.seq, str(x.recent)) for x in got.collect()} == {(x.s, x.seq, str(x.recent)) for x in want.collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_stream_join_equals_batch_asof(spark, sf):
    import __spark_entry__ as entry
    q = entry.queries()
    batch = q["request_response_asof"](spark, f"/root/testdata/{sf}").selectExpr("conn", "rpc_id", "seq AS response_seq", "request_seq", "tool_name")
    stream = q["stream_correlate"](spark, f"/root/testdata/{sf}").where("kind = 'response'").select("conn", "rpc_id", "response_seq", "request_seq", "tool_name")
    assert stream.count() == batch.count()
    assert stream.exceptAll(batch).count() == batch.exceptAll(stream).count() == 0


def test_streams_over_files_in_reversed_time_order(spark, tmp_path):
    import datetime
    import os
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    import __spark_entry__ as entry
    r = random.Random(9)
    events = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=6 * i), i % 5 + 90 * (i in (0, 299)), r.choice(["click", "view"]), float(i), '{"k": %d}' % i)
              for i in range(300)]
    # lines of one key fall into different files, one of a pair at times
    parts = [sorted(r.sample(events[a:a + 110], 90)) for a in (0, 95, 190)]
    seen, folder = set(), tmp_path / "events.parquet"
    folder.mkdir()
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    for n, part in enumerate(parts):
        rows = [e for e in part if e[0] not in seen]
        seen |= {e[0] for e in rows}
        schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names=names), folder / f"part-{n}.parquet")
        os.utime(folder / f"part-{n}.parquet", (1_700_000_000 - 1000 * n,) * 2)  # the last in time is read first
    q = entry.queries()
    batch = q["request_response_asof"](spark, str(tmp_path)).select("conn", "rpc_id", F.col("seq").alias("response_seq"), "request_seq", "tool_name")
    stream = q["stream_correlate"](spark, str(tmp_path)).where("kind = 'response'").select(batch.columns)
    assert sorted(map(str, stream.collect())) == sorted(map(str, batch.collect()))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0)
    plain = spark.read.parquet(str(folder)).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool_name"),
                                                   F.array_join(F.collect_list("event_type").over(w), ",").alias("recent"), F.array_join(F.collect_list("props").over(w), "|").alias("recent_args"))
    found = q["stream_history"](spark, str(tmp_path)).select(plain.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


class _State:
    """Keeps what a stateful function puts by, as a stream would."""

    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_stream_state_does_not_grow():
    import random

    import pandas as pd

    from condensa.streaming import correlate as CO
    from condensa.streaming import history as HI
    r, ring, last = random.Random(4), _State(), _State()
    late = 0
    for n in range(1000):
        seqs = sorted({5 * n + r.randrange(5), *([r.randrange(5 * n + 1)] if n % 7 == 0 else [])})
        calls = pd.DataFrame([(s, f"t{s}", "{}") for s in seqs], columns=["seq", "tool_name", "args"])
        late += int(pd.concat(list(HI._update(("s",), iter([calls]), ring)))["late"].sum())
        assert len(ring.get[0]) == len(ring.get[1]) == len(ring.get[2]) <= 10
        lines = pd.DataFrame([(s, "request" if s % 2 else "response", "t", "{}", None, None, "x") for s in seqs],
                             columns=["seq", "kind", "tool_name", "tool_args", "result", "error", "line"])
        list(CO._match((1, "a"), iter([lines]), last))
        assert len(last.get) == 4
    assert late > 100


def test_late_calls_are_repaired(spark):
    """History rows of calls far out of order, settled, equal the plain window."""
    import random

    import pandas as pd

    from condensa.streaming import history as HI
    r, ring, rows = random.Random(5), _State(), []
    order = list(range(60))
    r.shuffle(order)
    for a in range(0, 60, 4):
        calls = pd.DataFrame([(s, f"t{s}", f"a{s}") for s in order[a:a + 4]], columns=["seq", "tool_name", "args"])
        rows += pd.concat(list(HI._update(("s",), iter([calls]), ring))).astype(object).where(lambda d: d.notna(), None).values.tolist()
    found = HI.settled(spark.createDataFrame(rows, HI.OUT_SCHEMA)).orderBy("seq").collect()
    assert [(x.seq, x.recent, x.recent_args) for x in found] == [
        (s, ",".join(f"t{i}" for i in range(max(0, s - 2), s + 1)), [f"a{i}" for i in range(max(0, s - 2), s + 1)]) for s in range(60)]
