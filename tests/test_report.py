import statistics
import tempfile
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from condensa.operators import event_log as EL
from condensa.operators import report as RP
from condensa.operators.selection import medians


EVENTS = [("r1", "read_document", "truncate", 100, 60, "large-text", "compressed", 0, "2024-03-01 10:00:00"),
          ("r2", "fetch_page", "skip", 10, 10, None, "no-change", 0, "2024-03-01 23:59:59"),
          ("r3", "fetch_page", "skip", 30, 30, None, "no-change", 1, "2024-03-02 00:00:00")]


def _events(spark, rows=EVENTS):
    ev = spark.createDataFrame(rows, "result_id string, tool string, strategy string, before long, after long, "
                                     "content_type string, action string, errors int, ts string")
    return ev.withColumns({"ts": F.to_timestamp("ts"), "reduction": F.lit("0%"), "tool_input": F.lit("")})


def _log():
    return tempfile.mkdtemp(prefix="condensa-log-", dir="/tmp")


def _ids(spark, path):
    return sorted(r["result_id"] for r in EL.read(spark, path).collect())


def test_event_log_takes_a_batch_once_and_keeps_days(spark):
    path = _log()
    assert EL.read(spark, path).count() == 0
    assert EL.append(_events(spark), path, "0", started=time.time() - 2)
    assert not EL.append(_events(spark), path, "0")  # a replayed batch changes nothing
    back = EL.read(spark, path)
    assert {str(r["day"]): r["count"] for r in back.groupBy("day").count().collect()} == {"2024-03-01": 2, "2024-03-02": 1}
    assert back.filter("duration_ms < 2000").count() == 0
    assert "PartitionFilters: [isnotnull(day" in back.filter("day = '2024-03-02'")._jdf.queryExecution().toString()


def test_event_log_reads_no_batch_that_the_ledger_has_not(spark):
    path = _log()
    EL.append(_events(spark), path, "0")
    EL._write(_events(spark), path)  # an attempt that was lost before its ledger row
    assert _ids(spark, path) == ["r1", "r2", "r3"]
    assert EL.append(_events(spark).limit(0), path, "1") and not EL.append(_events(spark), path, "1")
    assert _ids(spark, path) == ["r1", "r2", "r3"]


def test_event_log_merges_in_levels(spark):
    path = _log()
    for i in range(9):
        EL.append(_events(spark, [(f"r{i}", *EVENTS[0][1:])]), path, str(i), started=time.time() - i)
        EL.merge(spark, path, fan_in=2)
    before = {r["result_id"]: r["duration_ms"] for r in EL.read(spark, path).collect()}
    assert sorted(before) == [f"r{i}" for i in range(9)] and all(before[f"r{i}"] >= 1000 * i for i in range(9))
    assert sorted(r["level"] for r in EL.live(spark, path).collect()) == [0, 3]
    assert not EL.append(_events(spark), path, "3")  # known although merged
    assert EL.merge(spark, path, fan_in=2) == 0 and EL.replaced(spark, path).count() == 14


def test_reports_scan_the_log(spark):
    path = _log()
    EL.append(_events(spark), path, "0")
    rep = {(r["content_type"], r["is_total"]): r for r in RP.savings_report(EL.read(spark, path)).collect()}
    assert rep["large-text", 0]["reduction_pct"] == 40.0 and rep[None, 0]["errors"] == 1 and rep[None, 1]["events"] == 3
    assert all(r["avg_ms"] == r["median_ms"] >= 0 for r in rep.values())


@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.none() | st.integers(-2**40, 2**40) | st.integers(0, 3)), max_size=30))
@settings(max_examples=8, deadline=None)
def test_medians_are_exact(spark, rows):
    got = {r["k"]: r["median"] for r in medians(spark.createDataFrame(rows, "k string, v long"), ["k"], "v").collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: statistics.median(v) for k, v in groups.items()}


def test_reduction_text(spark):
    df = spark.createDataFrame([(1000, 66), (0, 0)], "b long, a long")
    got = [r[0] for r in df.select(F.expr(RP.reduction_text("b", "a"))).collect()]
    assert got == ["93.4%", None]


def test_previews_count_every_block(spark):
    rows = [("many", i, "text", "") for i in range(102)] + [("few", 0, "text", "x" * 400), ("few", 1, "text", None), ("few", 2, "image", "no")]
    got = {r["result_id"]: r["preview"] for r in RP.previews(spark.createDataFrame(rows, "result_id string, pos int, type string, text string")).collect()}
    assert len(got["many"]) == 503 and got["many"].endswith("...")
    assert got["few"].startswith("x" * 300) and len(got["few"]) == 305


def test_empty_responses_are_events(spark):
    rows = [("mcp__a__list", '{"path": "x", "n": 3}')]
    ev = RP.empty_events(spark.createDataFrame(rows, "tool_name string, args string")).first()
    assert (ev.tool, ev.action, ev.before, ev.tool_input) == ("list", "empty-response", 0, "path=x; n=3")
