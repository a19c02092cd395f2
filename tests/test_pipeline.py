import json

from condensa.config import Config
from condensa.operators import results as RS

COLS = "result_id string, source string, pos int, tool_name string, args string, type string, text string, data string, mime_type string"


def _run(spark, blocks, cfg=Config()):
    df = spark.createDataFrame(blocks, COLS)
    summary, reduced = RS.reduce_results(df, cfg)
    s = {r["result_id"]: r for r in summary.collect()}
    out = {}
    for r in RS.final_blocks(reduced, summary).collect():
        out.setdefault(r["result_id"], []).append((r["pos"], r["type"], r["text"]))
    return s, {k: sorted(v) for k, v in out.items()}


RECORDS = json.dumps([{"id": i, "name": f"User {i}", "email": f"user{i}@example.com", "bio": "Loves data " * 3}
                      for i in range(500)])


def test_pipeline_cases(spark):
    lines = "\n".join(" ".join(f"word{j}" for j in range(25)) for _ in range(1000))
    blocks = [
        ("small", "t", 0, "mcp__s__tool", "{}", "text", "small output", None, None),
        ("lines", "t", 0, "mcp__s__tool", "{}", "text", lines, None, None),
        ("img", "t", 0, "mcp__s__generate_image", "{}", "image", None, "x" * 5000, "image/png"),
        ("json", "t", 0, "mcp__db__query", "{}", "text", RECORDS, None, None),
    ]
    s, out = _run(spark, blocks)
    assert s["small"]["action"] == "no-change" and out["small"] == [(0, "text", "small output")]
    assert s["lines"]["action"] == "no-change"
    assert s["img"]["action"] == "no-change" and out["img"][0][1] == "image"
    assert s["json"]["action"] == "compressed"
    assert out["json"][0][0] == -1 and out["json"][0][2].startswith("[condensed: ")
    assert "large-json: 1 block" in out["json"][0][2]
    assert "| id | name | email | bio |" in out["json"][1][2]
    assert s["json"]["dominant_type"] == "large-json"


def test_json_flag_off_and_dry_run(spark):
    blocks = [("json", "t", 0, "mcp__db__query", "{}", "text", RECORDS, None, None)]
    s, out = _run(spark, blocks, Config(json_collapse=False))
    assert s["json"]["action"] == "no-change" and out["json"] == [(0, "text", RECORDS)]
    s, out = _run(spark, blocks, Config(dry_run=True))
    assert s["json"]["action"] == "no-change" and out["json"] == [(0, "text", RECORDS)]


def test_materialised_blocks_are_read_by_every_branch(spark):
    """The blocks come from files for the flags and the reducers: the input is read once, before the branches."""
    text = "A sentence about a topic that goes on. " * 900
    rows = [("r1", 0, "t", text), ("r1", 1, "t", '[{"a": 1, "b": 2}]'), ("r2", 0, "t", "small"),
            ("r3", 0, "t", "[" + ", ".join('{"a": %d, "b": "x"}' % i for i in range(400)) + "]"), (None, 0, "t", text)]
    df = spark.createDataFrame(rows, "result_id string, pos int, tool_name string, text string").selectExpr(
        "result_id", "'s' AS source", "pos", "tool_name", "'{}' AS args", "'text' AS type", "text",
        "CAST(NULL AS STRING) AS data", "CAST(NULL AS STRING) AS mime_type")
    lazy, _ = RS.reduce_results(df, Config())
    written, reduced = RS.reduce_results(df, Config(), materialize=True)
    key = lambda r: str(r)
    assert sorted(map(key, written.collect())) == sorted(map(key, lazy.collect()))
    assert reduced.inputFiles() and all("/routed-blocks/" in f for f in reduced.inputFiles())
    assert "ExistingRDD" not in reduced._jdf.queryExecution().executedPlan().toString()


def test_stream_batch_holds_several_files(spark, tmp_path, monkeypatch):
    """A batch costs the same jobs for any size, so files come several at a time; all rows are in the log once."""
    from condensa.plans import q_stream
    from condensa.streaming import continuous
    docs = [(i, f"Some text number {i}. " * (400 * (i % 2) + 1), "en", "web", 20) for i in range(12)]
    (spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
     .repartition(4).write.parquet(str(tmp_path / "documents.parquet")))
    batches, append = [], continuous.EL.append
    monkeypatch.setattr(continuous.EL, "append", lambda ev, root, batch, *a: batches.append(batch) or append(ev, root, batch, *a))
    out = q_stream.stream_reduce(spark, str(tmp_path))
    assert sorted(r.result_id for r in out.collect()) == sorted(f"doc:{i}" for i in range(12))
    assert len(batches) == 1
