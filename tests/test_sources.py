"""Sources and response normalisation on own inputs."""

import json

from condensa.operators import normalise as N
from condensa.sources import toolcalls as TC
from condensa.streaming import lines as LI


def test_hook_events_are_read_twice(spark, tmp_path):
    good = json.dumps({"session_id": "s", "tool_name": "mcp__a__b", "tool_input": {"x": 1}, "tool_response": [1, 2]})
    (tmp_path / "calls.jsonl").write_text(good + "\n\n{broken\n")
    for _ in range(2):
        got = sorted((r.status, r.tool_name) for r in TC.read_hook_events(spark, f"file://{tmp_path}").collect())
        assert [x[0] for x in got] == ["corrupt", "empty", "ok"] and got[2][1] == "mcp__a__b"


def test_images_have_plain_base64(spark, tmp_path):
    (tmp_path / "p.jpeg").write_bytes(bytes(range(256)) * 4)
    row = TC.read_images(spark, f"file://{tmp_path}").first()
    assert "\n" not in row.data and "\r" not in row.data and row.mime_type == "image/jpeg" and len(row.data) == 1368


def test_normalise_keeps_the_text(spark):
    rows = [(1, '{"z": 1.5, "a": {"y": "two  words", "b": [ ]}}'), (2, '[{"z": 1, "a": 2}, "a \\" b"]'), (3, '""'), (4, "[]"), (5, "null"), (6, '"hi"'),
            (7, '{"content": []}'), (8, "7"), (9, '{"type": "text", "text": "t"}')]
    df = spark.createDataFrame([(i, None, r) for i, r in rows], "id int, other string, resp string")
    got = {r.id: r.text for r in N.normalise(df, "resp").collect()}
    assert got == {1: '{"z":1.5,"a":{"y":"two  words","b":[]}}', 2: '[{"z":1,"a":2},"a \\" b"]', 6: "hi", 9: "t"}
    assert sorted(r.id for r in N.empty_responses(df, "resp").collect()) == [3, 4, 5, 8]


def test_normalise_of_repeated_keys(spark):
    """Valid JSON with a repeated key is no empty response; the last value counts."""
    rows = [(1, '{"content": [], "content": [{"type": "text", "text": "kept"}]}'), (2, '{"a": 1, "a": 2}'), (3, '[{"type": "text", "text": "old", "text": "new"}]')]
    df = spark.createDataFrame(rows, "id int, resp string")
    assert {r.id: r.text for r in N.normalise(df, "resp").collect()} == {1: "kept", 2: '{"a":1,"a":2}', 3: "new"}
    assert N.empty_responses(df, "resp").count() == 0


def test_normalise_of_repeated_keys(spark):
    """Valid JSON with a repeated key is no empty response; the last value counts."""
    rows = [(1, '{"content": [], "content": [{"type": "text", "text": "kept"}]}'), (2, '{"a": 1, "b": 0, "a": 2}'), (3, '[{"type": "text", "text": "old", "text": "new"}]')]
    df = spark.createDataFrame(rows, "id int, resp string")
    assert {r.id: r.text for r in N.normalise(df, "resp").collect()} == {1: "kept", 2: '{"a":2,"b":0}', 3: "new"}
    assert N.empty_responses(df, "resp").count() == 0


def test_lines_stream_splits_and_counts(spark, tmp_path):
    call = '{"id": 1, "method": "tools/call", "params": {"name": "list", "arguments": {"q": 1}}}'
    lines = [f"  {call} ", "", "   ", '{"id": 1, "result": {"content": []}}', "  {broken ", "[1, 2]", '{"method": "note"}', '{"id": 2, "params": "x", "error": 5}']
    for conn, part in ((1, lines[:4]), (2, lines[4:])):
        (tmp_path / f"in/conn={conn}").mkdir(parents=True)
        (tmp_path / f"in/conn={conn}/a.txt").write_text("\n".join(part) + "\n")
    out = f"file://{tmp_path}/out"
    for _ in range(2):  # a second run finds nothing new
        q = LI.write(LI.messages(LI.line_stream(spark, f"file://{tmp_path}/in", "conn bigint")), "kind", out, f"file://{tmp_path}/ckpt")
        q.awaitTermination()
        got = spark.read.parquet(out)
        assert sorted((r.conn, r.kind, r.line) for r in got.collect()) == sorted([
            (1, "request", call), (1, "response", lines[3]), (2, "raw", "  {broken "), (2, "other", "[1, 2]"),
            (2, "other", lines[6]), (2, "response", lines[7])])
        if not _:
            assert LI.counters(q) == {"lines": 8, "empty": 2, "corrupt": 1}
    assert [r.tool_args for r in got.filter("kind = 'request'").collect()] == ['{"q":1}']


def test_hook_stream_keeps_corrupt_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"tool_name": "mcp__a__b", "tool_input": {"x": 1}}\n\n{broken\n')
    q = LI.write(LI.hook_events(LI.line_stream(spark, f"file://{tmp_path}/in")), "status", f"file://{tmp_path}/out", f"file://{tmp_path}/ckpt")
    q.awaitTermination()
    got = sorted((r.status, r.line, r.tool_name) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got[0] == ("corrupt", "{broken", None) and got[1][0] == "ok" and got[1][2] == "mcp__a__b" and len(got) == 2
    assert LI.counters(q) == {"lines": 3, "empty": 1, "corrupt": 1}
