import __spark_entry__ as entry


def test_registry_complete():
    qs, orc = entry.queries(), entry.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 50


def test_flagship_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    actions = {r["action"] for r in rows}
    assert "compressed" in actions
    for r in rows:
        if r["action"] == "compressed":
            assert r["summary"].startswith("[condensed: ")
            assert r["after"] <= r["before"] * 1.1 or r["rule_strategy"] != "auto"
