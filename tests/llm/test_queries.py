"""The numbered queries on the small table against SQL or a direct computation."""

import collections
import hashlib
import os
import re
import sys
import zlib

import duckdb
import numpy as np
import pyarrow.dataset as ds
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from check_oracle import canon  # noqa: E402

from condensa.llm import queries  # noqa: E402
from condensa.llm.pii import luhn  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rows = ds.dataset(f"{DIR}/documents.parquet").to_table(["doc_id", "text"]).sort_by("doc_id").to_pydict()
    return dict(zip(rows["doc_id"], rows["text"]))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.vocabulary_path())


def rows(spark, name):
    return {r[0]: tuple(r[1:]) for r in queries.QUERIES[name](spark, DIR).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    found = queries.QUERIES[name](spark, DIR)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(found.columns)
    assert canon([tuple(r) for r in found.collect()], found.columns) == canon(cur.fetchall(), names)


def test_op1_rans(spark, texts, library):
    want, start = {}, 0
    for i, t in texts.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert rows(spark, "op1_rans") == want


def test_op6_token_counts(spark, texts, library):
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert {i: r[0] for i, r in rows(spark, "op6_token_counts").items()} == want


# The base patterns as the contract states them.
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits),
                    "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_op7_pii(spark, texts):
    found = rows(spark, "op7_pii")
    assert set(found) == set(texts)
    for i, t in texts.items():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(t))
        assert found[i][4] == hashlib.sha256(base.encode()).hexdigest()
        assert found[i][5].startswith(base)
        assert found[i][:4] == tuple(sum(s[0] == k for s in plain_base(t)) for k in BASE)


def test_op8_bpe(spark, texts, library):
    want = {}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert rows(spark, "op8_bpe") == want


def removed_plainly(texts, length=200):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    count = collections.Counter(b[p:p + length] for b in raw.values() for p in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                gone[p:p + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_op10_repeats(spark, texts):
    assert rows(spark, "op10_repeats") == removed_plainly(texts)


@pytest.mark.parametrize("name", ["op2_quality", "op3_licences", "op5_mix"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|InPandas|MapIn", plan)
