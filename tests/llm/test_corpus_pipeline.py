"""run() against the same stages computed plainly in Python and DuckDB, and the stages' edge cases."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from test_edges import SCHEMA, plain_groups, size_of, some_rows

import corpus_pipeline
from condensa.llm import pii, queries, sql
from condensa.llm.common import scratch_path

DIR = "/root/testdata/sf0.001"


def in_duckdb(rows, query):
    con = duckdb.connect()
    documents = pa.table({c: [r[c] for r in rows] for c in ("doc_id", "text", "lang", "source")},
                         schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())]))
    con.register("documents", documents)
    cur = con.execute(query)
    return [dict(zip([d[0] for d in cur.description], r)) for r in cur.fetchall()]


def plain_pipeline(rows):
    from tokenizers import Tokenizer

    kept = {r["doc_id"] for r in in_duckdb(rows, sql.OP2_QUALITY) if r["kept"]}
    rows = sorted((r for r in rows if r["doc_id"] in kept), key=lambda r: r["doc_id"])
    groups, _ = plain_groups([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    rows = [r for i, r in enumerate(rows) if groups[i] == i]  # the first of a group has the least id
    spans = [c for r in rows for c in pii.candidates(r["text"], pii.base_spans(r["text"]))]
    post = pii.estimate(collections.Counter(map(pii.votes, spans)))
    weights = pii.fit(np.array([pii.features(c) for c in spans]), np.array([post[pii.votes(c)] for c in spans])) if spans else np.zeros(0)
    rows = [r | {"text": pii.masked(r["text"], pii.spans_of(r["text"], weights)[1])} for r in rows]
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in in_duckdb(rows, sql.OP5_MIX)}
    out = []
    library = Tokenizer.from_file(queries.vocabulary_path())
    for r in rows:
        left, size = taken[r["doc_id"]]
        while left > 0:
            words = min(left, size)
            pieces = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r["text"])
            text = r["text"] if words == size else "".join(pieces[:words])
            left -= words
            ids = library.encode(text, add_special_tokens=False).ids
            out.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def test_run_equals_plain_computation(spark):
    rows = ds.dataset(f"{DIR}/documents.parquet").to_table().to_pylist()
    found = [(r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), r.decoded_sha256) for r in corpus_pipeline.run(spark, DIR).collect()]
    assert sorted(found) == plain_pipeline(rows)


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns; each stage keeps the columns."""
    docs = spark.createDataFrame([(*r, 0, "k") for r in some_rows()], SCHEMA + ", n_chars bigint, row_key string").repartition(2)
    path = scratch_path(spark, "odd")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    stages = dict(corpus_pipeline.STAGES)
    one = stages["one_of_near_copies"](spark, docs, "")
    assert one.columns == docs.columns
    # of the six long alike texts (a row twice repeated, capitals, one more word, no id) one stays; 4 short, 3 blank or null ones and the others stay
    ids = [r.doc_id for r in one.collect()]
    assert 5 in ids and not {6, 7, 8} & set(ids) and ids.count(5) == 1
    assert sum(size_of(r.text) == 0 for r in one.collect()) == sum(size_of(r[1]) == 0 for r in some_rows())
    for name in ("quality_rules", "mask_personal_data", "mix_sources"):
        assert stages[name](spark, docs, "").columns == docs.columns
    assert stages["encode"](spark, docs, "").count() == docs.count()
    empty = docs.where("false")
    for name in stages:
        assert stages[name](spark, empty, "").count() == 0
