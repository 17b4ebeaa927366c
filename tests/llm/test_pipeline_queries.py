"""The registered corpus queries on the driver's smallest tables, and the pipeline step by step."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as registered
import corpus_pipeline
from tests.llm.samples import found
from tests.llm.test_dedup import brute_components, brute_lines
from tests.llm.test_scans import base_spans
from wayfare.llm import packing, quality_model, queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


def test_all_operators_are_registered():
    numbers = {int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()}
    assert numbers == set(range(1, 14))
    assert {*queries.queries(), "pipeline"} <= set(registered.queries())


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    out = queries.queries()[name](spark, FOLDER)
    assert found(out.select(*sorted(out.columns))) == sorted(
        con.sql(queries.oracle_sql()[name]).select(*sorted(out.columns)).fetchall(), key=repr
    )


def test_near_groups_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op4_near_dedup(spark, FOLDER).collect()}
    assert got == {d: (n, c) for d, n, c in brute_components(rows)}


def test_pipeline_step_by_step(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    seen = [docs.collect()]
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or docs.columns == names
        seen.append(docs.collect())
    raw, good, lines, unique, masked, packed = seen

    network = quality_model.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = {r["doc_id"]: network.scores([quality_model.passages(r["text"])])[0] for r in raw}
    assert {r["doc_id"] for r in good} == {d for d, s in scores.items() if s >= 0.5}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = [scores[d] >= 0.5 for d, q in labels.items() if q == 1]
    assert sum(clean) >= 0.95 * len(clean)  # of a network trained on some fifty texts

    expected = brute_lines([(r["doc_id"], r["text"], r["source"]) for r in good])
    assert found(spark.createDataFrame([(r["doc_id"], r["text"].count("\n") + 1 if r["text"] else 1) for r in lines])) == sorted(
        ((d, max(1, n - gone)) for d, n, gone, _, _ in expected), key=repr
    )
    groups = brute_components([(r["doc_id"], r["text"]) for r in lines])
    assert {r["doc_id"] for r in unique} == {d for d, _, c in groups if d == c}

    texts = {r["doc_id"]: r["text"] for r in unique}
    assert {r["doc_id"] for r in masked} == set(texts)
    for r in masked:
        assert base_spans(r["text"]) == "" and (r["text"] == texts[r["doc_id"]] or "[secret]" in r["text"])
    assert sum(r["length"] for r in packed) == sum(len(r["text"].encode()) + 1 for r in masked)
    assert max(r["capacity"] for r in packed) <= max(packing.LENGTHS)
