"""The numbered queries: against DuckDB where there is SQL, else against plain versions; and the pipeline."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from foliospark.llm.queries import QUERIES
from foliospark.llm.sql import ORACLES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, duck, name):
    df, expected = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_whole_table(spark, sf, name):
    source = {"op2_ann": "embeddings", "op7_html": "pages"}.get(name, "documents")
    rows = spark.read.parquet(f"{sf}/{source}.parquet")
    n = QUERIES[name](spark, sf).count()
    assert n == (20 * rows.where("vec_id % 20 = 0").count() if name == "op2_ann" else rows.count())


def test_toxicity_finds_held_out_labels(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op5_toxicity"](spark, sf).where("held_out").join(labels.where("toxic is not null"), "doc_id").collect()
    assert rows and sum(r.predicted == r.toxic for r in rows) >= 0.8 * len(rows)


def test_pipeline_stage_by_stage(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    scored = QUERIES["op5_toxicity"](spark, sf)
    assert {r.doc_id for r in seen["toxicity"].collect()} == {r.doc_id for r in scored.where("score < 0.5").collect()}
    assert seen["near_dedup"].count() <= seen["toxicity"].count() <= before
    assert {r.doc_id for r in seen["mixing"].collect()} == {r.doc_id for r in seen["substring_dedup"].collect()}
    assert seen["bpe"].count() == seen["mixing"].count() and seen["bpe"].where("NOT exact").count() == 0
