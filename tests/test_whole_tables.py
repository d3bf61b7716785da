"""Queries without SQL cover their whole table."""

import pytest
from pyspark.sql import functions as F

from foliospark.plans import catalog, texts
from foliospark.sources import tables as T
from foliospark.streaming import tasks as ST


@pytest.mark.parametrize("name", ["sc_31_without_headers", "sc_38_polished", "sc_43_finished", "sc_44_missed", "sc_54_without_foreign"])
def test_all_outputs(spark, sf, name):
    want = {(r.document_id, r.ord) for r in T.blocks(spark, sf).select("document_id", "ord").collect()}
    got = [(r.document_id, r.ord) for r in catalog.QUERIES[name](spark, sf).select("document_id", "ord").collect()]
    assert len(got) == len(want) and set(got) == want


def test_whole_sources(spark, sf):
    cut = texts._outs(spark, sf).join(T.blocks(spark, sf).select("document_id", "ord", "text"), ["document_id", "ord"]).where("source <> text")
    assert cut.count() == 0


def test_terms_of_all_english_blocks(spark, sf):
    got = catalog.QUERIES["sc_20_protect_terms"](spark, sf).select("document_id", "ord")
    want = T.blocks(spark, sf).where("lang = 'en'").select("document_id", "ord")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_narratives_of_all_tasks(spark, sf):
    got = catalog.QUERIES["udf_04_narrative_due"](spark, sf).select("task_id").distinct()
    want = T.segments(spark, sf).where(F.col("source") != "").select("task_id").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["str_01_latest_status", "str_02_event_log", "str_ext_daily_counts"])
def test_streams_end_in_files(spark, sf, name):
    rows = catalog.QUERIES[name](spark, sf)
    assert rows.inputFiles() and rows.count()


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_a_stream_without_rows(spark, tmp_path, mode):
    spark.createDataFrame([], ST.EVENTS).write.parquet(str(tmp_path / "in"))
    stream = ST.events(spark, str(tmp_path / "in"))
    assert ST.run_to_table(stream if mode == "append" else ST.latest_status(stream), mode).count() == 0
