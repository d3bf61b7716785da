"""The corpus pipeline: five stages over ``documents``, each written to the shared folder and read again.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame. All but the last
give the columns of ``documents``: toxic documents go, one document of each near-duplicate class
stays, repeated 50-word windows are cut out, sources are mixed to their target weights (small ones are
repeated, nothing is dropped), and the texts are encoded and decoded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import bpe, mixing, neardup, substring, toxicity
from foliospark.llm.common import delete, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("mixing", mix_sources), ("bpe", encode_texts)]

#: A trained network decides the first stage, so there is no SQL for the rows; tests hold near-dedup and substring dedup
#: against brute force, the first and last stages against their operators, and all of them against messy rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is a table in the shared folder, which goes once the next one is written."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        before = name
    return docs
