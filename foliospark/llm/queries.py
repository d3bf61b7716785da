"""One thin query per numbered operator; each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import ann, bpe, centroids, htmltext, jaccardjoin, lexical, lmscore, media, mixing, neardup, sharding, substring, toxicity
from foliospark.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lmscore.difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"), digest=True)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.col("m_tokens").alias("n_tokens"), F.round("m_weight", 9).alias("weight"), F.col("m_pass").alias("pass_no"), F.col("m_start").alias("start"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.Index(table(spark, sf_dir, "documents").select("doc_id", "text")).search(table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {"op1_bpe": op1_bpe, "op2_ann": op2_ann, "op3_media": op3_media, "op4_sharding": op4_sharding, "op5_toxicity": op5_toxicity, "op6_neardup": op6_neardup, "op7_html": op7_html, "op8_lm": op8_lm, "op9_substring": op9_substring, "op10_mixing": op10_mixing, "op11_search": op11_search, "op12_join": op12_join, "op13_centroids": op13_centroids}
