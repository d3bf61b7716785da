"""All registered queries of the document engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans import files, prompts, scalars, streams, structure, texts, translate, views  # noqa: F401
from foliospark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of every document in every language."""
    return QUERIES["ag_03_progress"](spark, sf_dir)
