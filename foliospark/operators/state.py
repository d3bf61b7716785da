"""Upserts and state transitions as rewrites: each gives the table's new rows; the caller writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    newest = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of their key."""
    return new.unionByName(old.join(new, key, "left_anti"))


def finish(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Machine texts take the place of older ones but never of a person's edit, whose time stays too."""
    n = new.select(*key, F.col("text").alias("n_text"), F.col("updated_at").alias("n_at"))
    both = old.join(n, key, "full_outer")
    keep = F.coalesce("edited", F.lit(False)) | F.col("n_text").isNull()
    return both.select(*key, F.when(keep, F.col("text")).otherwise(F.col("n_text")).alias("text"), F.coalesce("edited", F.lit(False)).alias("edited"), F.when(keep, F.col("updated_at")).otherwise(F.col("n_at")).alias("updated_at"))


def interrupted(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def interruption_events(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'running'").select("task_id", F.lit("interrupted").alias("status"))


def resumed(tasks: DataFrame, segments: DataFrame, model: Column) -> tuple[DataFrame, DataFrame]:
    """Tasks queued again under a model, and their segments: another model starts anew."""
    t = tasks.withColumn("new_model", model).withColumn("reset", F.col("new_model") != F.col("model_id"))
    s = segments.join(t.select("task_id", "reset"), "task_id")
    s = s.withColumn("translation", F.when(F.col("reset"), "").otherwise(F.col("translation"))).withColumn("status", F.when(F.col("reset"), "pending").otherwise(F.col("status"))).drop("reset")
    return t.select("task_id", F.lit("queued").alias("status"), F.col("new_model").alias("model_id"), "reset"), s


def planned_tasks(documents: DataFrame, langs: list[str], segments: DataFrame) -> DataFrame:
    """A queued task for each document and language, with the number of its segments; documents without any get none."""
    per = segments.groupBy("document_id").agg(F.count("*").alias("total"))
    return documents.join(per, "document_id").select("document_id", F.explode(F.array(*[F.lit(x) for x in langs])).alias("target_lang"), F.lit("queued").alias("status"), "total")
