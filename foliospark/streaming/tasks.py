"""Structured Streaming over the task log: state by task, first copies only, exactly-once publishing, idle tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from foliospark.shared import shared_dir
from foliospark.streaming.state import keyed_batches, latest, state_store

EVENTS = "id long, task_id long, status string, message string, created_at timestamp, value double"


def events(spark: SparkSession, path: str, schema: str | StructType = EVENTS, files: int = 1) -> DataFrame:
    """The log's files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def latest_status(stream: DataFrame) -> DataFrame:
    """Latest status and number of events of each task; its state is one row a task."""
    return stream.groupBy("task_id").agg(F.max_by("status", F.struct("created_at", "id")).alias("status"), F.count("*").alias("events"))


def snapshots(stream: DataFrame) -> DataFrame:
    """The whole text of each task so far, from its pieces in order: every trigger gives a text that takes the place of the one before."""
    pieces = F.array_sort(F.collect_list(F.struct("created_at", "id", "status")))
    return stream.groupBy("task_id").agg(F.array_join(F.transform(pieces, lambda x: x["status"]), " ").alias("text"), F.max("id").alias("last_id"))


def first_copies(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once; copies may come up to ``delay`` late, which bounds the state."""
    return stream.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])


def status_counts(stream: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by status in tumbling windows of event time (an extension: the task log itself has no windows)."""
    return stream.withWatermark("created_at", delay).groupBy(F.window("created_at", width).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def idle_tasks(stream: DataFrame, seconds: int = 240) -> DataFrame:
    """A row for each task that has been silent for so long in event time; paused tasks don't time out."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "last_ms": [last]})
            return
        last, status = (state.get[0] if state.exists else 0), ""
        for b in batches:
            at = b["created_at"].astype("int64") // (1000 if "us" in str(b["created_at"].dtype) else 1_000_000)
            if len(b) and int(at.max()) >= last:
                last, status = int(at.max()), b["status"].iloc[int(at.to_numpy().argmax())]
        state.update((last,))
        if status != "paused":
            due = last + seconds * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    rows = stream.withWatermark("created_at", "0 seconds").select("task_id", "status", "created_at")
    return rows.groupBy("task_id").applyInPandasWithState(run, "task_id long, last_ms long", "last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def first_of(stream: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key that the stream ever brings; its state is the keys seen, kept from trigger to trigger."""
    return stream.dropDuplicates([*keys])


def each_once(stream: DataFrame, target: str, checkpoint: str, make: Callable[[DataFrame], DataFrame]):
    """What ``make`` gives of each row, once: a trigger's rows go into its own folder, which is overwritten if the trigger runs
    again, and the checkpoint knows the triggers done; no trigger reads what others have written."""

    def batch(rows: DataFrame, number: int) -> None:
        make(rows).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_once(stream: DataFrame, target: str, checkpoint: str, make: Callable[[DataFrame], DataFrame]):
    """Publishes each task once, with its first completion."""
    done = first_of(stream.where("status = 'complete'").select("task_id"), "task_id")
    return each_once(done, target, checkpoint, make)


def resume(stream: DataFrame, target: str, checkpoint: str, make: Callable[[DataFrame], DataFrame]):
    """Works on the segments (task_id, block_ord, segment_ord, status, ..) that aren't complete, each once. Stopped at any time and started again with the
    same target and checkpoint, it goes on with the triggers that weren't done."""
    pending = first_of(stream.where("status <> 'complete'"), "task_id", "block_ord", "segment_ord")
    return each_once(pending, target, checkpoint, make)


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """All there is now, through a stream into Parquet files in the shared folder: no row passes through the driver."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/rows"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)  # a stream without rows writes nothing
    if mode == "complete":  # each batch has all rows of the result
        writer.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(out)).outputMode(mode).start().awaitTermination()
    else:
        writer.format("parquet").outputMode(mode).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def published(stream: DataFrame) -> DataFrame:
    """What ``publish_once`` has made of all there is now, in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/published-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    publish_once(stream, f"{folder}/out", f"{folder}/checkpoint", lambda done: done).awaitTermination()
    return spark.read.schema("task_id long, batch int").parquet(f"{folder}/out")


def drained(stream: DataFrame, *keys: str) -> DataFrame:
    """All there is now through a stateful stream whose rows replace those of their keys; without keys all rows stay."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    with state_store(spark):
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        writer.outputMode("update" if keys else "append").foreachBatch(keyed_batches(f"{folder}/rows")).start().awaitTermination()
    return latest(spark, f"{folder}/rows", stream.schema, *keys) if keys else spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)
