"""Keyed state over the task log: newest events, texts that grow, and watches with timers.

The processors run by ``transformWithStateInPandas`` on the RocksDB state store, so a trigger reads and writes the state of the
tasks that it touches only. What they give replaces what a task had before: ``keyed_batches`` puts each trigger's rows into a
folder of its own, which a repeated trigger overwrites, and ``latest`` reads each key's rows of its newest trigger.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: events of a task that a client keeps.
NEWEST = 200
#: Seconds without a sign of life, at the start and later; for documents more.
STARTUP, IDLE, STARTUP_DOCUMENTS, IDLE_DOCUMENTS = 180, 240, 600, 900
ENDED = frozenset(("complete", "failed", "cancelled", "interrupted"))


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Newest(StatefulProcessor):
    """A list of each task's newest events, ``newest`` at most; with a ``ttl``, a task silent for so many seconds is forgotten."""

    def __init__(self, newest: int, ttl: int | None):
        self.newest, self.ttl = newest, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", "created_at timestamp, id long, status string", ttlDurationMs=self.ttl and self.ttl * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {(at, id_): status for at, id_, status in self.events.get()}
        for b in rows:
            held |= {(at.to_pydatetime(), int(i)): s for at, i, s in zip(b["created_at"], b["id"], b["status"], strict=True)}
        best = sorted(held, reverse=True)[: self.newest]
        self.events.put([(at, i, held[at, i]) for at, i in best])
        yield pd.DataFrame({"task_id": key[0], "id": [i for _, i in best], "status": [held[x] for x in best], "created_at": pd.Series([at for at, _ in best], dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def newest_events(stream: DataFrame, newest: int = NEWEST, ttl: int | None = None) -> DataFrame:
    """task_id, id, status, created_at of the newest events of each task that a trigger touches; repeated events count once.
    A ``ttl`` needs a trigger by processing time: with one, a stream of all there is now would wait for clocks for ever."""
    rows = stream.select("task_id", "id", "status", "created_at")
    return rows.groupBy("task_id").transformWithStateInPandas(Newest(newest, ttl), "task_id long, id long, status string, created_at timestamp", "Update", "ProcessingTime" if ttl else "None")


class Growing(StatefulProcessor):
    """A task's pieces as a list to which only new ones are appended; ``replace`` marks one that takes the place of all before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getListState("pieces", "created_at timestamp, id long, piece string")
        self.cut = handle.getValueState("cut", "created_at timestamp, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, cut = [], self.cut.get() if self.cut.exists() else None
        for b in rows:
            for at, i, piece, replace in zip(b["created_at"], b["id"], b["piece"], b["replace"], strict=True):
                new.append((at.to_pydatetime(), int(i), piece))
                if replace and (cut is None or new[-1][:2] > tuple(cut)):
                    cut = new[-1][:2]
        if cut is not None:  # what a replacement has made void goes from the state
            new = [p for p in [*map(tuple, self.pieces.get()), *new] if p[:2] >= tuple(cut)]
            self.pieces.put(new)
            self.cut.update(tuple(cut))
        else:
            self.pieces.appendList(new)
            new = [tuple(p) for p in self.pieces.get()]
        new.sort(key=lambda p: p[:2])
        yield pd.DataFrame({"task_id": [key[0]], "text": [" ".join(p[2] for p in new)], "last_id": [max(p[1] for p in new)]})

    def close(self) -> None:
        pass


def grown_texts(stream: DataFrame) -> DataFrame:
    """task_id, text, last_id of each task that a trigger touches, from rows (task_id, id, created_at, piece, replace).

    Rows wait for the trigger, so a processing-time trigger of 80 ms gives at most one text for each task in that time.
    """
    rows = stream.select("task_id", "id", "created_at", "piece", "replace")
    return rows.groupBy("task_id").transformWithStateInPandas(Growing(), "task_id long, text string, last_id long", "Update", "None")


class Watch(NamedTuple):
    """What a task's watch knows: its phase (starting, running or paused) and when it runs out, in milliseconds."""

    phase: str
    due: int | None


def watched(watch: Watch | None, status: str, now: int, startup: int = STARTUP, idle: int = IDLE) -> Watch | None:
    """The watch after an event. Startup is timed from the first sign of a task until it runs; then each event starts the idle time anew.
    While a running task is paused no time runs, and when it goes on it has the whole time again. An ended task has no watch."""
    if status in ENDED:
        return None
    if status == "running" or watch is not None and watch.phase != "starting" and status != "paused":
        return Watch("running", now + idle * 1000)
    if watch is None or watch.phase == "starting":
        return watch or Watch("starting", now + startup * 1000)
    return Watch("paused", None)


class Watchdog(StatefulProcessor):
    """Reports tasks whose time has run out; the clock is the stream's event time or the wall's."""

    def __init__(self, startup: int, idle: int, event_time: bool):
        self.startup, self.idle, self.event_time = startup, idle, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", "phase string, due long")

    def _told(self, key, watch: Watch) -> tuple:
        return key[0], f"{'startup' if watch.phase == 'starting' else 'idle'}_timeout", watch.due

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watch, out, wall = Watch(*self.state.get()) if self.state.exists() else None, [], timerValues.getCurrentProcessingTimeInMs()
        before = watch.due if watch else None
        for at, _, status in sorted((at, i, s) for b in rows for at, i, s in zip(b["at_ms"], b["id"], b["status"], strict=True)):
            now = int(at) if self.event_time else wall
            if watch and watch.due is not None and watch.due < now:
                out.append(self._told(key, watch))
                watch = None
            watch = watched(watch, status, now, self.startup, self.idle)
        after = watch.due if watch else None
        if before is not None and before != after:
            self.handle.deleteTimer(before)
        if after is not None and before != after:
            self.handle.registerTimer(after)
        self.state.update(tuple(watch)) if watch else self.state.clear()
        yield pd.DataFrame(out, columns=["task_id", "reason", "due_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watch = Watch(*self.state.get()) if self.state.exists() else None
        if watch and watch.due == expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield pd.DataFrame([self._told(key, watch)], columns=["task_id", "reason", "due_ms"])

    def close(self) -> None:
        pass


def timed_out(stream: DataFrame, startup: int = STARTUP, idle: int = IDLE, event_time: bool = False) -> DataFrame:
    """task_id, reason (startup_timeout or idle_timeout), due_ms of tasks that gave no sign in time; one that times out starts anew with its next event."""
    rows = stream.withColumn("at_ms", F.unix_millis("created_at"))
    if event_time:
        rows = rows.withWatermark("created_at", "0 seconds")
    mode = "EventTime" if event_time else "ProcessingTime"
    return rows.select("task_id", "id", "status", "at_ms", "created_at").groupBy("task_id").transformWithStateInPandas(Watchdog(startup, idle, event_time), "task_id long, reason string, due_ms long", "Append" if event_time else "Update", mode)


def keyed_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each trigger's rows into a folder of its own; a trigger that runs again overwrites what it wrote."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def latest(spark: SparkSession, path: str, schema: StructType, *keys: str) -> DataFrame:
    """For each key the rows of the newest trigger that has any."""
    rows = spark.read.schema(StructType.fromJson(schema.jsonValue()).add("batch", "long")).parquet(path)
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*keys, "batch"], "left_semi").select(*schema.names)
