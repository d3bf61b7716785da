"""Stateful streams: restarts, timers, lists and texts against batch results."""

import datetime
import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from foliospark.streaming import state as N
from foliospark.streaming import tasks as S

START = datetime.datetime(2026, 1, 1)


def log(spark, path, n=120, files=6, tasks=4):
    """A log in files that are read one after the other."""
    g = random.Random(7)
    rows = [(i, g.randrange(tasks), g.choice(("queued", "running", "running", "paused", "complete")), f"m{i}", START + datetime.timedelta(minutes=i * 7), 1.0) for i in range(n)]
    for f in range(files):
        spark.createDataFrame(rows[f * n // files : (f + 1) * n // files], S.EVENTS).coalesce(1).write.parquet(f"{path}/{f:02d}")
        time.sleep(0.01)
    return spark.readStream.schema(S.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path), rows


def run(spark, stream, sink, checkpoint, mode="update"):
    with N.state_store(spark):
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode).foreachBatch(sink).start().awaitTermination(90)


def test_newest_events_are_a_bounded_list_and_survive_a_restart(spark, tmp_path):
    stream, rows = log(spark, f"{tmp_path}/log")
    newest, put, sizes = N.newest_events(stream, 5), N.keyed_batches(f"{tmp_path}/out"), []

    def sink(batch, number):
        if number == 3 and not sizes:
            sizes.append(0)
            raise InterruptedError("stopped")
        put(batch, number)
        put(batch, number)  # a trigger that runs again changes nothing

    with pytest.raises(StreamingQueryException):
        run(spark, newest, sink, f"{tmp_path}/checkpoint")
    run(spark, newest, sink, f"{tmp_path}/checkpoint")
    got = sorted((r.task_id, r.id) for r in N.latest(spark, f"{tmp_path}/out", newest.schema, "task_id").collect())
    want = sorted((t, i) for t in range(4) for i in [r[0] for r in rows if r[1] == t][-5:])
    assert got == want


def test_texts_grow_by_new_pieces_only(spark, tmp_path):
    stream, rows = log(spark, f"{tmp_path}/log")
    texts = N.grown_texts(stream.withColumns({"piece": F.col("message"), "replace": F.col("status") == "queued"}))
    touched = []

    def sink(batch, number):
        touched.append({r.task_id for r in batch.collect()})
        N.keyed_batches(f"{tmp_path}/out")(batch, number)

    run(spark, texts, sink, f"{tmp_path}/checkpoint")
    want = {}
    for i, t, status, piece, *_ in rows:
        want[t] = piece if status == "queued" else f"{want[t]} {piece}" if t in want else piece
    assert {r.task_id: r.text for r in N.latest(spark, f"{tmp_path}/out", texts.schema, "task_id").collect()} == want
    assert touched[0] == {r[1] for r in rows[:20]}


def test_a_resumed_run_does_each_segment_once(spark, tmp_path):
    for f in range(5):
        rows = [(t, b, 0, "pending" if (t + b) % 3 else "complete") for t in range(3) for b in range(f * 4, f * 4 + 4)]
        spark.createDataFrame(rows + rows[:2], "task_id long, block_ord int, segment_ord int, status string").coalesce(1).write.parquet(f"{tmp_path}/in/{f}")
    schema = "task_id long, block_ord int, segment_ord int, status string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    work, stops = [], [1, 3]

    def made(batch):
        work.append(batch.count())
        if stops and len(work) > stops[0]:
            stops.pop(0)
            raise InterruptedError("stopped")
        return batch.select("task_id", "block_ord", "segment_ord")

    for last in (False, False, True):
        q = S.resume(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", made)
        if last:
            q.awaitTermination(90)
        else:
            with pytest.raises(StreamingQueryException):
                q.awaitTermination(90)
    got = sorted((r.task_id, r.block_ord) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((t, b) for t in range(3) for b in range(20) if (t + b) % 3)


def test_watch_by_a_clock_set_by_hand():
    s = lambda watch, status, now: N.watched(watch, status, now * 1000, startup=180, idle=240)
    w = s(None, "queued", 0)
    assert w == ("starting", 180_000)
    assert s(w, "queued", 100) == w and s(w, "paused", 100) == w  # startup goes on
    w = s(w, "running", 170)
    assert w == ("running", 410_000)
    assert s(w, "running", 400) == ("running", 640_000)
    p = s(w, "paused", 400)
    assert p == ("paused", None) and s(p, "paused", 9000) == p  # no time runs
    assert s(p, "queued", 9001) == ("running", 9_241_000)  # the whole time again
    for end in N.ENDED:
        assert s(w, end, 401) is None


def test_timers_of_the_wall_clock(spark, tmp_path):
    def put(n, task, status):
        spark.createDataFrame([(n, task, status, "", START, 1.0)], S.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/log/{n}")

    for n, (task, status) in enumerate([(1, "queued"), (2, "running"), (3, "running"), (4, "running")]):
        put(n, task, status)
    stream = spark.readStream.schema(S.EVENTS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log")
    seen = {}

    def sink(batch, number):
        for r in batch.collect():
            assert r.task_id not in seen
            seen[r.task_id] = (r.reason, time.time())

    with N.state_store(spark):
        q = N.timed_out(stream, startup=4, idle=8).writeStream.option("checkpointLocation", f"{tmp_path}/c").outputMode("update").foreachBatch(sink).trigger(processingTime="200 milliseconds").start()
    try:
        while not q.recentProgress:
            time.sleep(0.1)
        put(10, 3, "paused")
        put(11, 4, "complete")
        end = time.time() + 60
        while time.time() < end and not {1, 2} <= set(seen):
            time.sleep(0.2)
        time.sleep(2)
    finally:
        q.stop()
    assert {t: r for t, (r, _) in seen.items()} == {1: "startup_timeout", 2: "idle_timeout"}
    assert seen[1][1] < seen[2][1]
