"""Streaming queries over the events table; each is read as a stream and has a twin over the whole table."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.plans.registry import query
from foliospark.shared import shared_dir
from foliospark.sources import tables as T
from foliospark.sources.tables import with_tables
from foliospark.streaming import state as N
from foliospark.streaming import tasks as S


def _stream(s: SparkSession, d: str) -> DataFrame:
    status = F.expr(T.pick("event_id", T.STATUSES))
    schema = T.read(s, d, "events").schema
    path = d if d.endswith("/") else f"{d}/"
    raw = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path) if not _folder(s, f"{path}events.parquet") else s.readStream.schema(schema).parquet(f"{path}events.parquet")
    return raw.select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), status.alias("status"), F.col("props").alias("message"), F.col("ts").cast("timestamp").alias("created_at"), "value")


def _folder(s: SparkSession, path: str) -> bool:
    p = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("str_01_latest_status", with_tables("task_events") + "SELECT task_id, arg_max(status, (created_at, id)) AS status, count(*) AS events FROM task_events GROUP BY task_id")
def str_01(s, d):
    return S.run_to_table(S.latest_status(_stream(s, d)), "complete")


@query("str_02_event_log", with_tables("task_events") + "SELECT id, task_id, status FROM task_events")
def str_02(s, d):
    return S.run_to_table(S.first_copies(_stream(s, d)).select("id", "task_id", "status"), "append")


@query("str_03_snapshots", with_tables("task_events") + "SELECT task_id, string_agg(status, ' ' ORDER BY created_at, id) AS text, max(id) AS last_id FROM task_events GROUP BY task_id")
def str_03(s, d):
    """What a reader of the token stream sees last: one snapshot a task, replaced with each trigger."""
    return S.run_to_table(S.snapshots(_stream(s, d)), "complete")


@query("str_05_idle_tasks", with_tables("task_events", more="l AS (SELECT task_id, max(created_at) AS last, arg_max(status, (created_at, id)) AS status FROM task_events GROUP BY task_id)") + "SELECT task_id, epoch_us(last) // 1000 AS last_ms FROM l WHERE status <> 'paused' AND epoch_us(last) // 1000 + 43200000 < (SELECT max(epoch_us(created_at) // 1000) FROM task_events)")
def str_05(s, d):
    """Tasks silent for twelve hours of event time when the stream ends."""
    return S.run_to_table(S.idle_tasks(_stream(s, d), 43_200), "append")


@query("str_07_published", with_tables("task_events") + "SELECT DISTINCT task_id FROM task_events WHERE status = 'complete'")
def str_07(s, d):
    """Each completed task is published once, however often it is completed."""
    return S.published(_stream(s, d)).select("task_id")


@query("str_04_last_events", with_tables("task_events") + "SELECT task_id, id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, id DESC) AS n FROM task_events) WHERE n <= 5")
def str_04(s, d):
    newest = Window.partitionBy("task_id").orderBy(F.desc("created_at"), F.desc("id"))
    return T.task_events(s, d).withColumn("n", F.row_number().over(newest)).where("n <= 5").select("task_id", "id")


@query("str_06_resume", with_tables("segments") + "SELECT task_id, block_ord, segment_ord, array_to_string(list_reverse(string_split(source, ' ')), ' ') AS translation FROM segments WHERE status <> 'complete'")
def str_06(s, d):
    """Pending segments are worked on in triggers of a quarter of the files; the run ends after two of them and goes on from its checkpoint.

    There are as many files as shuffle partitions, four at least, so that a task's share doesn't grow with a trigger's."""
    folder = f"{shared_dir(s).rstrip('/')}/resume-{uuid.uuid4().hex}"
    rows = T.segments(s, d).select("task_id", "block_ord", "segment_ord", "source", "status")
    parts = max(4, int(s.conf.get("spark.sql.shuffle.partitions", "200")))
    rows.repartition(parts, "task_id", "block_ord").write.parquet(f"{folder}/segments")
    turns = [0]

    def made(batch: DataFrame) -> DataFrame:
        turns[0] += 1
        if turns[0] == 3:
            raise InterruptedError("stopped")
        return batch.select("task_id", "block_ord", "segment_ord", F.array_join(F.reverse(F.split("source", " ")), " ").alias("translation"))

    for _ in range(2):
        stream = S.events(s, f"{folder}/segments", rows.schema, -(-parts // 4))
        try:
            S.resume(stream, f"{folder}/out", f"{folder}/checkpoint", made).awaitTermination()
        except StreamingQueryException as e:
            if "stopped" not in str(e):
                raise
    return s.read.parquet(f"{folder}/out").select("task_id", "block_ord", "segment_ord", "translation")


@query("str_04_newest_events", with_tables("task_events") + "SELECT task_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, id DESC) AS n FROM task_events) WHERE n <= 200")
def str_04_newest(s, d):
    """What a client holds of each task when the stream ends."""
    return S.drained(N.newest_events(_stream(s, d)), "task_id").select("task_id", "id", "status")


@query("str_03_grown_texts", with_tables("task_events", more="c AS (SELECT task_id, max((created_at, id)) FILTER (WHERE status = 'queued') AS cut FROM task_events GROUP BY task_id)") + "SELECT task_id, string_agg(status, ' ' ORDER BY created_at, id) AS text, max(id) AS last_id FROM task_events JOIN c USING (task_id) WHERE cut IS NULL OR (created_at, id) >= cut GROUP BY task_id")
def str_03_grown(s, d):
    """Texts that grow by pieces; a piece that says queued takes the place of all before it."""
    pieces = _stream(s, d).withColumns({"piece": F.col("status"), "replace": F.col("status") == "queued"})
    return S.drained(N.grown_texts(pieces), "task_id")


_FOLD = (
    "list_reduce(list_prepend({'phase': '', 'due': -1::BIGINT, 'out': []::STRUCT(reason VARCHAR, due BIGINT)[], 'at': 0::BIGINT, 'status': ''}, e), lambda a, x: "
    "{'phase': CASE WHEN x.status IN ('complete', 'failed', 'cancelled', 'interrupted') THEN '' WHEN x.status = 'running' OR live(a, x) AND a.phase IN ('running', 'paused') AND x.status <> 'paused' THEN 'running' WHEN live(a, x) AND a.phase IN ('running', 'paused') THEN 'paused' ELSE 'starting' END, "
    "'due': CASE WHEN x.status IN ('complete', 'failed', 'cancelled', 'interrupted') THEN -1 WHEN x.status = 'running' OR live(a, x) AND a.phase IN ('running', 'paused') AND x.status <> 'paused' THEN x.at + 86400000 WHEN live(a, x) AND a.phase IN ('running', 'paused') THEN -1 WHEN live(a, x) AND a.phase = 'starting' THEN a.due ELSE x.at + 43200000 END, "
    "'out': CASE WHEN a.due >= 0 AND a.due < x.at THEN list_append(a.out, {'reason': CASE WHEN a.phase = 'starting' THEN 'startup_timeout' ELSE 'idle_timeout' END, 'due': a.due}) ELSE a.out END, 'at': x.at, 'status': x.status})"
)
_LIVE = "(a.phase <> '' AND NOT (a.due >= 0 AND a.due < x.at))"


@query(
    "str_05_timed_out",
    with_tables("task_events", more="o AS (SELECT task_id, list({'phase': '', 'due': -1::BIGINT, 'out': []::STRUCT(reason VARCHAR, due BIGINT)[], 'at': epoch_us(created_at) // 1000, 'status': status} ORDER BY epoch_us(created_at) // 1000, id) AS e FROM task_events GROUP BY task_id), f AS (SELECT task_id, " + _FOLD.replace("live(a, x)", _LIVE) + " AS a FROM o), m AS (SELECT max(epoch_us(created_at) // 1000) AS now FROM task_events)")
    + "SELECT task_id, r.reason AS reason, r.due AS due_ms FROM (SELECT task_id, unnest(CASE WHEN a.due >= 0 AND a.due < now THEN list_append(a.out, {'reason': CASE WHEN a.phase = 'starting' THEN 'startup_timeout' ELSE 'idle_timeout' END, 'due': a.due}) ELSE a.out END) AS r FROM f, m)",
)
def str_05_watch(s, d):
    """Every time-out of event time: twelve hours to start, a day without a sign later; paused tasks wait."""
    return S.drained(N.timed_out(_stream(s, d), 43_200, 86_400, event_time=True))


@query("str_ext_daily_counts", with_tables("task_events") + "SELECT date_trunc('day', created_at)::TIMESTAMP AS start, status, count(*) AS n FROM task_events GROUP BY ALL")
def str_windows(s, d):
    return S.run_to_table(S.status_counts(_stream(s, d)), "complete")
