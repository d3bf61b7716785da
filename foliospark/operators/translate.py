"""The translation pipeline around a pluggable model call: packs in, checked and reassembled texts out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import cleaning as C
from foliospark.functions import scripts
from foliospark.operators.folds import fold_sorted
from foliospark.shared import shared_dir

Translator = Callable[[str], str]


def stub(text: str) -> str:
    """A deterministic stand-in for a model: each paragraph's words in reverse order."""
    return "\n\n".join(" ".join(reversed(p.split())) for p in text.split("\n\n"))


def requests(packed: DataFrame, segments: DataFrame) -> DataFrame:
    """task_id, pack, request: the pack's sources in order, between blank lines."""
    rows = packed.join(segments.select("task_id", "block_ord", "segment_ord", "source"), ["task_id", "block_ord", "segment_ord"])
    return rows.groupBy("task_id", "pack").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "segment_ord", "source"))), lambda x: x["source"]), "\n\n").alias("request"), F.count("*").cast("int").alias("count"))


def pack_requests(packed: DataFrame) -> DataFrame:
    """task_id, pack, request, places, count of packs with their parts: as ``requests``, and where each part belongs."""
    request = F.array_join(F.transform("parts", lambda x: x["source"]), "\n\n")
    places = F.transform("parts", lambda x: F.struct(x["block_ord"].alias("block_ord"), x["segment_ord"].alias("segment_ord")))
    return packed.select("task_id", "pack", request.alias("request"), places.alias("places"), F.size("parts").alias("count"))


def call(rows: DataFrame, translator: Translator = stub, bare: str = "request") -> DataFrame:
    """rows with ``output`` and ``attempts``: an empty answer or one that gives the request back is asked for once more, now with
    the text in ``bare``, which has no background. Equal requests are sent once and their answers joined back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, tries = [], []
            for text, plain in zip(b["request"], b["bare"], strict=True):
                answer, n = translator(text), 1
                if not answer.strip() or answer.strip() == text.strip():
                    answer, n = translator(plain), 2
                out.append(answer)
                tries.append(n)
            yield pd.DataFrame({"asked": b["asked"], "output": out, "attempts": tries})

    def digest(*texts: str) -> Column:
        """What travels in place of the texts; never null, so that a join needs no filter that would make it twice."""
        return F.coalesce(F.sha2(F.concat_ws("\u0000", F.length("request").cast("string"), *dict.fromkeys(texts)), 256), F.lit(""))

    asked = rows.withColumn("asked", digest("request", bare))
    once = rows.select(*dict.fromkeys(("request", bare))).distinct()  # texts as keys, which are hashed and not sorted
    answers = once.select(digest("request", bare).alias("asked"), "request", F.col(bare).alias("bare")).mapInPandas(run, "asked string, output string, attempts int")
    return asked.join(answers, "asked").drop("asked")


def attempted(rows: DataFrame, translator: Translator = stub) -> DataFrame:
    """rows (request, bare, source, code, previous, supplied) with ``output``, ``attempts`` and ``error``: finished answers.

    An answer that missed (see ``cleaning.missed``) or repeats the background is asked for once more without any, if there was some,
    or if the answer is the source again or in a foreign script. What stays empty then is an error. Each of
    the two calls is a table of its own, so that no request is sent twice.
    """
    shared_dir(rows.sparkSession)

    def asked(these: DataFrame, request: str) -> DataFrame:
        once = these.withColumn("asked", F.sha2(request, 256)).groupBy("asked").agg(F.first(request).alias("text"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"asked": b["asked"], "raw": [translator(t) for t in b["text"]]})

        answers = once.mapInPandas(run, "asked string, raw string")
        return these.join(answers, F.sha2(these[request], 256) == answers["asked"]).drop("asked")

    inputs = ["request", "bare", "source", "code", "previous", "supplied"]
    key = F.sha2(F.to_json(F.struct(*inputs)), 256)
    columns = ["key", *inputs]
    once = rows.withColumn("key", key).groupBy("key").agg(*[F.first(c).alias(c) for c in inputs])  # equal ones are one piece of work
    first = C.with_finished(asked(once, "request"), "raw", "source", "code", "output", "previous")
    background = F.array_join("previous", " ")
    again = scripts.intrusion(F.col("output"), F.col("source"), F.col("code")) | C.echoes(F.col("output"), F.col("source"))
    bad = C.missed(F.col("output"), F.col("source"), F.col("code"), F.col("previous")) | C.repeats_context(F.col("output"), background)
    judged = first.withColumn("retry", bad & (F.col("supplied") | again)).select(*columns, "output", "retry").checkpoint()
    none = F.array().cast("array<string>")
    second = C.with_finished(asked(judged.where("retry").drop("output"), "bare").withColumn("no_previous", none), "raw", "source", "code", "output", "no_previous")
    both = judged.where("NOT retry").select(*columns, "output", F.lit(1).alias("attempts")).unionByName(second.select(*columns, "output", F.lit(2).alias("attempts")))
    done = scripts.with_foreign_removed(both, "output", "source", "code", "output").select("key", "output", "attempts")
    return rows.withColumn("key", key).join(done, "key").drop("key").withColumn("error", F.when(F.trim("output") == "", "the answer is empty"))


#: Characters of new translations that a summary is made from, and of the summary itself.
FRESH, SUMMARY = 1600, 900

Summariser = Callable[[str, str], str]


def stub_summary(summary: str, fresh: str) -> str:
    """A deterministic stand-in for a model: what was there, and the start of what is new."""
    return f"{summary} {fresh[:40]}"


def narratives(rows: DataFrame, every: int = 20, summarise: Summariser = stub_summary) -> DataFrame:
    """due and narrative of each pack of a task (task_id, pack, count, output): the running summary of the book so far.

    It is due at the first pack with ``every`` or more segments done since the last one, and made from the summary before it
    and the end of the translations since then, its white space squeezed and cut to SUMMARY characters. A summariser that
    fails leaves the summary as it was until the next one is due.
    """

    def step(state: tuple | None, pack: tuple) -> tuple[tuple, tuple]:
        done, fresh, summary = state or (0, "", "")
        done, text = done + pack[0], (pack[1] or "").strip()
        fresh = (f"{fresh}\n{text}" if fresh and text else fresh or text)[-FRESH:]
        due = done >= every
        if due:
            if fresh or summary:
                try:
                    summary = " ".join(summarise(summary, fresh).split())[:SUMMARY]
                except Exception:  # noqa: BLE001  a summary is a help, no result
                    pass
            done, fresh = 0, ""
        return (due, summary), (done, fresh, summary)

    return fold_sorted(rows, ["task_id"], ["pack"], ["count", "output"], step, "due boolean, narrative string")
