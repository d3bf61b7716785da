"""The term automaton against plain patterns, and ordered folds in linear time."""

import random
import re
import time

from pyspark.sql import functions as F

from foliospark.operators import glossary as G
from foliospark.operators import segments as P
from foliospark.operators import translate as R
from foliospark.operators.terms import Terms, folded, letter, word


def plain_protect(text, terms):
    """Term by term on the text that has marks already."""
    marks = {}
    for source, target in sorted((t for t in terms if t[0]), key=lambda t: -len(t[0])):

        def mark(_, target=target):
            name = f"TERMQ{len(marks):04d}QX"
            marks[name] = target
            return name

        text = re.sub(rf"(?<!\w){re.escape(source)}(?!\w)", mark, text, flags=re.I)
    return text, marks


def test_marks_as_by_plain_patterns():
    g = random.Random(5)
    parts = ["river", "River", "bank", "a", "b", "-", ".", " ", " ", " ", "é", "É", "_", "ß", "字"]
    for _ in range(3000):
        terms = [("".join(g.choices(parts, k=g.randrange(1, 4))).strip(), f"t{i}") for i in range(4)]
        text = "".join(g.choices(parts, k=g.randrange(0, 14)))
        assert G.protect(text, terms) == plain_protect(text, terms), (text, terms)


def test_folds_keep_places():
    text = "İstanbul ſtraße ÀÉ Σς K"
    assert len(folded(text)) == len(text) and folded("ÀÉ") == "àé" and folded("İ") == "İ"


def test_many_terms_cost_no_more(spark):
    text = " ".join(f"w{i % 977}" for i in range(60_000))
    took = []
    for n in (10, 20_000):
        known = Terms([f"w{i * 7}" for i in range(n)], letter)
        start = time.perf_counter()
        found = known.numbers(text)
        took.append(time.perf_counter() - start)
        assert found == [i for i in range(n) if i * 7 < 977]
    assert took[1] < 20 * took[0] + 0.2


def test_leftmost_longest_marks():
    known = Terms(["the", "of the", "theme"])
    assert known.marked("Of The themes", "<", ">") == "<Of The> <theme>s"
    assert Terms([], word).marked("x", "<", ">") == "x" and Terms(["", "a"], word).numbers("a b") == [1]


def test_large_glossaries_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "The RIVER-bank, a river bank; riverbank"), (2, "go → there"), (3, None)], "k int, text string")
    terms = spark.createDataFrame([(1, "river"), (2, "river bank"), (3, "→")], "id int, term string")
    want = sorted((r.k, r.id) for r in G.with_terms(df, "text", terms).collect())
    monkeypatch.setattr(G, "LARGEST", 2)
    assert want == sorted((r.k, r.id) for r in G.with_terms(df, "text", terms).collect()) == [(1, 1), (1, 2), (2, 3)]


def test_packs_grow_in_proportion(spark):
    def took(n):
        rows = spark.range(n).select(F.lit(1).alias("task_id"), F.col("id").cast("int").alias("block_ord"), F.lit(0).alias("segment_ord"), F.repeat(F.lit("x"), (F.col("id") % 40 + 1).cast("int")).alias("source"), F.lit("paragraph").alias("kind")).cache()
        rows.count()
        start = time.perf_counter()
        assert P.packs(rows, 500, group_blocks=False).agg(F.max("pack")).first()[0] == -(-n // 4) - 1
        return time.perf_counter() - start

    took(1000)
    assert took(32_000) < 6 * took(8_000) + 0.5


def test_summaries_roll_on_and_outlive_a_failure(spark):
    rows = spark.createDataFrame([(1, p, 2, f"text {p}") for p in range(7)] + [(2, 0, 9, ""), (2, 1, 9, " x ")], "task_id long, pack int, count int, output string")
    got = {(r.task_id, r.pack): (r.due, r.narrative) for r in R.narratives(rows, 4, lambda old, new: f"{old} [{new}]").collect()}
    assert [got[1, p] for p in range(4)] == [(False, ""), (True, "[text 0 text 1]"), (False, "[text 0 text 1]"), (True, "[text 0 text 1] [text 2 text 3]")]
    assert got[2, 0] == (True, "") and got[2, 1] == (True, "[x]")

    def fails(old, new):
        if "2" in new:
            raise RuntimeError("no model")
        return f"{old} {new}"

    got = {r.pack: r.narrative for r in R.narratives(rows.where("task_id = 1"), 4, fails).collect()}
    assert got[3] == got[1] == "text 0 text 1" and got[5] == "text 0 text 1 text 4 text 5"
    assert len(R.narratives(rows, 1, lambda old, new: "y" * 5000).first().narrative) == R.SUMMARY
