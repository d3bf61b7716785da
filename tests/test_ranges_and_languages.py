"""Joins in bins against all pairs, and languages told apart by profiles."""

import random

from pyspark.sql import functions as F

from foliospark.functions import languages as L
from foliospark.operators import layout as Y
from foliospark.operators import ranges as R


def boxes(g, n, side):
    return [(g.randrange(3), i, (x := g.uniform(-200, side)), (y := g.uniform(-200, side)), x + g.uniform(0, 150), y + g.uniform(0, 40)) for i in range(n)]


def test_overlaps_as_all_pairs(spark):
    g = random.Random(3)
    a, b = boxes(g, 150, 400), boxes(g, 90, 400)
    left = spark.createDataFrame(a, "page int, i int, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame(b, "page int, j int, bx0 double, by0 double, bx1 double, by1 double")
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5])
    for cell in (16.0, 64.0, 1000.0):
        met = R.overlapping(left, right, ["page"], [("x0", "x1", "bx0", "bx1"), ("y0", "y1", "by0", "by1")], cell)
        assert sorted((r.i, r.j) for r in met.collect()) == want
    near = R.within(left.select("page", "i", "y0"), right.select("page", "j", "by0"), ["page"], "y0", "by0", 2.5)
    assert sorted((r.i, r.j) for r in near.collect()) == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and abs(p[3] - q[3]) <= 2.5)


def test_a_crowded_page_meets_in_proportion(spark):
    def made(n):
        lines = spark.range(n).select(F.lit(1).alias("page"), F.col("id").alias("idx"), (F.col("id") % 50 * 100.0).alias("x0"), (F.floor(F.col("id") / 50) * 20.0).alias("y0")).withColumns({"x1": F.col("x0") + 90, "y1": F.col("y0") + 12})
        spots = lines.select("page", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
        return R.overlapping(lines, spots, ["page"], [("x0", "x1", "b_x0", "b_x1"), ("y0", "y1", "b_y0", "b_y1")], Y.CELL)

    assert made(2_000).count() == 2_000 and made(20_000).count() == 20_000
    plan = made(20_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "cell_0" in plan and "Cross" not in plan


def test_languages_are_told_apart(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 60")
    known = L.profiles(docs.where("doc_id % 2 = 0"), "lang", "text")
    asked = docs.where("doc_id % 2 = 1")
    rows = L.detected(asked, "doc_id", "text", known).join(asked.select("doc_id", "lang"), "doc_id").collect()
    assert len({r.lang for r in rows}) >= 4 and sum(r.language == r.lang for r in rows) >= 0.97 * len(rows)


def test_texts_without_grams_have_no_language(spark):
    known = L.profiles(spark.createDataFrame([("a", "hello there"), ("b", "guten tag"), (None, "x y z")], "lang string, text string"), "lang", "text")
    asked = spark.createDataFrame([(1, "hello"), (2, "Guten  Tag"), (3, ""), (4, None), (5, "жж"), (6, "\U0001f600\U0001f600\U0001f600")], "k int, text string")
    assert {r.k: r.language for r in L.detected(asked, "k", "text", known).collect()} == {1: "a", 2: "b", 3: None, 4: None, 5: None, 6: None}
