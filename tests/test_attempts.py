"""Second attempts: what was missed is asked for again without background, each request once."""

from pyspark.sql import functions as F

from foliospark.functions import cleaning as C
from foliospark.operators import translate as R

SCHEMA = "k int, request string, bare string, source string, code string, previous array<string>, supplied boolean"


def test_second_attempts_only_where_the_first_missed(spark, tmp_path):
    log = str(tmp_path / "log")

    def model(text):
        with open(log, "a") as f:
            f.write(text + "\n")
        return {"ok": "Гладкий перевод.", "echo": "plain words here", "again": "Второй перевод.", "leak": "Было раньше. И ещё", "mixed": "Привет 漢字 мир и море"}.get(text.split("|")[-1], "")

    rows = [
        (1, "bg|ok", "ok", "plain words here", "ru", ["x"], True),
        (2, "bg|echo", "again", "plain words here", "ru", [], False),  # the source again: even without background
        (3, "bg|leak", "again", "other words", "ru", ["Было раньше."], True),
        (4, "bg|leak", "again", "other words", "ru", ["Было раньше."], False),  # nothing was supplied: stays
        (5, "bg|mixed", "again", "other words", "ru", [], False),  # a foreign script
        (6, "bg|none", "nothing", "other words", "ru", [], True),
        (7, "bg|ok", "ok", "plain words here", "ru", ["x"], True),
    ]
    got = {r.k: (r.output, r.attempts, r.error) for r in R.attempted(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert got[1] == got[7] == ("Гладкий перевод.", 1, None)
    assert got[2] == got[3] == got[5] == ("Второй перевод.", 2, None)
    assert got[4] == ("Было раньше. И ещё", 1, None)
    assert got[6] == ("", 2, "the answer is empty")
    asked = open(log).read().split("\n")
    assert asked.count("bg|ok") == 1 and asked.count("bg|leak") == 1 and asked.count("again") == 1


def test_pieces_of_prompt_and_earlier_answers_are_missed(spark):
    none = F.array().cast("array<string>")

    def one(text, previous=none):
        return spark.range(1).select(C.missed(F.lit(text), F.lit("source words"), F.lit("ru"), previous).alias("x")).first()["x"]

    assert not one("Обычный перевод.")
    for bad in ("", "Source  words", "*[Background]* текст", "Текст. Output the translation only.", "[Перевод]", "**Метка**", "English words"):
        assert one(bad), bad
    assert one("Прежний ответ и больше", F.array(F.lit("Прежний ответ"))) and not one("Новый", F.array(F.lit("Прежний ответ")))


def test_long_answers_are_cleaned_in_proportion(spark):
    import time

    def took(n):
        df = spark.range(4).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n").alias("t"), F.repeat(F.lit("word other "), F.lit(n)).alias("s")).cache()
        df.count()
        start = time.perf_counter()
        assert df.select(F.sum(F.length(C.without_echoed_source(F.col("t"), F.col("s"))))).first()[0] > 0
        return time.perf_counter() - start

    took(200)
    assert took(8000) < 8 * took(2000) + 0.5
