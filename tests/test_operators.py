"""Small fixtures for what SQL can't or doesn't show."""

import io
import threading
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.functions import answers as A
from foliospark.functions import cleaning as C
from foliospark.functions import scripts as S
from foliospark.operators import glossary as G
from foliospark.operators import layout as L
from foliospark.operators import prompts as Q
from foliospark.operators import segments as P
from foliospark.operators import state as D
from foliospark.operators import translate as R
from foliospark.operators import views as V
from foliospark.sources import importers as I
from foliospark.sources import sinks as K
from foliospark.streaming import tasks as ST


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_split_prefers_sentences_and_cjk_stops(spark):
    text = "Alpha beta gamma delta epsilon zeta eta theta iota. Kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi. Psi omega"
    parts = one(spark, P.split_text(F.lit(text), 80))
    assert "".join(parts) == text and parts[0].endswith("iota. ")
    cjk = "字" * 50 + "。" + "字" * 20 + ". word " + "字" * 60
    parts = one(spark, P.split_text(F.lit(cjk), 90))
    assert "".join(parts) == cjk and parts[0].endswith("。")
    assert one(spark, P.split_text(F.lit("x" * 500), 64)) == ["x" * 64] * 7 + ["x" * 52]
    assert one(spark, P.split_text(F.lit(""), 64)) == []


def test_plain_blocks_are_lossless(spark):
    text = "  one\r\n\r\n\ntwo \n \nthree\n"
    rows = P.plain_blocks(spark.createDataFrame([(1, text)], "document_id long, text string")).orderBy("ord").collect()
    assert "".join(r.prefix + r.text + r.suffix for r in rows) == text
    assert [r.kind for r in rows] == ["paragraph", "gap", "paragraph", "gap", "paragraph"]


def test_plain_blocks_keep_control_characters(spark):
    text = "a\u0001b\n\n\u0001c\u0001o\n\n\u0001"
    rows = P.plain_blocks(spark.createDataFrame([(1, text)], "document_id long, text string")).orderBy("ord").collect()
    assert "".join(r.prefix + r.text + r.suffix for r in rows) == text


def test_fences_with_text_open_code(spark):
    lines = ["intro", "```python", "x = 1", "```js", "```", "prose", "~~~", "```sh", "y", "  ```  ", "end", "```open", "z"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "document_id long, ord int, line string")
    got = {r.first_ord: (r.kind, r.n_lines) for r in P.markdown_blocks(df).collect()}
    assert got == {0: ("paragraph", 1), 1: ("code", 4), 5: ("paragraph", 1), 6: ("code", 4), 10: ("paragraph", 1), 11: ("code", 2)}


def test_archive_paths(spark):
    df = spark.createDataFrame([(1, "vol..1.txt", 1), (1, "a/b", 1), (1, "A/b", 1), (2, "a/../../x", 1), (3, "a/../b", 1), (3, "b", 1), (4, "\\x", 1), (5, "..", 1)], "archive long, name string, size long")
    got = {r.archive: r.rejected for r in V.archive_guard(df, 10, 10).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: True}


def test_terms_are_found_by_their_first_word(spark):
    df = spark.createDataFrame([(1, "The RIVER-bank, a river bank; riverbank"), (2, "go → there"), (3, "nothing")], "k int, text string")
    terms = spark.createDataFrame([(1, "river"), (2, "river bank"), (3, "→")], "id int, term string")
    assert sorted((r.k, r.id) for r in G.with_terms(df, "text", terms).collect()) == [(1, 1), (1, 2), (2, 3)]


def test_long_texts_split_and_clean_in_time(spark):
    text = "word other word, and more. " * 20_000
    parts = one(spark, P.split_text(F.lit(text), 1100))
    assert "".join(parts) == text
    assert len(one(spark, C.collapsed(F.lit("same same other " * 5_000)))) == len("same other " * 5_000) - 1


def test_answers_that_repeat_their_prompt(spark):
    for given, want in (
        ("", ""),
        ("Привет.", "Привет."),
        ("*[Background]*\nContext: x\n*[Source text]*\nПривет.", "Привет."),
        ("Привет.\nTranslation: другое", "Привет."),
        ("Привет. Story so far: he left.", "Привет."),
        ("Translate the text into ru", ""),
        ("**Очень важно.** Он ушёл", "**Очень важно.** Он ушёл"),
        ("[Перевод]\nПривет ##\n\nПока", "Привет\n\nПока"),
    ):
        assert one(spark, A.clean_output(F.lit(given))) == want, given


def test_prompt_has_no_empty_parts(spark):
    none = F.lit("")
    empty = (F.array().cast("array<string>"), F.array().cast("array<struct<source:string,target:string>>"))
    p = one(spark, Q.translation_prompt("general", F.lit("text"), F.lit("auto"), F.lit("ru"), none, none, none, *empty, F.lit(False), F.lit(1)))
    assert p["user"] == "text" and "Glossary" not in p["system"] and "Translate the text into ru." in p["system"]
    assert one(spark, Q.bare(F.lit("text"), F.lit("en"), F.lit("ru"))) == "Translate from en into ru. Output the translation only.\n\ntext"


def test_tables_are_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/registry"
    with pytest.raises(FileNotFoundError):
        K.current_table(spark, path)
    names = [K.replace_table(spark.range(n).coalesce(1), path) for n in (3, 5, 7)]
    assert K.current_table(spark, path).count() == 7 and K.current_table(spark, path, version=names[0]).count() == 3
    assert K.drop_versions(spark, path) == names[:1] and K.current_table(spark, path).count() == 7


def test_readers_never_miss_a_table(spark, tmp_path):
    path, failed, seen, stop = f"{tmp_path}/registry", [], set(), threading.Event()
    K.replace_table(spark.range(1).coalesce(1), path)

    def read():
        while not stop.is_set():
            try:
                seen.add(K.current_table(spark, path, "id long").count())
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 8):
        K.replace_table(spark.range(n).coalesce(1), path)
    stop.set()
    reader.join()
    assert not failed and len(seen) > 1 and seen <= set(range(1, 8))


def test_packs_keep_headings_and_lengths_apart(spark):
    rows = [(1, 0, 0, "h" * 20, "heading"), (1, 1, 0, "p" * 30, "paragraph"), (1, 2, 0, "p" * 200, "paragraph"), (1, 3, 0, "p" * 100, "paragraph"), (1, 4, 0, "p" * 100, "paragraph"), (1, 4, 1, "p" * 10, "paragraph")]
    df = spark.createDataFrame(rows, "task_id long, block_ord int, segment_ord int, source string, kind string")
    from foliospark.operators.views import whole_blocks

    got = {(r.block_ord, r.segment_ord): r.pack for r in P.packs(whole_blocks(df), 310).collect()}
    assert got == {(0, 0): 0, (1, 0): 1, (2, 0): 2, (3, 0): 2, (4, 0): 3, (4, 1): 4}


def test_terms_come_back(spark):
    text, marks = G.protect("The River and the river bank", [("river", "fluss"), ("river bank", "ufer"), ("", "x")])
    assert len(marks) == 2 and G.restore(text, marks) == "The fluss and the ufer"
    assert G.restore(text + next(iter(marks)), marks) is None


def test_cleaning(spark):
    run = lambda f, *a: one(spark, f(*[F.lit(x) for x in a]))
    assert run(C.without_reasoning, "<think>a</think> b<|end|>") == "b"
    assert run(C.unwrapped, "« so »") == "so" and run(C.unwrapped, '"a" and "b"') == '"a" and "b"'
    assert run(C.without_headers, "[Label]\nText") == "Text" and run(C.without_headers, "[Alone]") == "[Alone]"
    assert run(C.collapsed, "go Go go on") == "go on"
    assert run(C.without_echoed_source, "Hallo\nHello hello", "hello") == "Hallo"
    assert run(C.paired_quotes, 'a "b" c') == "a «b» c"
    assert run(S.intrusion, "Привет 漢字", "Hello", "ru") is True and run(S.fits, "Hello there", "ru") is False


def test_foreign_script_minority_goes(spark):
    df = spark.createDataFrame([("Привет мир 漢字 снова", "Hello", "ru"), ("漢字漢字", "Hello", "ru")], "o string, s string, c string")
    assert [r.x for r in S.with_foreign_removed(df, "o", "s", "c", "x").collect()] == ["Привет мир снова", "漢字漢字"]


def test_fragments_and_stitches(spark):
    lines = pd.DataFrame({"page": [1, 1, 1], "idx": [1, 2, 3], "text": ["a", "b", "c"], "x0": [0.0, 20.0, 0.0], "x1": [10.0, 30.0, 10.0], "baseline": [100.0, 101.0, 80.0]})
    got = L.merged_fragments(spark.createDataFrame(lines)).orderBy("line").collect()
    assert [r.text for r in got] == ["b", "a", "c"]  # by baseline first
    rows = spark.createDataFrame([(1, 0, 1, "It goes", True), (1, 1, 1, "on here.", False), (1, 2, 2, "New one", True)], "doc long, ord int, page int, text string, at_edge boolean")
    assert [r.anchor for r in L.stitched(rows).orderBy("ord").collect()] == [0, 0, 2]


def test_finish_keeps_edits(spark):
    old = spark.createDataFrame([(1, "mine", True), (2, "old", False)], "k int, text string, edited boolean").withColumn("updated_at", F.lit(1))
    new = spark.createDataFrame([(1, "new"), (2, "new"), (3, "new")], "k int, text string").withColumn("updated_at", F.lit(2))
    assert {r.k: (r.text, r.edited, r.updated_at) for r in D.finish(old, new, ["k"]).collect()} == {1: ("mine", True, 1), 2: ("new", False, 2), 3: ("new", False, 2)}


def test_retry_once(spark):
    df = spark.createDataFrame([(1, 0, "same", 1), (1, 1, "a b", 1)], "task_id long, pack int, request string, count int")
    assert {r.pack: r.attempts for r in R.call(df).collect()} == {0: 2, 1: 1}


def test_archives_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "heading", "Top & <all>"), (1, 1, "paragraph", "Text")], "document_id long, ord int, kind string, text string")
    for form in ("docx", "epub"):
        data = K.as_zip(rows, form).first()["content"]
        (tmp_path / f"a.{form}").write_bytes(bytes(data))
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../up", "x")
    (tmp_path / "bad.docx").write_bytes(bad.getvalue())
    got = I.import_archives(I.files(spark, str(tmp_path))).collect()
    by = {}
    for r in got:
        by.setdefault(r.file.rsplit("/", 1)[1], []).append(r)
    for name in ("a.docx", "a.epub"):
        assert [(r.kind, r.text) for r in sorted(by[name], key=lambda r: r.ord)] == [("heading", "Top & <all>"), ("paragraph", "Text")]
    assert by["bad.docx"][0].error.startswith("ValueError")


def test_decoding(spark):
    rows = spark.createDataFrame([(bytearray("привет".encode("cp1251")),), (bytearray(b"\xef\xbb\xbfabc"),)], "content binary")
    assert [(r.encoding, r.text) for r in I.decoded(rows, "content").collect()] == [("cp1251", "привет"), ("utf-8", "abc")]


def test_published_once(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, "complete"), (2, 1, "complete"), (3, 2, "running"), (4, 3, "complete")], "id long, task_id long, status string")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        events.write.mode("append").parquet(src)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
        ST.publish_once(stream, out, str(tmp_path / "cp"), lambda df: df).awaitTermination()
    assert sorted(r.task_id for r in spark.read.parquet(out).collect()) == [1, 3]


def test_idle_tasks(spark, tmp_path):
    rows = [(1, "running", "2026-01-01 00:00:00"), (2, "paused", "2026-01-01 00:00:00")]
    later = [(3, "running", "2026-01-01 01:00:00")]
    df = lambda r: spark.createDataFrame(r, "task_id long, status string, at string").select("task_id", "status", F.to_timestamp("at").alias("created_at"))
    src = str(tmp_path / "in")
    df(rows).coalesce(1).write.parquet(src)
    df(later).coalesce(1).write.mode("append").parquet(src)
    df([(4, "running", "2026-01-01 02:00:00")]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df(rows).schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {r.task_id for r in ST.run_to_table(ST.idle_tasks(stream), "append").collect()}
    assert 1 in got and 2 not in got
