"""Findings of round 4: tables with empty texts, and folders of more files than the driver can hold."""

import pickle

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.plans import catalog
from foliospark.sources import formats as S


def odd_documents(spark, folder, texts):
    """A table of documents with the given texts, and its rows for DuckDB."""
    rows = [(i, t, "en", "made", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return c


def both(spark, folder, duck, name):
    """The rows of a query and of its SQL, in the order of the SQL's columns."""
    want = duck.sql(catalog.ORACLES[name])
    return (sorted((tuple(x) for x in rows), key=repr) for rows in (catalog.QUERIES[name](spark, folder).select(*want.columns).collect(), want.fetchall()))


#: One of each of the suffixes and contents that the queries deal out is empty, and others are blank.
TEXTS = ["" if i % 7 < 3 else " \n" if i % 7 == 3 else f"  text {i}\n" for i in range(300)]


def test_parts_of_blank_texts(spark, tmp_path):
    duck = odd_documents(spark, str(tmp_path), [*TEXTS, None])
    got, want = both(spark, str(tmp_path), duck, "sc_02_body_parts")
    assert got == want and len(got) == 301


def test_empty_files_are_checked_and_read(spark, tmp_path):
    """A file without a byte is a file, and a text that is missing has none."""
    duck = odd_documents(spark, str(tmp_path), [*TEXTS, *[None] * 60])
    for name in ("snk_16_import_check", "src_01_files", "src_02_binary_files"):
        got, want = both(spark, str(tmp_path), duck, name)
        assert got == want, name


def names_of(n):
    return [f"{i % 5}/f{i}.txt" for i in range(n)]


def batch_of(names, content=b"text\n"):
    return pa.RecordBatch.from_pydict({"name": names, "content": [content] * len(names)})


def test_the_driver_is_told_folders_and_not_files(spark, tmp_path):
    """What tasks tell the commit, and what it tells readers, does not grow with the files of a folder."""
    sizes = []
    for n in (50, 5000):
        path = str(tmp_path / str(n))
        writer = S.FolioWriter({"path": path}, False)
        told = writer.write(iter([batch_of(names_of(n))]))
        writer.commit([told, None])
        parts = S.FolioReader({"path": path}).partitions()
        assert sum(len(b) for p in parts for b in S.FolioReader({"path": path}).read(p)) == n
        sizes.append((len(pickle.dumps(told)), len(pickle.dumps(parts))))
    assert sizes[1][0] <= sizes[0][0] + 20 and sizes[1][1] <= sizes[0][1] + 50


def test_a_folder_of_one_task_is_moved_by_one_rename(tmp_path, monkeypatch):
    """Only files of folders that several tasks share, or that are there already, are moved one by one."""
    moves, old = [], S._moved
    monkeypatch.setattr(S, "_moved", lambda at, pool, some: old(at, pool, (moves.append(x) or x for x in some)))
    writer = S.FolioWriter({"path": str(tmp_path)}, False)
    writer.commit([writer.write(iter([batch_of(["a/1.txt", "a/2.txt", "b/1.txt", "c/d/1.txt", "e/1.txt", "e/f/1.txt", "top.txt"])])), writer.write(iter([batch_of(["b/2.txt", "c/d/e/1.txt"])]))])
    assert len(moves) == 8  # of nine files, the two of a are moved as one
    writer = S.FolioWriter({"path": str(tmp_path)}, False)
    writer.commit([writer.write(iter([batch_of(["a/2.txt", "a/3.txt"], b"new\n")]))])
    assert len(moves) == 10 and (tmp_path / "a" / "1.txt").read_bytes() == b"text\n" and (tmp_path / "a" / "2.txt").read_bytes() == b"new\n"
    assert sorted(p.path.removeprefix(f"{tmp_path}/") for p in S.listed(str(tmp_path))) == ["a/1.txt", "a/2.txt", "a/3.txt", "b/1.txt", "b/2.txt", "c/d/1.txt", "c/d/e/1.txt", "e/1.txt", "e/f/1.txt", "top.txt"]


def test_names_given_twice_are_found_in_every_folder(tmp_path):
    for tasks in ([["x/1.txt", "x/1.txt"]], [["x/1.txt"], ["x/2.txt", "x/1.txt"]], [["1.txt"], ["1.txt"]], [["x/../1.txt"], ["1.txt"]]):
        writer = S.FolioWriter({"path": str(tmp_path)}, False)
        with pytest.raises(ValueError, match="more than once"):
            writer.commit([writer.write(iter([batch_of(names)])) for names in tasks])
    S.FolioWriter({"path": str(tmp_path)}, False).abort([])
    assert S.listed(str(tmp_path)) == []


def test_files_are_listed_by_tasks(spark, tmp_path):
    """Folders below folders, and empty files; hidden ones are left out. A partition begins and ends inside a folder."""
    path = str(tmp_path / "in")
    rows = [("a/b/1.txt", b"x"), ("a/2.TXT", b""), ("3.md", b"yz"), ("a.b/4", b"q")]
    S.write(spark.createDataFrame(rows, "name string, content binary"), path)
    (tmp_path / "in" / "a" / ".hidden").write_bytes(b"h")
    inside = lambda rows, *c: sorted((r.path.removeprefix(f"{path}/"), *(r[x] for x in c)) for r in rows.collect())
    assert inside(S.files(spark, path), "length") == sorted((n, len(c)) for n, c in rows)
    assert inside(S.files(spark, path, ".txt", ".md")) == [("3.md",), ("a/2.TXT",), ("a/b/1.txt",)]
    assert inside(S.contents(S.files(spark, path), path), "content") == sorted((n, bytearray(c)) for n, c in rows)
    assert inside(S.files(spark, f"{path}/3.md")) == [("3.md",)]


def test_partitions_divide_folders(tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PART", 20)
    writer = S.FolioWriter({"path": str(tmp_path)}, False)
    writer.commit([writer.write(iter([batch_of(names_of(50))]))])
    reader = S.FolioReader({"path": str(tmp_path)})
    parts = reader.partitions()
    got = [f.removeprefix(f"{tmp_path}/") for p in parts for b in reader.read(p) for f in b.column("file").to_pylist()]
    assert len(parts) == 13 and sorted(got) == sorted(names_of(50))


def test_conversion_keeps_folders(spark, tmp_path):
    """Files of the same name in two folders are two files."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    S.write(spark.createDataFrame([("a/1.txt", b"one"), ("b/1.txt", b"two"), ("b.c/1.md", b"# three")], "name string, content binary"), source)
    S.write(spark.createDataFrame([("b/1.docx", b"taken")], "name string, content binary"), target)
    told = {r.file: r.name for r in S.convert(spark, source, target, F.lit(".docx")).collect()}
    assert told == {"a/1.txt": "a/1.docx", "b/1.txt": "b/1.converted.docx", "b.c/1.md": "b.c/1.docx"}
    back = {r.file.removeprefix(f"{target}/"): r.text for r in S.read(spark, target).where("error IS NULL").collect()}
    assert back == {"a/1.docx": "one", "b/1.converted.docx": "two", "b.c/1.docx": "three"}


def test_listings_are_of_unknown_size(spark, tmp_path):
    """A listing is no small table before it has run: a join would send it through the driver."""
    (tmp_path / "1.txt").write_bytes(b"x")
    assert S.digests(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 1 << 40


def test_listings_are_not_broadcast(spark, tmp_path):
    """Not by the size of what is listed first either."""
    (tmp_path / "1.txt").write_bytes(b"x")
    joined = spark.createDataFrame([("1.txt",)], "file string").join(S.digests(spark, str(tmp_path)), "file", "left")
    assert joined.count() == 1 and "digest" in joined.columns
    plan = joined._jdf.queryExecution()
    assert "rightHint=(strategy=merge)" in plan.optimizedPlan().toString()
