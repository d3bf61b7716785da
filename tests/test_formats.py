"""The file data source, texts written back in place, and conversion."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark.sources import formats as S
from foliospark.sources import importers as I
from foliospark.sources import markup as M
from foliospark.sources import sinks as K


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 2, 3, 4, 6)), data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
BODY = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:document {W} custom=\'a>b\'><!-- kept --><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title &amp; more</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Hello</w:t></w:r><w:r><w:t xml:space="preserve"> world</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t/></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
CHAPTER = '<?xml version="1.0"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>no</title><style>p {}</style></head><body><h1 class="x">One&nbsp;&mdash; two</h1><p id="a>b">A <i>b</i><br/>c</p><ul><li>item <p>inner</p> tail</li></ul><p>  </p><pre><![CDATA[x<y]]></pre></body></html>'
BOOK = {
    "mimetype": "application/epub+zip",
    "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
    "OPS/book.opf": '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="text/one%20a.xhtml"/><item id="b" href="two.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>',
    "OPS/text/one a.xhtml": CHAPTER,
    "OPS/two.xhtml": "<html><body><p>broken<br>page</p></body></html>",
    "OPS/cover.png": bytes(range(256)),
}


def test_elements_stand_where_they_say():
    data = CHAPTER.encode()
    found = M.elements(data)
    assert [(e.name, e.text) for e in found] == [("h1", "One — two"), ("p", "A b\nc"), ("li", "item tail"), ("p", "inner"), ("pre", "x<y")]
    assert "".join(data[t.start : t.end].decode() for t in M.tokens(data)) == CHAPTER
    assert M.with_elements(data, {}) == data
    assert [e.text for e in M.elements(M.with_elements(data, {1: "n < m\nsecond", 3: "in", 4: "&"}))] == ["One — two", "n < m\nsecond", "item tail", "in", "&"]
    wide = CHAPTER.replace('"1.0"', '"1.0" encoding="UTF-16"').encode("utf-16")
    assert [e.text for e in M.elements(M.with_elements(wide, {3: "ж"}))][3] == "ж"


def test_paragraphs_change_in_place():
    new = M.with_paragraphs(BODY.encode(), {1: " a<b ", 2: "empty one", 3: "cell"}).decode()
    assert I.docx_blocks(zipped({"word/document.xml": new}))[1:] == [("section-1", "paragraph", " a<b ", "1"), ("section-1", "paragraph", "empty one", "2"), ("section-1", "paragraph", "cell", "3")]
    assert "<!-- kept -->" in new and "custom='a>b'" in new and "<w:rPr><w:b/></w:rPr>" in new and "Title &amp; more" in new
    assert M.with_paragraphs(BODY.encode(), {9: "nowhere"}) == BODY.encode()


def test_write_back_keeps_everything_else(spark):
    docx = zipped({"[Content_Types].xml": "<x/>", "word/document.xml": BODY, "word/media/a.bin": bytes(range(256))})
    files = spark.createDataFrame([("a.docx", docx), ("b.epub", zipped(BOOK)), ("same.epub", zipped(BOOK)), ("bad.docx", b"no zip"), ("c.odt", docx)], "path string, content binary")
    blocks = I.import_archives(files.where("path IN ('a.docx', 'b.epub')")).where("locator IS NOT NULL")
    texts = blocks.select(F.col("file").alias("path"), "locator", F.concat(F.lit("new "), "text").alias("text"))
    texts = texts.union(spark.createDataFrame([("a.docx", None, "x"), ("a.docx", "1", None), ("gone.docx", "1", "x")], "path string, locator string, text string"))
    done = {r.path: r for r in K.write_back(files, texts).collect()}
    assert done["bad.docx"].content is None and "BadZipFile" in done["bad.docx"].error and done["c.odt"].error
    assert I.epub_blocks(bytes(done["same.epub"].content)) == I.epub_blocks(zipped(BOOK))
    old, new = (zipfile.ZipFile(io.BytesIO(x)) for x in (zipped(BOOK), bytes(done["b.epub"].content)))
    assert [i.filename for i in old.infolist()] == [i.filename for i in new.infolist()]
    assert [i.date_time for i in old.infolist()] == [i.date_time for i in new.infolist()]
    assert all(old.read(n) == new.read(n) for n in BOOK if n != "OPS/text/one a.xhtml")
    assert [t for _, _, t, _ in I.epub_blocks(bytes(done["b.epub"].content))] == ["broken\npage", "new One — two", "new A b\nc", "new item tail", "new inner", "new x<y"]
    assert [t for _, _, t, _ in I.docx_blocks(bytes(done["a.docx"].content))] == ["new Title & more", "new Hello world"]


def files_of(spark, names, content=b"text\n"):
    return spark.createDataFrame([(n, content) for n in names], "name string, content binary").repartition(4)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    S.write(files_of(spark, [f"f{i}.txt" for i in range(40)]), path)
    before = sorted(str(p) for p in tmp_path.rglob("*"))
    assert len([p for p in before if p.endswith(".txt")]) == 40
    for bad in (["../x.txt"], [".hidden"], ["same.txt", "same.txt"]):
        with pytest.raises(Exception):  # noqa: B017
            S.write(files_of(spark, [*[f"g{i}.txt" for i in range(40)], *bad]), path)
        assert sorted(str(p) for p in tmp_path.rglob("*")) == before
    with pytest.raises(Exception, match="name"):
        spark.range(1).write.format("folio").mode("append").save(path)
    S.write(files_of(spark, ["f1.txt", "sub/new.md"], b"# h\n\np\n"), path)
    assert len(S.listed(path)) == 41
    S.write(files_of(spark, ["only.md"], b"x"), path, "overwrite")
    assert [f.path.rpartition("/")[2] for f in S.listed(path)] == ["only.md"]


def test_files_are_read_by_their_suffix(spark, tmp_path):
    given = {
        "a.txt": " one\r\ntwo\r\n\r\n \nthree".encode(),
        "b.md": "intro\n# Head #1\ntext\nmore\n```sh\n# code\n\n```\nend".encode(),
        "c.docx": zipped({"word/document.xml": BODY}),
        "d.epub": zipped(BOOK),
        "e.txt": "Привет".encode("cp1251"),
        "f.docx": b"broken",
        "g.pdf": b"%PDF",
        "h.txt": b"",
        "i.epub": zipped({"../out": "x"}),
    }
    rows = spark.createDataFrame(list(given.items()), "name string, content binary")
    S.write(rows, str(tmp_path))
    S.register(spark)
    got = {}
    for r in spark.read.format("folio").load(str(tmp_path)).orderBy("file", "ord").collect():
        got.setdefault(r.file.rpartition("/")[2], []).append((r.kind, r.text) if r.error is None else r.error.partition(":")[0])
    assert got["a.txt"] == [("paragraph", "one\ntwo"), ("paragraph", "three")]
    assert got["b.md"] == [("paragraph", "intro"), ("heading", "Head #1"), ("paragraph", "text\nmore"), ("code", "```sh\n# code\n\n```"), ("paragraph", "end")]
    assert got["c.docx"] == [("heading", "Title & more"), ("paragraph", "Hello world")]
    assert got["e.txt"] == [("paragraph", "Привет")] and "h.txt" not in got
    assert got["f.docx"] == ["BadZipFile"] and got["g.pdf"] == ["ValueError"] and got["i.epub"] == ["ValueError"]
    assert {r.file.rpartition("/")[2] for r in S.read(spark, str(tmp_path), ".md", ".txt").collect()} == {"a.txt", "b.md", "e.txt"}


def test_conversion_finds_free_names_and_leaves_sources(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    S.write(spark.createDataFrame([("a.txt", b"one\n\ntwo"), ("a.md", b"# h\n\nx"), ("bad.docx", b"?")], "name string, content binary"), source)
    S.write(spark.createDataFrame([("a.epub", b"taken")], "name string, content binary"), target)
    told = {r.file: (r.name, r.error) for r in S.convert(spark, source, target, F.lit(".epub")).collect()}
    assert sorted(n for n, _ in (told["a.txt"], told["a.md"])) == ["a.converted-2.epub", "a.converted.epub"]
    assert told["bad.docx"][0] is None and told["bad.docx"][1]
    back = {r.file.rpartition("/")[2]: 1 for r in S.read(spark, target).where("error IS NULL").collect()}
    assert set(back) == {"a.converted.epub", "a.converted-2.epub"}
    assert (tmp_path / "in" / "a.txt").read_bytes() == b"one\n\ntwo" and (tmp_path / "out" / "a.epub").read_bytes() == b"taken"


def test_page_headings_are_left_out_of_texts(spark):
    rows = [(1, 0, "heading", "Страница 12", None), (1, 1, "paragraph", "a", None), (1, 2, "heading", "Страница 7", "kept"), (1, 3, "heading", "Страница x", None)]
    df = spark.createDataFrame(rows, "document_id long, ord int, kind string, text string, locator string").withColumns({"final": F.col("text"), "prefix": F.lit(""), "suffix": F.lit("\n"), "section": F.lit(1), "section_title": F.lit("")})
    assert K.as_text(df).first()["body"] == "a\nСтраница 7\nСтраница x\n"
    assert K.as_markdown(df).first()["body"] == "a\n# Страница 7\n# Страница x\n"


def test_blocks_of_pages(spark):
    page = "<html><head><title>t</title></head><body>lead <b>in</b><h2>One&amp;two</h2><p>a<br>b  c<script>x</script></p><ul><li>i<p>ii</p>iii</li></ul><table><tr><td>x</td><td> </td></tr></table><h3>End</h3>tail"
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>")], "page_id long, html string")
    got = [(r.page_id, r.ord, r.section, r.kind, r.text) for r in I.page_blocks(rows).orderBy("page_id", "ord").collect()]
    want = [("main", "paragraph", "lead in"), ("section-1", "heading", "One&two"), ("section-1", "paragraph", "a\nb c"), ("section-1", "paragraph", "i"), ("section-1", "paragraph", "ii"), ("section-1", "paragraph", "iii"), ("section-1", "paragraph", "x"), ("section-2", "heading", "End"), ("section-2", "paragraph", "tail")]
    assert got == [(1, i, *x) for i, x in enumerate(want)]
