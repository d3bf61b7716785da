"""Exports as text columns, and the writers that put them into files."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.views import strip
from foliospark.sources.batches import map_files
from foliospark.sources.importers import guarded
from foliospark.sources.markup import with_elements, with_paragraphs


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def pieces(translated: DataFrame) -> DataFrame:
    """document_id, ord, kind, text of what is exported: no gaps, no blanks."""
    return translated.where((F.col("kind") != "gap") & (strip("final") != "")).select("document_id", "ord", F.when(F.col("kind") == "heading", "heading").otherwise("paragraph").alias("kind"), strip("final").alias("text"))


def _ordered(rows: DataFrame, item: Column, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"]), between)


def _blank(c: Column) -> Column:
    return c.rlike(r"(?U)^\s$")


def _separated(rows: DataFrame, piece: Column, order: Window) -> DataFrame:
    """rows with ``item``: the piece, after a blank line where neither it nor the piece before has white space there."""
    given = rows.withColumn("piece", piece)
    before = F.right(F.lag("piece").over(order), F.lit(1))
    gap = (before != "") & (F.col("piece") != "") & ~_blank(before) & ~_blank(F.left("piece", F.lit(1)))
    return given.withColumn("item", F.concat(F.when(gap, "\n\n").otherwise(""), "piece"))


#: Fixed value: the heading that an importer of pages puts before each of them.
PAGE_MARKER = r"(?U)^\s*Страница \d+\s*$"


def _unmarked(blocks: DataFrame) -> DataFrame:
    """Blocks without the page headings that an importer has added: those have no place in the source."""
    if not {"kind", "text"} <= set(blocks.columns):
        return blocks
    placed = F.col("locator").isNotNull() if "locator" in blocks.columns else F.lit(False)
    return blocks.where(~F.coalesce((F.col("kind") == "heading") & ~placed & F.col("text").rlike(PAGE_MARKER), F.lit(False)))


def as_text(blocks: DataFrame) -> DataFrame:
    """Bodies of all blocks (document_id, ord, prefix, final, suffix): gaps, code and white space as they are, no page headings."""
    order = Window.partitionBy("document_id").orderBy("ord")
    rows = _separated(_unmarked(blocks), F.concat("prefix", "final", "suffix"), order)
    return rows.groupBy("document_id").agg(_ordered(rows, F.col("item"), "").alias("body"))


def as_markdown(blocks: DataFrame) -> DataFrame:
    """Bodies of all blocks (with kind, section, section_title): headings keep their marks or get one, and a section that begins
    without its heading gets its title."""
    order = Window.partitionBy("document_id").orderBy("ord")
    heading = F.col("kind") == "heading"
    mark = F.when(F.ltrim("prefix").startswith("#"), F.col("prefix")).otherwise("# ")
    titled = F.concat(mark, strip("final"), F.when(F.col("suffix") == "", "\n").otherwise(F.col("suffix")))
    first = ~heading & (F.col("section_title") != "") & ~F.coalesce(F.lag("section").over(order) == F.col("section"), F.lit(False))
    plain = F.concat("prefix", "final", "suffix")
    marked = _unmarked(blocks).withColumn("title_line", F.when(first, F.concat(F.lit("## "), "section_title", F.lit("\n\n"))).otherwise(""))
    rows = _separated(marked, F.when(heading, titled).otherwise(plain), order)
    ends = F.coalesce(F.lag("piece").over(order), F.lit(""))
    lead = F.when((F.col("title_line") != "") & (ends != "") & ~F.endswith(ends, F.lit("\n\n")), "\n\n").otherwise("")
    item = F.when(heading, F.col("piece")).when(F.col("title_line") != "", F.concat(F.col("lead"), "title_line", "piece")).otherwise(F.col("item"))
    rows = rows.withColumn("lead", lead).withColumn("line", item)
    return rows.groupBy("document_id").agg(_ordered(rows, F.col("line"), "").alias("body"))


def _marked_up(text: Column, between: str) -> Column:
    """Escaped lines with a mark between them."""
    return F.regexp_replace(escaped(text), r"\r\n|\n|\r", between)


def as_html(rows: DataFrame) -> DataFrame:
    """Pages with the document's title (column title) at the top."""
    head = F.col("kind") == "heading"
    item = F.concat(F.when(head, "<h2>").otherwise("<p>"), _marked_up(F.col("text"), "<br>\n"), F.when(head, "</h2>").otherwise("</p>"))
    title = escaped(F.max("title"))
    page = F.concat(F.lit('<!DOCTYPE html>\n<html lang="und">\n<head>\n<meta charset="utf-8">\n<title>'), title, F.lit("</title>\n</head>\n<body>\n<article><h1>"), title, F.lit("</h1>\n"), _ordered(rows, item, "\n"), F.lit("\n</article>\n</body>\n</html>\n"))
    return rows.groupBy("document_id").agg(page.alias("body"))


#: Fixed value: the name space of the format.
FICTION_BOOK = "http://www.gribuser.ru/xml/fictionbook/2.0"


def as_fictionbook(rows: DataFrame) -> DataFrame:
    """Books with the document's title; sections begin at headings, and what stands before the first one has the book's title."""
    head = F.col("kind") == "heading"
    numbered = rows.withColumn("section", F.sum(head.cast("int")).over(Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    para = F.array_sort(F.collect_list(F.when(~head, F.struct("ord", F.concat(F.lit("<p>"), escaped(F.col("text")), F.lit("</p>")).alias("item")))))
    paras = F.array_join(F.transform(para, lambda x: x["item"]), "")
    title = F.coalesce(F.max(F.when(head, escaped(F.col("text")))), escaped(F.max("title")))
    one = numbered.groupBy("document_id", "section").agg(F.max("title").alias("title"), F.concat(F.lit("<section><title><p>"), title, F.lit("</p></title>"), F.when(paras == "", "<p></p>").otherwise(paras), F.lit("</section>")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "x"))), lambda v: v["x"]), "")
    start = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<FictionBook xmlns="{FICTION_BOOK}">\n<description><title-info>\n<book-title>'), escaped(F.max("title")), F.lit("</book-title>\n<lang>und</lang>\n</title-info></description>\n<body>"))
    return one.groupBy("document_id").agg(F.count("*").alias("sections"), F.concat(start, body, F.lit("</body>\n</FictionBook>\n")).alias("body"))


def as_json(rows: DataFrame) -> DataFrame:
    """Trees with the document's title, the format it came in (column format) and its pieces."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind", "text"))), lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text")))
    return rows.groupBy("document_id").agg(F.to_json(F.struct(F.max("title").alias("title"), F.max("format").alias("sourceFormat"), blocks.alias("blocks"))).alias("body"))


def block_trees(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("document_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("ord", "kind", "text"))).alias("blocks"))).alias("tree"))


def blocks_from_trees(trees: DataFrame) -> DataFrame:
    kind = "blocks array<struct<ord:int,kind:string,text:string>>"
    return trees.select("document_id", F.explode(F.from_json("tree", kind)["blocks"]).alias("b")).select("document_id", "b.*")


def _rtf(text: str) -> str:
    out = []
    for c in text:
        n = ord(c)
        if c == "\n":
            out.append("\\line ")
        elif c in "\\{}":
            out.append("\\" + c)
        elif n < 128:
            out.append(c)
        else:  # units of UTF-16, signed
            for i in range(0, len(u := c.encode("utf-16-le")), 2):
                unit = int.from_bytes(u[i : i + 2], "little")
                out.append(f"\\u{unit - 65536 if unit > 32767 else unit}?")
    return "".join(out)


def as_rtf(rows: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def rtf(texts: pd.Series) -> pd.Series:
        return texts.map(_rtf)

    bold = lambda size, c: F.concat(F.lit(f"\\fs{size}\\b "), c, F.lit("\\b0\\fs22\\par "))
    item = F.when(F.col("kind") == "heading", bold(28, F.col("r"))).otherwise(F.concat("r", F.lit("\\par ")))
    escaped_rows = rows.withColumns({"r": rtf("text"), "rtf_title": rtf("title")})
    title = F.when(F.max("title") != "", bold(32, F.max("rtf_title"))).otherwise("")
    return escaped_rows.groupBy("document_id").agg(F.concat(F.lit("{\\rtf1\\ansi\\uc1\\fs22 "), title, _ordered(escaped_rows, item, ""), F.lit("}")).alias("body"))


def _xml(x: str) -> str:
    return x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _odt(items: list[tuple[str, str]], title: str = "") -> dict[str, str]:
    lines = lambda t: "<text:line-break/>".join(_xml(x) for x in t.split("\n"))
    body = f'<text:h text:outline-level="1">{_xml(title)}</text:h>' + "".join(f'<text:h text:outline-level="2">{lines(t)}</text:h>' if k == "heading" else f"<text:p>{lines(t)}</text:p>" for k, t in items)
    names = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    content = f'<?xml version="1.0" encoding="UTF-8"?><office:document-content {names}><office:body><office:text>{body}</office:text></office:body></office:document-content>'
    manifest = '<?xml version="1.0" encoding="UTF-8"?><manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return {"mimetype": "application/vnd.oasis.opendocument.text", "META-INF/manifest.xml": manifest, "content.xml": content}


def _docx(items: list[tuple[str, str]], title: str = "") -> dict[str, str]:
    style = '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>'
    body = "".join(f'<w:p>{style if k == "heading" else ""}<w:r><w:t xml:space="preserve">{_xml(t)}</w:t></w:r></w:p>' for k, t in items)
    return {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }


def _epub(items: list[tuple[str, str]], title: str = "") -> dict[str, str]:
    body = "".join(f"<h2>{_xml(t)}</h2>" if k == "heading" else f"<p>{_xml(t)}</p>" for k, t in items)
    return {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "book.opf": '<?xml version="1.0"?><package version="3.0" xmlns="http://www.idpf.org/2007/opf"><manifest><item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c1"/></spine></package>',
        "c1.xhtml": f'<?xml version="1.0" encoding="UTF-8"?><html xmlns="http://www.w3.org/1999/xhtml"><body>{body}</body></html>',
    }


def as_zip(rows: DataFrame, form: str) -> DataFrame:
    """document_id, members, content: a zipped file for each document (odt, docx or epub); its title is in column title, if there is one."""
    make = {"odt": _odt, "docx": _docx, "epub": _epub}[form]
    docs = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "text"))).alias("items"), (F.max("title") if "title" in rows.columns else F.lit("")).alias("title"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, items, title in zip(b["document_id"], b["items"], b["title"], strict=True):
                members = make([(x["kind"], x["text"]) for x in items], title)
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    for name, text in members.items():
                        z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
                out.append((doc, len(members), data.getvalue()))
            yield pd.DataFrame(out, columns=["document_id", "members", "content"])

    return map_files(docs, run, f"document_id {dict(rows.dtypes)['document_id']}, members int, content binary")


def versioned(exports: DataFrame) -> DataFrame:
    """exports with a file name of stem, language and time; names taken in the same second get a number."""
    n = F.row_number().over(Window.partitionBy("document_id", "target_lang", "created_at", "format").orderBy("id"))
    return exports.withColumn("name", F.concat(F.lit("file-"), F.col("document_id").cast("string"), F.lit("."), "target_lang", F.lit("."), F.date_format("created_at", "yyyyMMdd-HHmmss"), F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit("."), "format"))


def write_texts(bodies: DataFrame, path: str, key: str = "document_id") -> None:
    """One folder of text for each key, through Spark's own commit protocol."""
    bodies.select(key, F.col("body").alias("value")).write.partitionBy(key).mode("overwrite").text(path)


def converted(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """rows (id, stem, format) with a free name each: stem and suffix, or if that is taken (stem, format) or given away
    already, .converted and then .converted-2 and so on before the suffix."""
    n = F.row_number().over(Window.partitionBy("stem", "format").orderBy("id"))
    used = rows.withColumn("n", n).join(taken.select("stem", "format", F.lit(1).alias("own")), ["stem", "format"], "left")
    place = F.col("n") - F.when(F.col("own").isNull(), 1).otherwise(0)
    mark = F.when(place == 0, "").when(place == 1, ".converted").otherwise(F.concat(F.lit(".converted-"), place.cast("string")))
    return used.select("id", F.concat("stem", mark, F.lit("."), "format").alias("name"))


def _folders(spark, path: str) -> tuple:
    """The file system of a table's folder, and the names of its versions in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return system, sorted(n for n in found if n.startswith("version="))


def replace_table(rows: DataFrame, path: str) -> str:
    """Replace a small table as a whole: a new version is written under a hidden name and put in place by one rename. Whoever
    reads an earlier one goes on reading it; of two writers at once the one with the greater name is read. Gives the version's name."""
    spark = rows.sparkSession
    files, staged = spark._jvm.org.apache.hadoop.fs, f"{path}/.{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    system, names = _folders(spark, path)
    last = int(names[-1].split("=")[1].split("-")[0]) if names else 0
    name = f"version={last + 1:012d}-{uuid.uuid4().hex[:8]}"
    if not system.rename(files.Path(staged), files.Path(f"{path}/{name}")):
        raise OSError(f"{path} could not be replaced")
    return name


def current_table(spark, path: str, schema=None, version: str | None = None) -> DataFrame:
    """The newest version of a table, or the one that is named."""
    name = version or next(iter(reversed(_folders(spark, path)[1])), None)
    if name is None:
        raise FileNotFoundError(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/{name}")


def drop_versions(spark, path: str, keep: int = 2) -> list[str]:
    """Deletes all but the newest versions; readers of those have to be done by then. Gives the names that are gone."""
    system, names = _folders(spark, path)
    gone = names[: max(0, len(names) - max(1, keep))]
    for n in gone:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"), True)
    return gone


def _bytes(bodies: DataFrame) -> DataFrame:
    return bodies.select("document_id", F.encode("body", "UTF-8").alias("content"))


def _plain_body(rows: DataFrame) -> DataFrame:
    return _bytes(as_text(rows.withColumns({"prefix": F.lit(""), "suffix": F.lit(""), "final": F.col("text")})))


def _marked_body(rows: DataFrame) -> DataFrame:
    whole = rows.withColumns({"prefix": F.lit(""), "suffix": F.lit("\n\n"), "final": F.col("text"), "section": F.lit(0), "section_title": F.lit("")})
    return _bytes(as_markdown(whole))


#: What makes a file's bytes (document_id, content) of pieces (document_id, ord, kind, text, title, format), by suffix.
WRITERS = {
    ".txt": _plain_body,
    ".md": _marked_body,
    ".markdown": _marked_body,
    ".html": lambda rows: _bytes(as_html(rows)),
    ".rtf": lambda rows: _bytes(as_rtf(rows)),
    ".fb2": lambda rows: _bytes(as_fictionbook(rows)),
    ".json": lambda rows: _bytes(as_json(rows)),
    ".odt": lambda rows: as_zip(rows, "odt"),
    ".docx": lambda rows: as_zip(rows, "docx"),
    ".epub": lambda rows: as_zip(rows, "epub"),
}
#: Suffixes that are known and can't be written here: pages need a renderer.
UNWRITTEN = (".pdf",)


def exported(pieces_: DataFrame, suffixes: tuple[str, ...] = tuple(WRITERS)) -> DataFrame:
    """document_id, suffix, content of documents by their column ``suffix``; those that nothing writes are left out (see ``refused``)."""
    made = None
    for suffix in suffixes:
        one = WRITERS[suffix](pieces_.where(F.col("suffix") == suffix)).select("document_id", F.lit(suffix).alias("suffix"), "content")
        made = one if made is None else made.unionByName(one)
    return made


def refused(docs: DataFrame) -> DataFrame:
    """Documents (document_id, suffix) whose suffix nothing writes, and why."""
    known = F.col("suffix").isin(*UNWRITTEN)
    return docs.where(~F.coalesce(F.col("suffix").isin(*WRITERS), F.lit(False))).select("document_id", "suffix", F.when(known, "needs a renderer").otherwise("no such format").alias("error"))


def write_back(originals: DataFrame, translations: DataFrame) -> DataFrame:
    """path, content, error of word-processor files and e-books (path, content) whose texts (path, locator, text) are changed in
    place. Every other member, and every other byte of a changed one, is as it was. A file that can't be
    rewritten has an error and no content; one without translations stays as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content, texts in zip(b["path"], b["content"], b["texts"], strict=True):
                try:
                    out.append((path, rewritten(path, bytes(content), [(x["locator"], x["text"]) for x in (() if texts is None else texts)]), None))
                except Exception as e:  # noqa: BLE001  one bad file must not stop the others
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "content", "error"])

    told = translations.groupBy("path").agg(F.collect_list(F.struct("locator", "text")).alias("texts"))
    return map_files(originals.select("path", "content").join(told, "path", "left"), run, "path string, content binary, error string")


def rewritten(path: str, content: bytes, texts: list[tuple[str, str]]) -> bytes:
    """An archive whose texts at the locators are changed, member by member."""
    word = path.lower().endswith(".docx")
    if not word and not path.lower().endswith(".epub"):
        raise ValueError("only .docx and .epub can be written back")
    by: dict[str, dict[int, str]] = {}
    for locator, text in texts:
        if locator is not None and text is not None:
            member, _, place = ("word/document.xml", "", locator) if word else locator.rpartition(":")
            by.setdefault(member, {})[int(place)] = text
    out, change = io.BytesIO(), with_paragraphs if word else with_elements
    with guarded(content) as old, zipfile.ZipFile(out, "w") as new:
        for item in old.infolist():
            data = old.read(item)
            same = zipfile.ZipInfo(item.filename, item.date_time)
            same.compress_type, same.external_attr, same.comment = item.compress_type, item.external_attr, item.comment
            new.writestr(same, change(data, by[item.filename]) if item.filename in by else data)
        new.comment = old.comment
    return out.getvalue()
