"""Importers of files: text, word-processor and e-book archives, and marked-up pages, as ordered blocks.

Only the standard library is at hand: PDF files and text recognition are named as unsupported.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from posixpath import dirname, join, normpath
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree
from xml.parsers.expat import ExpatError

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.batches import map_files, portions
from foliospark.sources.markup import BLOCKS as TEXT_BLOCKS
from foliospark.sources.markup import SKIPPED, elements, utf8

SUFFIXES = (".txt", ".md", ".markdown", ".docx", ".epub", ".pdf")
#: The largest file, and the most members and unpacked bytes of an archive.
LARGEST, MEMBERS, UNPACKED = 512 << 20, 20_000, 512 << 20
BLOCKS = "file string, ord int, section string, kind string, text string, locator string, error string"
#: Bytes that a block counts for besides its text.
ROW = 200


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def routes(rows: DataFrame) -> DataFrame:
    """rows with the suffix of their name and whether they can be read."""
    suffix = F.regexp_extract(F.lower("name"), r"(\.[a-z]+)$", 1)
    return rows.withColumn("suffix", suffix).withColumn("supported", F.col("suffix").isin(*SUFFIXES) & (F.col("length") <= LARGEST))


#: The upper half of CP1251 as Latin-1 reads its bytes, and what they stand for; one byte stands for nothing.
_UPPER = [b for b in range(0x80, 0x100) if b != 0x98]
LATIN_1, CP1251, NO_SIGN = "".join(map(chr, _UPPER)), bytes(_UPPER).decode("cp1251"), "\x98"


def decoded(rows: DataFrame, content: str) -> DataFrame:
    """rows with ``encoding`` and ``text``: UTF-8 without its mark, else CP1251, else null."""
    raw = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.expr(f"substring({content}, 4)")).otherwise(F.col(content))
    valid = F.is_valid_utf8(raw.cast("string"))
    signs = F.decode(content, "ISO-8859-1")
    cyrillic = F.when(~F.contains(signs, F.lit(NO_SIGN)), F.translate(signs, LATIN_1, CP1251))
    return rows.withColumn("text", F.when(valid, raw.cast("string")).otherwise(cyrillic)).withColumn("encoding", F.when(valid, "utf-8").when(F.col("text").isNotNull(), "cp1251"))


def guarded(data: bytes) -> zipfile.ZipFile:
    """An archive whose members are few, small and stay inside; else an error."""
    z = zipfile.ZipFile(io.BytesIO(data))
    infos = z.infolist()
    names = [normpath(i.filename.replace("\\", "/")) for i in infos]
    if len(infos) > MEMBERS or sum(i.file_size for i in infos) > UNPACKED or len(set(names)) < len(names):
        raise ValueError("archive too large or with repeated names")
    if any(n.startswith(("/", "..")) or "\0" in n for n in names):
        raise ValueError("archive member outside its folder")
    return z


def docx_blocks(data: bytes) -> list[tuple[str, str, str, str]]:
    """(section, kind, text, locator) of paragraphs in body order, those of table cells too."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(guarded(data).read("word/document.xml"))
    out, section = [], 0
    for n, p in enumerate(root.iter(f"{w}p")):
        text = "".join("\n" if e.tag == f"{w}br" else "\t" if e.tag == f"{w}tab" else (e.text or "") for e in p.iter() if e.tag in (f"{w}t", f"{w}br", f"{w}tab"))
        if not text.strip():
            continue
        style = p.find(f"{w}pPr/{w}pStyle")
        name = (style.get(f"{w}val") or "").lower() if style is not None else ""
        heading = name.startswith("heading") or name == "title"
        section += heading
        out.append((f"section-{section}" if section else "main", "heading" if heading else "paragraph", text, str(n)))
    return out


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, str, str]] = []
        self.text: list[str] = []
        self.tag, self.skipped, self.section, self.place = "", 0, 0, 0

    def flush(self) -> None:
        text = "\n".join(" ".join(x.split()) for x in "".join(self.text).split("\n")).strip()
        self.text = []
        if text:
            heading = self.tag[:1] == "h" and self.tag[1:].isdigit()
            self.section += heading
            self.out.append((f"section-{self.section}" if self.section else "main", "heading" if heading else "paragraph", text, str(self.place)))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.place += 1
        if tag in SKIPPED:
            self.skipped += 1
        elif tag in TEXT_BLOCKS or tag in ("div", "section", "article", "body", "ul", "ol", "table", "tr"):
            self.flush()
            self.tag = tag
        elif tag == "br":
            self.text.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag in TEXT_BLOCKS:
            self.flush()
            self.tag = ""

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.text.append(data.replace("\n", " "))


def html_blocks(html: str) -> list[tuple[str, str, str, str]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.out


def chapter_blocks(data: bytes, name: str) -> list[tuple[str, str, str, str | None]]:
    """Blocks of a chapter with the numbers of their elements; one that isn't well-formed is read as a page, without them."""
    try:
        found = elements(utf8(data))
    except ExpatError:
        return [(f"{name}#{s}", k, t, None) for s, k, t, _ in html_blocks(data.decode("utf-8", "replace"))]
    out, section = [], 0
    for n, e in enumerate(found):
        heading = e.name[0] == "h" and e.name[1:].isdigit()
        section += heading
        out.append((f"{name}#section-{section}" if section else f"{name}#main", "heading" if heading else "paragraph", e.text, f"{name}:{n}"))
    return out


def epub_blocks(data: bytes) -> list[tuple[str, str, str, str | None]]:
    """Blocks of the chapters in the order of the spine; locators are file and element."""
    z = guarded(data)
    book = ElementTree.fromstring(z.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
    package = ElementTree.fromstring(z.read(book))
    items = {i.get("id"): i.get("href") for i in package.iter("{http://www.idpf.org/2007/opf}item")}
    out = []
    for ref in package.iter("{http://www.idpf.org/2007/opf}itemref"):
        name = normpath(join(dirname(book), unquote(urlsplit(items[ref.get("idref")]).path)))
        out += chapter_blocks(z.read(name), name)
    return out


def odt_blocks(data: bytes) -> list[tuple[str, str, str, str]]:
    """Headings and paragraphs of a text document in order, the document's title first."""
    x = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
    out, section = [], 0
    for n, e in enumerate(e for e in ElementTree.fromstring(guarded(data).read("content.xml")).iter() if e.tag in (f"{x}h", f"{x}p")):
        text = (e.text or "") + "".join(("\n" if c.tag == f"{x}line-break" else "".join(c.itertext())) + (c.tail or "") for c in e)
        if text.strip():
            section += e.tag == f"{x}h"
            out.append((f"section-{section}" if section else "main", "heading" if e.tag == f"{x}h" else "paragraph", text, str(n)))
    return out


def text_of(data: bytes) -> str:
    """A text file's characters: UTF-8 with or without its mark, else CP1251."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1251")


def text_blocks(data: bytes) -> list[tuple[str, str, str, str]]:
    """Paragraphs of a text file, which blank lines part; locators are the first characters' places."""
    return [("main", "paragraph", m[0].strip(), str(m.start())) for m in re.finditer(r"(?:^(?![^\S\n]*$).*\n?)+", text_of(data).replace("\r\n", "\n"), re.M)]


def marked_blocks(data: bytes) -> list[tuple[str, str, str, str]]:
    """Headings (lines with # marks) and paragraphs of a file with marks; a fence's lines are one block of code."""
    out, held, section, fence, kind = [], [], 0, "", "paragraph"

    def close() -> None:
        nonlocal held
        text = "\n".join(held).strip() if kind == "paragraph" else "\n".join(held)
        if text:
            out.append((f"section-{section}" if section else "main", kind, text, str(place)))
        held = []

    place = 0
    for n, line in enumerate(text_of(data).replace("\r\n", "\n").split("\n")):
        mark = line.lstrip()[:3]
        if fence:
            held.append(line)
            if line.strip() == fence:
                close()
                fence, kind = "", "paragraph"
        elif mark in ("```", "~~~"):
            close()
            fence, kind, held, place = mark, "code", [line], n
        elif found := re.match(r"\s{0,3}#{1,6}\s+(.*)", line):
            close()
            section, place = section + 1, n
            out.append((f"section-{section}", "heading", found[1].strip(), str(n)))
        elif line.strip():
            place = place if held else n
            held.append(line)
        else:
            close()
    close()
    return out


#: Readers of a file's bytes by suffix: (section, kind, text, locator) in order.
READERS: dict[str, Callable[[bytes], list[tuple]]] = {".txt": text_blocks, ".md": marked_blocks, ".markdown": marked_blocks, ".docx": docx_blocks, ".epub": epub_blocks, ".odt": odt_blocks}


def file_blocks(path: str, content: bytes) -> list[tuple]:
    """Rows of BLOCKS of a file; one that can't be read is a row with an error."""
    try:
        if len(content) > LARGEST:
            raise ValueError("file too large")
        suffix = path[path.rfind(".") :].lower() if "." in path.rpartition("/")[2] else ""
        if suffix not in READERS:
            raise ValueError(f"no reader of {suffix or 'files without suffix'}")
        return [(path, i, *x, None) for i, x in enumerate(READERS[suffix](content))]
    except Exception as e:  # noqa: BLE001  one bad file must not stop the others
        return [(path, None, None, None, None, None, f"{type(e).__name__}: {e}")]


def member_digests(rows: DataFrame) -> DataFrame:
    """path, member, md5 of the members of archives (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                with guarded(bytes(content)) as z:
                    out += [(path, i.filename, hashlib.md5(z.read(i)).hexdigest()) for i in z.infolist()]
            yield pd.DataFrame(out, columns=["path", "member", "md5"])

    return map_files(rows.select("path", "content"), run, "path string, member string, md5 string")


def import_archives(rows: DataFrame) -> DataFrame:
    """Blocks of files (path, content); a file that can't be read is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = (row for path, content in zip(b["path"], b["content"], strict=True) for row in file_blocks(path, bytes(content)))
            for out in portions(rows, lambda row: ROW + len(row[4] or "")):
                yield pd.DataFrame(out, columns=["file", "ord", "section", "kind", "text", "locator", "error"]).astype({"ord": "Int32"})

    return map_files(rows.select("path", "content"), run, BLOCKS)


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, ord, section, kind, text of marked-up pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, x[0], x[1], x[2]) for k, h in zip(b["page_id"], b["html"], strict=True) for i, x in enumerate(html_blocks(h or ""))]
            yield pd.DataFrame(out, columns=["page_id", "ord", "section", "kind", "text"])

    return map_files(pages.select("page_id", "html"), run, "page_id long, ord int, section string, kind string, text string")
