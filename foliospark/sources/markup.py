"""XML members of archives read as tokens with byte places, so that texts can be changed where they stand.

A change replaces the bytes of an element's own texts and nothing else: tags, comments, declarations and all that
isn't named keep their bytes.
"""

from __future__ import annotations

import re
from html.entities import html5
from typing import NamedTuple
from xml.parsers import expat
from xml.sax.saxutils import escape

#: Elements whose texts aren't read.
SKIPPED = frozenset(("script", "style", "svg", "math", "head"))
#: Elements that are blocks of their own wherever they stand.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption caption".split())


class Token(NamedTuple):
    start: int
    end: int
    kind: str  # open, close, text or other
    name: str  # of the element, without its prefix; the characters of a text


class Element(NamedTuple):
    """A block with text of its own: the places of its texts, and what they say."""

    name: str
    places: list[tuple[int, int]]
    text: str


def utf8(data: bytes) -> bytes:
    """The same XML in UTF-8 if it is in UTF-16."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return re.sub(r"""encoding=(["'])[^"']*\1""", 'encoding="UTF-8"', data.decode("utf-16"), count=1).encode()
    return data


def tokens(data: bytes) -> list[Token]:
    """The document's tokens in order, without gaps; ExpatError if it isn't well-formed."""
    seen: list[tuple[int, str, str]] = []
    parser = expat.ParserCreate()
    parser.UseForeignDTD(True)  # entities that a missing DTD would declare are passed on
    local = lambda name: name.rpartition(":")[2]
    note = lambda kind, name: seen.append((parser.CurrentByteIndex, kind, name))
    parser.StartElementHandler = lambda name, attrs: note("open", local(name))
    parser.EndElementHandler = lambda name: note("close", local(name))
    parser.CharacterDataHandler = lambda text: note("text", text)
    parser.StartCdataSectionHandler = parser.EndCdataSectionHandler = lambda: note("text", "")
    parser.SkippedEntityHandler = lambda name, parameter: note("other", name) if parameter else note("text", html5.get(f"{name};", f"&{name};"))
    parser.DefaultHandler = lambda text: note("other", "")
    parser.ExternalEntityRefHandler = lambda *a: 1
    parser.Parse(data, True)
    ends = [s[0] for s in seen[1:]] + [len(data)]
    return [Token(at, end, kind, name) for (at, kind, name), end in zip(seen, ends, strict=True)]


def elements(data: bytes) -> list[Element]:
    """Blocks with text of their own in the order in which they begin; a block inside another is one by itself."""
    found: list[Element] = []
    open_: list[Element | None] = []  # None: an element that is no block
    skipped = 0
    for t in tokens(data):
        if t.kind == "open":
            skipped += t.name in SKIPPED
            block = Element(t.name, [], "") if t.name in BLOCKS else None
            open_.append(block and len(found))
            if block:
                found.append(block)
        elif t.kind == "close":
            skipped -= t.name in SKIPPED
            open_.pop()
        mine = next((x for x in reversed(open_) if x is not None), None)
        if mine is None or skipped:
            continue
        if t.kind == "text":
            found[mine].places.append((t.start, t.end))
            found[mine] = found[mine]._replace(text=found[mine].text + t.name.replace("\n", " "))
        elif t.kind == "open" and t.name == "br":
            found[mine] = found[mine]._replace(text=found[mine].text + "\n")
    tidy = lambda text: "\n".join(" ".join(line.split()) for line in text.split("\n")).strip()
    return [e._replace(text=tidy(e.text)) for e in found if e.text.strip()]


def spliced(data: bytes, changes: list[tuple[int, int, bytes]]) -> bytes:
    """``data`` with each of the ranges, which don't overlap, replaced."""
    out, at = [], 0
    for start, end, new in sorted(changes, key=lambda c: c[:2]):
        out += [data[at:start], new]
        at = end
    return b"".join([*out, data[at:]])


def with_elements(data: bytes, texts: dict[int, str]) -> bytes:
    """A chapter whose numbered elements have new texts; their other texts go, their tags stay. One that says its text already keeps its bytes."""
    given, data = data, utf8(data)
    changes: list[tuple[int, int, bytes]] = []
    for n, e in enumerate(elements(data)):
        if n in texts and texts[n] != e.text:
            lines = "<br/>".join(escape(x) for x in texts[n].split("\n"))
            first, *rest = e.places
            changes += [(*first, lines.encode()), *((a, b, b"") for a, b in rest)]
    return spliced(data, changes) if changes else given


def paragraphs(tags: list[Token]) -> dict[int, str]:
    """What the numbered paragraphs of a word-processor body say, with the texts of those inside them."""
    said: list[list[str]] = []
    open_: list[int] = []
    nodes = 0
    for t in tags:
        if t.kind == "open" and t.name == "p":
            open_.append(len(said))
            said.append([])
        elif t.kind == "close" and t.name == "p":
            open_.pop()
        elif t.name == "t" and t.kind in ("open", "close"):
            nodes += 1 if t.kind == "open" else -1
        elif t.kind == "open" and t.name in ("br", "tab") or t.kind == "text" and nodes:
            for n in open_:
                said[n].append({"br": "\n", "tab": "\t"}[t.name] if t.kind == "open" else t.name)
    return {n: "".join(x) for n, x in enumerate(said)}


def with_paragraphs(data: bytes, texts: dict[int, str]) -> bytes:
    """A word-processor body whose numbered paragraphs have new texts: in the first text node, the others are emptied. One that says
    its text already keeps its bytes."""
    given, data = data, utf8(data)
    changes: list[tuple[int, int, bytes]] = []
    open_: list[tuple[int, bool]] = []  # paragraphs that are open, and whether they have a text node so far
    number = -1
    node: tuple[Token, list[tuple[int, int]]] | None = None
    tags = tokens(data)
    said = paragraphs(tags)
    texts = {n: text for n, text in texts.items() if text != said.get(n)}
    if not texts:
        return given
    prefix = re.match(rb"<([^\s:>/]+:)?", data[next((t.start for t in tags if t.kind == "open" and t.name == "p"), 0) :])
    prefix = (prefix[1] or b"").decode() if prefix else ""
    for t in tags:
        if t.kind == "open" and t.name == "p":
            number += 1
            open_.append((number, False))
        elif t.kind == "open" and t.name == "t" and open_:
            node = (t, [])
        elif t.kind == "text" and node:
            node[1].append((t.start, t.end))
        elif t.kind == "close" and t.name == "t" and node:
            tag, places = node
            node = None
            wanted = [i for i, (n, _) in enumerate(open_) if n in texts]
            if not wanted:
                continue
            i = wanted[-1]
            new = "" if open_[i][1] else texts[open_[i][0]]
            open_[i] = (open_[i][0], True)
            start = data[tag.start : tag.end]
            if new and (new.strip() != new or "\n" in new) and b"xml:space" not in start:
                at = tag.end - (2 if start.endswith(b"/>") else 1)
                changes.append((at, at, b' xml:space="preserve"'))
            if start.endswith(b"/>"):
                if new:
                    changes.append((tag.end - 2, tag.end, f">{escape(new)}</{prefix}t>".encode()))
            else:
                changes += [(places[0][0], places[0][1], escape(new).encode()), *((a, b, b"") for a, b in places[1:])] if places else [(t.start, t.start, escape(new).encode())]
        elif t.kind == "close" and t.name == "p":
            n, told = open_.pop()
            if n in texts and not told and texts[n]:
                run = f'<{prefix}r><{prefix}t xml:space="preserve">{escape(texts[n])}</{prefix}t></{prefix}r>'.encode()
                start = data.rfind(b"<", 0, t.start) if t.start == t.end else t.start
                if data[start : t.start].endswith(b"/>"):  # an empty paragraph in one tag
                    changes.append((t.start - 2, t.start, b">" + run + f"</{prefix}p>".encode()))
                else:
                    changes.append((t.start, t.start, run))
    return spliced(data, changes) if changes else given
