"""Main text of web pages: streamed parser events, text-to-tag ratios per line, smoothing and clustering.

The standard library's parser turns a page into lines, one for each block of text, with the number of
tags that each took. Text-to-tag ratios are smoothed by a Gaussian and split into two clusters by a
threshold; the lines of the upper cluster say which regions hold the content: the article elements (or, without
any, main elements) with most of them or with at least half of that one's text-to-tag ratio, else the smallest element with nine
tenths of them, less linked lines before its first and after its last content line. The regions' lines are
the text, without what stands in navigation, headers, footers, asides, forms, comments and the like.

Null and empty pages give an empty text; very long pages are parsed whole, as they come. Null and repeated ids and repeated
rows give a row each, empty tables none; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg head title nav footer aside form button select textarea option iframe object canvas audio video dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
REGIONS = frozenset(("article", "main"))
#: Words of a class, id or role that mark what isn't the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup "
    "sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead comment comments reply replies respond disqus share sharing social "
    "related recommended recommendations widget widgets login search skip toolbar contentinfo complementary".split()
)
#: Words that name a part or a place and say nothing by themselves: a name is a hint if it has nothing else beside a word above.
PARTS = frozenset(
    "area articles bar block bottom box col column container content entry full global group inner item items left list main outer page pane panel post posts primary right row secondary section site "
    "slot top unit user wrap wrapper blog article".split()
)
#: Of the hints, the ones that are never the article, however long.
READERS = frozenset("comment comments reply replies respond disqus".split())
#: Blocks that hold text rather than other blocks.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre dt dd figcaption caption address summary".split())
_CLOSED_BY = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dd", {"dl"}), "dd": ("dt", {"dl"}), "tr": ("tr", {"table"}), "td": ("td", {"tr"}), "th": ("th", {"tr"})}
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z0-9]+")


class _Line:
    __slots__ = ("inside", "links", "parts", "tags")

    def __init__(self, inside: tuple[int, ...]):
        self.parts: list[str] = []
        self.tags = 0
        self.links = 0
        self.inside = inside


def hinted(value: str) -> int:
    """0, 1 or 2 (readers' comments) for the names in a class, an id or a role. A name is read whole: has-comments,
    comments-open or side-effects say something about what isn't one of the parts to leave out."""
    found = 0
    for name in value.lower().split():
        words = [w for w in _WORDS.findall(name) if not w.isdigit()]
        if words and not HINTS.isdisjoint(words) and all(w in HINTS or w in PARTS for w in words):
            found = max(found, 1 if READERS.isdisjoint(words) else 2)
    return found


class PageLines(HTMLParser):
    """Lines of a page; ``elements`` has each container's tag and 0, or 1 if hinted, or 2 if readers' comments."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # tag and its number among elements, or -1 if inline
        self.elements: list[tuple[str, int]] = []
        self.lines: list[_Line] = []
        self.dropped = 0
        self.line = _Line(())
        self.tags = 0
        self.in_link = 0

    def _break(self) -> None:
        if self.line.parts:
            self.lines.append(self.line)
        self.line = _Line(tuple(n for _, n in self.stack if n >= 0))

    def _pop_to(self, at: int) -> None:
        for tag, _ in self.stack[at:]:
            if tag.startswith("!"):
                self.dropped -= 1
            elif tag == "a":
                self.in_link -= 1
        del self.stack[at:]

    def _close(self, names: tuple[str, ...], border: set[str]) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at][0].lstrip("!")
            if tag in names:
                self._pop_to(at)
                return
            if tag in border:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.line.tags += 1
        if tag in BLOCKS:
            if tag in _CLOSED_BY:
                other, border = _CLOSED_BY[tag]
                self._close((tag, other), border)
            else:
                self._close(("p",), BLOCKS - {"p"})
            if not self.dropped:
                self._break()
                self.line.tags += 1
        elif tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        hints = 0
        hidden = False
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                hints = max(hints, hinted(value))
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
                hidden = True
        header = tag == "header" and not any(t in REGIONS for t, _ in self.stack)
        if tag in DROPPED or header or hidden:
            self.stack.append(("!" + tag, -1))
            self.dropped += 1
            return
        number = -1
        if tag in BLOCKS or hints:
            number = len(self.elements)
            self.elements.append((tag, hints if tag not in ("html", "body", "main") else 0))
        self.stack.append((tag, number))
        if tag == "a":
            self.in_link += 1
        if number >= 0 and not self.dropped:
            if tag not in BLOCKS and self.line.parts:  # a hinted inline element is a line of its own
                self._break()
            else:
                self.line.inside = tuple(n for _, n in self.stack if n >= 0)

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0].lstrip("!") == tag:
                ends_line = any(n >= 0 or t.startswith("!") for t, n in self.stack[at:])
                self._pop_to(at)
                if ends_line and not self.dropped:
                    self._break()
                return

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.line.parts.append(data)
            if self.in_link:
                self.line.links += len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A section of a kind that the parser doesn't know is a comment up to the next > (the parser raises there)."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def close(self) -> None:
        super().close()
        self._break()


def smoothed(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with mirrored ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, reach, mode="symmetric" if len(x) >= reach else "edge"), kernel / kernel.sum(), mode="valid")


def threshold(x: np.ndarray) -> float:
    """Border of two clusters of numbers: the mean of their means, iterated."""
    at = float(x.mean())
    for _ in range(20):
        low, high = x[x < at], x[x >= at]
        if not len(low) or not len(high):
            break
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return at


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by newlines."""
    if not html:
        return ""
    page = PageLines()
    page.feed(html)
    page.close()
    lines = [(x, t) for x in page.lines if (t := _SPACE.sub(" ", "".join(x.parts)).strip())]
    if not lines:
        return ""
    size = np.array([len(t) for _, t in lines], dtype=np.float64)
    ratio = smoothed(size / np.array([max(1, x.tags) for x, _ in lines]))
    content = ratio >= threshold(ratio)
    total, held, rich, dense = float(size.sum()), defaultdict(float), defaultdict(float), defaultdict(float)
    for (x, _), n, c in zip(lines, size, content, strict=True):
        for e in x.inside:
            held[e] += n
            dense[e] += n * n / max(1, x.tags)  # a character counts by its line's ratio
            rich[e] += n if c else 0.0
    above = {e for x, _ in lines for at, n in enumerate(x.inside) if page.elements[n][0] in REGIONS for e in x.inside[:at]}
    # what holds an article is no readers' comments, nor is what holds all lines that the ratios call content
    prose = sum(n for n, c in zip(size, content, strict=True) if c)
    aside = {e for e, (tag, hint) in enumerate(page.elements) if hint == 2 and e not in above and rich[e] < prose or hint and (tag == "article" or e not in above and held[e] <= 0.5 * total)}
    ok = [not aside.intersection(x.inside) for x, _ in lines]
    regions = [e for e, (tag, _) in enumerate(page.elements) if tag in REGIONS and e not in aside and held[e] > 0]
    articles = [e for e in regions if page.elements[e][0] == "article" and not any(aside.intersection(x.inside) for x, _ in lines if e in x.inside[:1])]
    if regions:
        wanted_regions = articles or regions
        best = max(wanted_regions, key=lambda e: (rich[e], held[e], -e))
        chosen = {best} | {e for e in wanted_regions if 2 * dense[e] / held[e] >= dense[best] / held[best]}
    else:
        wanted = sum(n for n, c, o in zip(size, content, ok, strict=True) if c and o) or float(size.sum())
        kept = defaultdict(float)
        for (x, _), n, c, o in zip(lines, size, content, ok, strict=True):
            if c and o:
                for e in x.inside:
                    if page.elements[e][0] not in LEAVES:
                        kept[e] += n
        fit = [e for e in kept if kept[e] >= 0.9 * wanted]
        chosen = {min(fit, key=lambda e: (held[e], -e))} if fit else None
    mine = [o and (chosen is None or not chosen.isdisjoint(x.inside)) for (x, _), o in zip(lines, ok, strict=True)]
    full = [i for i, (m, c) in enumerate(zip(mine, content, strict=True)) if m and c]
    first, last = (full[0], full[-1]) if full and not regions else (0, len(lines))
    return "\n".join(t for i, ((x, t), m) in enumerate(zip(lines, mine, strict=True)) if m and (first <= i <= last or x.links <= 0.8 * len(t)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(x if isinstance(x, str) else None) for x in b["h"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", F.col(html_col).alias("h")).mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
