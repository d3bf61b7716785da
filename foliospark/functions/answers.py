"""Clean-up of answers that repeat their prompt.

A line is read once from left to right into spans: a label in stars, instructions, text of its own, and a tail of background.
``RULES`` says for each kind of span whether it stays. What counts as an instruction, as background and as a pair
is given by phrases, those of our own templates unless told otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.cleaning import without_headers

#: Characters of a label in stars and of one in brackets, words of a label, and how far into a line an instruction may begin.
LABEL, BOX, LABEL_WORDS, NEAR = 80, 90, 8, 15
#: What ends a sentence, and what begins a quotation.
STOPS, OPENERS = ".!?…", "«“„\"「『"
BLANK = " \t"


@dataclass(frozen=True)
class Phrases:
    """Beginnings of instructions and of background, and the names before a colon that make a line a pair."""

    instructions: tuple[str, ...] = ("translate the text into", "translate from", "output the translation only", "below this line stands the text itself", "return exactly", "return only the translation", "keep every term mark")
    background: tuple[str, ...] = ("story so far", "recent translations", "background", "context:")
    pairs: tuple[str, ...] = ("source", "translation")


OURS = Phrases()


class Span(NamedTuple):
    kind: str  # label, instruction, own, background or pair
    text: str


#: Kinds of spans that stay in an answer.
RULES = {"label": False, "instruction": False, "own": True, "background": False, "pair": False}


def _first(text: str, phrases: tuple[str, ...]) -> tuple[int, int]:
    """Where the first of the phrases stands, whatever its case, and where it ends; (-1, -1) if none does."""
    low = text.casefold() if text.isascii() else text.lower()
    if len(low) != len(text):  # a letter that grows: compare character by character
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    places = [(at, -len(p)) for p in phrases if (at := low.find(p)) >= 0]
    return (min(places)[0], min(places)[0] - min(places)[1]) if places else (-1, -1)


def _place(text: str, signs: str) -> int:
    """The first place of any of the signs, or the text's length."""
    return min((at for c in signs if (at := text.find(c)) >= 0), default=len(text))


def _box(text: str, at: int) -> int:
    """The end of a bracket with stars around it whose stars begin at ``at``; -1 if none does."""
    inner = at
    while text[inner : inner + 1] == "*":
        inner += 1
    if inner == at:
        return -1
    opening = inner + len(text[inner:]) - len(text[inner:].lstrip())
    closing = text.find("]", opening)
    if text[opening : opening + 1] != "[" or not 1 <= closing - opening - 1 <= BOX or "\n" in text[opening:closing]:
        return -1
    tail = closing + 1 + len(text[closing + 1 :]) - len(text[closing + 1 :].lstrip())
    end = tail
    while text[end : end + 1] == "*":
        end += 1
    return end if end > tail else -1


def without_boxes(text: str) -> str:
    """A blank in place of each bracket in stars, and of the blanks and hash marks beside it."""
    out, at = [], 0
    star = text.find("*")
    while star >= 0:
        end = _box(text, star)
        if end < 0:
            star = text.find("*", star + 1)
            continue
        before = text[at:star].rstrip(BLANK).rstrip("#").rstrip(BLANK)
        after = text[end:].lstrip(BLANK)
        out += [before, " "]
        at = len(text) - len(after.lstrip("#"))
        star = text.find("*", at)
    return "".join([*out, text[at:]])


def _label(line: str) -> tuple[str, str] | None:
    """A line's label and what follows it. A bracket in stars always is one; other emphasis is if it is short and no sentence."""
    if "*" not in line:
        return None
    start = line.lstrip().lstrip("#").lstrip()
    end = _box(start, 0) if start.startswith("*") else -1
    if end >= 0:
        return start[:end], start[end:].strip().lstrip("#").strip()
    line = line.strip()
    stars = len(line) - len(line.lstrip("*"))
    inner, _, rest = line[stars:].partition("*")
    words = inner.split()
    close = 1 + len(rest) - len(rest.lstrip("*"))
    name = " ".join(words).rstrip(":")
    if not 1 <= stars <= 3 or len(line) < stars + len(inner) + 1 or not name or len(inner.strip()) > LABEL or len(name.split()) > LABEL_WORDS or _place(name, STOPS) < len(name):
        return None
    return name, rest[min(close, 3) - 1 :].strip()


def spans(line: str, phrases: Phrases = OURS) -> Iterator[Span]:
    """The line's spans in order, but for a label (see ``_label``)."""
    head, colon, _ = line.partition(":")
    if colon and head.strip().lower() in phrases.pairs:
        yield Span("pair", line)
        return
    rest, start = line, 0
    while True:
        text = rest.strip()
        at, end = _first(text, phrases.instructions)
        if not 0 <= at <= NEAR:
            break
        stop = end + _place(text[end:], STOPS)
        cut = stop + 1 if stop < len(text) else end + _place(text[end:], OPENERS)
        yield Span("instruction", text[:cut])
        rest, start = text[cut:].strip(), start + 1
        if not rest:
            return
    at, _ = _first(rest, phrases.background)
    if at >= 0:
        own, tail = rest[:at].rstrip(BLANK + "#"), rest[at:]
        ended = not own or own[-1] in STOPS + "»\"”"
        if ended or _holds_pair(tail, phrases):
            if own:
                yield Span("own", own)
            yield Span("background", tail)
            return
    yield Span("own", rest)


def _holds_pair(text: str, phrases: Phrases) -> bool:
    """Whether the name of a pair and a colon stand in the text as words of their own."""
    parts = text.lower().split(":")
    for n, part in enumerate(parts[:-1]):
        name = part.rstrip()
        for p in phrases.pairs:
            if name.endswith(p):
                before = name[len(name) - len(p) - 1 : len(name) - len(p)]
                if not before and (n > 0 or name == p) or before.isspace() or before == ".":
                    return True
    return False


def kept(line: str, phrases: Phrases = OURS) -> str | None:
    """What of the line stays by the rules; None if nothing does."""
    return next((s.text for s in spans(line, phrases) if RULES[s.kind]), None)


def without_instruction(line: str, phrases: Phrases = OURS) -> str | None:
    """What follows the instructions at a line's start: after the sentence, or from the first quote if it has no end; None if nothing."""
    found = list(spans(line, Phrases(phrases.instructions, (), ())))
    return line if [s.kind for s in found] == ["own"] else next((s.text for s in found if s.kind == "own"), None)


def without_echo(line: str, phrases: Phrases = OURS) -> str | None:
    """The line without instructions and without a tail that repeats the background; None if nothing is left or it is a pair."""
    return kept(line, phrases)


def after_frame(text: str, phrases: Phrases = OURS) -> str:
    """What follows the last label, and what stands before the first one unless that is prompt alone."""
    lines = text.split("\n")
    labels = {i: label[1] for i, line in enumerate(lines) if (label := _label(line))}
    if not labels:
        return text
    first, last = min(labels), max(labels)
    before = "\n".join(lines[:first]).strip()
    after = "\n".join([labels[last], *lines[last + 1 :]]).strip()
    own = any(kept(x.strip(), phrases) for x in without_boxes(before).split("\n") if x.strip())
    return "\n\n".join(x for x in (before if own else "", after) if x)


def _without_hashes(line: str) -> str:
    """A line without hash marks that end a word or stand alone; white space once."""
    parts = line.replace("\t", " ").split(" ")
    return " ".join(x for x in (p.rstrip("#") for p in parts) if x).strip()


def cleaned(text: str, phrases: Phrases = OURS) -> str:
    """All of it, line by line, on a text without bare bracketed headers."""
    out = []
    for line in without_boxes(after_frame(text, phrases)).split("\n"):
        line = _without_hashes(line)
        label = _label(line)
        stays = line if not line else None if label and not label[1] else kept(line, phrases)
        if stays is not None:
            out.append(stays)
    return "\n".join(out).strip()


def clean_output(text: Column, phrases: Phrases = OURS) -> Column:
    """The answer without what its prompt left in it; null counts as empty."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cleaned(t, phrases) if isinstance(t, str) else "")

    return run(without_headers(text))


def by_line(fn) -> Column:
    """A pandas UDF of one of the functions above; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fn(t) if isinstance(t, str) else None)

    return run
