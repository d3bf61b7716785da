"""Many terms found in one pass over a text: an automaton whose cost doesn't depend on their number."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import ahocorasick

#: Glossaries of no more terms go to every task as an automaton; larger ones are joined.
LARGEST = 100_000

Edge = Callable[[str], bool]


class _Folds(dict):
    """One character without its case, if that is one character."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        upper = c.upper()
        low = (upper if len(upper) == 1 else c).lower()
        self[code] = ord(low) if len(low) == 1 else code
        return self[code]


_FOLDS = _Folds()


def folded(text: str) -> str:
    """The text without case, each character at its place."""
    return text.lower() if text.isascii() else text.translate(_FOLDS)


def letter(c: str) -> bool:
    return c.isalnum()


def word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Terms:
    """An automaton over terms; ``inside`` says which characters mustn't stand next to a match."""

    def __init__(self, terms: Iterable[str], inside: Edge | None = None):
        self.terms, self.inside = list(terms), inside
        self.by: dict[str, list[int]] = {}
        for i, t in enumerate(self.terms):
            if t:
                self.by.setdefault(folded(t), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for t, numbers in self.by.items():
            self.automaton.add_word(t, (len(t), numbers))
        if self.by:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, list[int]]]:
        """(start, end, numbers of the terms) of every place where terms stand, also inside one another."""
        if not self.by or not text:
            return []
        out = []
        for last, (size, numbers) in self.automaton.iter(folded(text)):
            start, end = last + 1 - size, last + 1
            if self.inside and (start and self.inside(text[start - 1]) or end < len(text) and self.inside(text[end])):
                continue
            out.append((start, end, numbers))
        return out

    def numbers(self, text: str) -> list[int]:
        """The terms that stand in the text, each once."""
        return sorted({n for _, _, numbers in self.hits(text) for n in numbers})

    def marked(self, text: str, before: str, after: str) -> str:
        """The text with marks around its terms: the leftmost first, and of those that begin together the longest."""
        out, at = [], 0
        for start, end, _ in sorted(self.hits(text), key=lambda h: (h[0], -h[1])):
            if start >= at:
                out += [text[at:start], before, text[start:end], after]
                at = end
        return "".join([*out, text[at:]])

    def replaced(self, text: str, name: Callable[[int], str]) -> tuple[str, list[int]]:
        """The text with names in place of its terms, and the terms in the order of the names.

        The longest terms take their places first, equally long ones in their own order, each from left to right; a term can't
        stand in or right beside the place of one before it, as a name is a word of its own.
        """
        places: dict[int, list[tuple[int, int]]] = {}
        for start, end, numbers in self.hits(text):
            places.setdefault(numbers[0], []).append((start, end))
        taken = bytearray(len(text) + 2)  # one more on either side
        chosen: list[tuple[int, int, int]] = []
        for n in sorted(places, key=lambda n: (-len(self.terms[n]), n)):
            mine: list[tuple[int, int, int]] = []
            for start, end in sorted(places[n]):
                if not any(taken[start : end + 2]) and (not mine or start >= mine[-1][1]):
                    mine.append((start, end, n))
            for start, end, _ in mine:
                taken[start + 1 : end + 1] = b"\1" * (end - start)
            chosen += mine
        at, out = 0, []
        for start, end, k in sorted((s, e, k) for k, (s, e, _) in enumerate(chosen)):
            out += [text[at:start], name(k)]
            at = end
        return "".join([*out, text[at:]]), [n for _, _, n in chosen]


@lru_cache(maxsize=16)
def automaton(terms: tuple[str, ...], inside: Edge | None = None) -> Terms:
    """The automaton of a list, made once in each worker."""
    return Terms(terms, inside)
