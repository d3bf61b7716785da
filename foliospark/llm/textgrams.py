"""Word hashes and word windows of many texts at once, in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; a term is one of digits, letters and non-ASCII bytes. Words and windows get 64-bit polynomial
hashes from prefix sums (all arithmetic modulo 2**64), each finished by a bijective mixer.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes that are hashed at once; longer texts go in pieces cut between words.
PIECE = 1 << 20
_P, _Q, _R = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_MASK = (1 << 64) - 1


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(1024, 1 << (n - 1).bit_length()) if n > 1 else 1024)[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all."""
    x = x ^ np.uint64(salt & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, the same wherever the run stands."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[end] - total[start]) * powers(_inverse(base), len(values) + 1)[start]


def _piece_hashes(data: bytes, lower: bool, terms: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte's place of each word, or term."""
    b = np.frombuffer(data, dtype=np.uint8)
    if lower:
        b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    if terms:
        word = (b >= 128) | ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 48) & (b <= 57)
    else:
        word = (b != 32) & ((b < 9) | (b > 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start
    h = _ranges(b.astype(np.uint64) + np.uint64(1), start, end, _P)
    return mix(h + (end - start).astype(np.uint64) * np.uint64(_R)), start


def word_hashes(texts: list[str | None], lower: bool = False, terms: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All words' (or terms') hashes one after the other, and where each text's words start (one more than texts)."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    group: list[bytes] = []
    held = first = 0

    def flush(upto: int) -> None:
        nonlocal group, held, first
        if group:
            lengths = np.array([len(x) + 1 for x in group], dtype=np.int64)
            h, at = _piece_hashes(b" ".join(group), lower, terms)
            hashes.append(h)
            counts[first + 1 : upto + 1] += np.bincount(np.searchsorted(np.cumsum(lengths), at, side="right"), minlength=len(group))
        group, held, first = [], 0, upto

    with np.errstate(over="ignore"):
        for i, text in enumerate(texts):
            data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
            if len(data) > PIECE:
                flush(i)
                words = 0
                k = 0
                while k < len(data):
                    end = min(len(data), k + PIECE)
                    while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                        end += 1
                    h, _ = _piece_hashes(data[k:end], lower, terms)
                    hashes.append(h)
                    words += len(h)
                    k = end
                counts[i + 1] += words
                first = i + 1
                continue
            group.append(data)
            held += len(data)
            if held > PIECE:
                flush(i + 1)
        flush(len(texts))
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), np.cumsum(counts)


def windows(words: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` words, across text borders too: mask those with ``inside``."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        start = np.arange(n)
        return mix(_ranges(mix(words, salt) if salt else words, start, start + length, _Q), salt + length)


def inside(offsets: np.ndarray, length: int) -> np.ndarray:
    """True where a run of ``length`` words that starts there stays in its text."""
    total = int(offsets[-1])
    n = max(0, total - length + 1)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(total)
    return left[:n] >= length


def owner(offsets: np.ndarray) -> np.ndarray:
    """The text's index of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
