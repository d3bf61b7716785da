"""Progressive JPEG as a media column: an encoder of coefficients and a decoder to full-resolution RGB.

The decoder reads all scans of a progressive file (spectral selection and successive approximation)
into coefficient arrays, transforms them back in numpy, upsamples chroma and gives an RGB tensor. It
works on many files at once: the restart intervals of all of them are decoded side by side, one
symbol of each per step, so the work is numpy's and not Python's.

``store`` puts bytes into a picture losslessly: the format's unit is the quantised coefficient, and with all
quantisers 1 each byte less 128 is one coefficient (384 bytes: four blocks of luma and one of each chroma).

Null texts count as empty, which is one block of spaces; equal texts have equal files and features whatever
stands beside them; very long texts are coded alone; a file that cannot be read raises ``ValueError``; null and
repeated ids and repeated rows give a row each, empty tables none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks between restart markers in what ``encode`` writes.
RESTART = 8
#: Most units on a side of a stored payload's picture.
SIDE = 4095
#: Blocks of a picture at most whose orders are kept for others of its size.
ORDERED = 1024
#: Payload bytes that are coded together at most, if more than one.
TOGETHER = 3 << 20


def _zigzag() -> np.ndarray:
    """Natural place of each zigzag place."""
    return np.array([8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


ZIGZAG = _zigzag()


@dataclass
class Huffman:
    """A code: symbols by length, and the table from 16 bits to symbol and length."""

    counts: list[int]
    symbols: list[int]

    def __post_init__(self) -> None:
        self.code, self.length = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
        self.lookup = np.zeros(1 << 16, dtype=np.int32)
        code = at = 0
        for size, n in enumerate(self.counts, 1):
            for s in self.symbols[at : at + n]:
                self.code[s], self.length[s] = code, size
                self.lookup[code << (16 - size) : (code + 1) << (16 - size)] = s | size << 8
                code += 1
            at += n
            code <<= 1

    def key(self) -> tuple:
        return (*self.counts, *self.symbols)

    @staticmethod
    def from_weights(weights: dict[int, float]) -> Huffman:
        """By Huffman's rule, with a symbol of no use so that no code is all ones."""
        heap = [(w, s, (s,)) for s, w in weights.items()] + [(min(weights.values()) / 4, 999, (999,))]
        depth: dict[int, int] = defaultdict(int)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) > 16:
            raise ValueError("code too long")
        last = max(s for s in depth if s != 999 and depth[s] == max(depth.values()))
        if depth[999] < depth[last]:
            depth[999], depth[last] = depth[last], depth[999]
        order = sorted((d, s) for s, d in depth.items())
        counts = [sum(d == n for d, s in order if s != 999) for n in range(1, 17)]
        return Huffman(counts, [s for _, s in order if s != 999])


#: How often each size of a coefficient is expected; text bytes less 128 mostly have sizes 4 to 7.
_SIZES = {1: 10, 2: 20, 3: 60, 4: 200, 5: 400, 6: 100, 7: 150, 8: 10, 9: 2, 10: 2}
DC_CODE = Huffman.from_weights({s: _SIZES.get(s, 20) for s in range(12)})
AC_CODE = Huffman.from_weights({0x00: 30.0, 0xF0: 1.0, **{r << 4 | s: max(0.5, w / 4**r) for r in range(16) for s, w in _SIZES.items()}})

#: (first, last, previous shift + 1 or 0, shift): spectral band and approximation; band 0 takes all components at once.
SCRIPT = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 0), (0, 0, 1, 0), (1, 5, 1, 0))


@dataclass
class Layout:
    """Size and sampling of a picture; grids are padded to whole units of all components."""

    width: int
    height: int
    sampling: tuple[tuple[int, int], ...] = ((1, 1), (1, 1), (1, 1))

    def __post_init__(self) -> None:
        self.hmax, self.vmax = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.grid = [(self.down * v, self.across * h) for h, v in self.sampling]
        self.own = [(-(-(-(-self.height * v // self.vmax)) // 8), -(-(-(-self.width * h // self.hmax)) // 8)) for h, v in self.sampling]
        self.start = np.cumsum([0, *(a * b for a, b in self.grid)]).tolist()
        self.blocks = self.start[-1]

    def order(self, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        """Blocks of a scan in order, their component's index in the scan, and blocks of a unit."""
        if self.blocks > ORDERED:
            return self._order(components)
        return _kept_order(self.width, self.height, self.sampling, components)

    def _order(self, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        if len(components) == 1:
            c = components[0]
            rows, cols = self.own[c]
            at = self.start[c] + (np.arange(rows)[:, None] * self.grid[c][1] + np.arange(cols)[None, :]).ravel()
            return at, np.zeros(len(at), dtype=np.int64), 1
        my, mx = np.divmod(np.arange(self.across * self.down), self.across)
        parts, which = [], []
        for n, c in enumerate(components):
            h, v = self.sampling[c]
            for y in range(v):
                for x in range(h):
                    parts.append(self.start[c] + (my * v + y) * self.grid[c][1] + mx * h + x)
                    which.append(n)
        return np.stack(parts, axis=1).ravel(), np.tile(which, len(my)), len(parts)


@lru_cache(maxsize=1024)
def _kept_order(width: int, height: int, sampling: tuple, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    at, which, unit = Layout(width, height, sampling)._order(components)
    at.flags.writeable = which.flags.writeable = False
    return at, which, unit


# Writing


def _sizes(v: np.ndarray) -> np.ndarray:
    return _BITS[np.abs(v)]


_BITS = np.array([int(i).bit_length() for i in range(1 << 12)], dtype=np.int64)


def _extra(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (np.int64(1) << s) - 1, v)


def _with_code(code: Huffman, symbol: np.ndarray, extra: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (code.code[symbol] << bits) | extra, code.length[symbol] + bits


def _ac_first(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, value and length of each entry for a band (rows of shifted coefficients)."""
    row, k = np.nonzero(v)
    value = v[row, k]
    before = np.empty_like(k)
    if len(k):
        before[0], before[1:] = -1, np.where(row[1:] == row[:-1], k[:-1], -1)
    run = k - before - 1
    size = _sizes(value)
    entry, length = _with_code(AC_CODE, (run & 15) << 4 | size, _extra(value, size), size)
    last = np.full(len(v), -1)
    last[row] = k
    far = np.flatnonzero(run > 15)
    at, rows, codes = [], [], []
    if len(far):
        times = run[far] >> 4
        at.append(np.repeat(far, times))
        rows.append(np.repeat(row[far], times))
        codes.append(np.full(int(times.sum()), 0xF0))
    end = np.flatnonzero(last < v.shape[1] - 1)
    if len(end):
        at.append(np.searchsorted(row, end, side="right"))
        rows.append(end)
        codes.append(np.zeros(len(end), dtype=np.int64))
    if at:
        at_, rows_, codes_ = np.concatenate(at), np.concatenate(rows), np.concatenate(codes)
        turn = np.lexsort((rows_, at_))  # an end of block goes before the next row's long run
        at_, rows_, codes_ = at_[turn], rows_[turn], codes_[turn]
        row, entry, length = np.insert(row, at_, rows_), np.insert(entry, at_, AC_CODE.code[codes_]), np.insert(length, at_, AC_CODE.length[codes_])
    return row, entry, length


def _ac_refine(v: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_ac_first``, for a refinement of a band of 15 coefficients at most."""
    if v.shape[1] > 15:
        raise ValueError("a refinement takes 15 coefficients at most here")
    size = np.abs(v)
    known, now = size >> (shift + 1) != 0, (size >> shift) == 1
    n, width = v.shape
    following = np.full((n, width + 1), width)
    for k in range(width - 1, -1, -1):
        following[:, k] = np.where(now[:, k], k, following[:, k + 1])
    zeros = np.cumsum(~known, axis=1)
    row, k = np.nonzero(now)
    previous = np.where(np.concatenate(([False], row[1:] == row[:-1])) if len(row) else np.zeros(0, bool), np.concatenate(([0], zeros[row[:-1], k[:-1]])) if len(row) else 0, 0)
    run = zeros[row, k] - previous - 1
    entry, length = _with_code(AC_CODE, run << 4 | 1, (v[row, k] > 0).astype(np.int64), np.ones(len(row), dtype=np.int64))
    crow, ck = np.nonzero(known)
    end = np.flatnonzero(~now[:, -1])
    rows = np.concatenate((row, crow, end))
    key = np.concatenate((row * 4096 + k * 64, crow * 4096 + following[crow, ck] * 64 + 1 + ck, end * 4096 + width * 64))
    entries = np.concatenate((entry, (size[crow, ck] >> shift) & 1, np.full(len(end), AC_CODE.code[0])))
    lengths = np.concatenate((length, np.ones(len(crow), dtype=np.int64), np.full(len(end), AC_CODE.length[0])))
    turn = np.argsort(key, kind="stable")
    return rows[turn], entries[turn], lengths[turn]


def _packed(interval: np.ndarray, entry: np.ndarray, length: np.ndarray, n: int) -> list[bytes]:
    """Bytes of each interval: its entries' bits, filled up with ones and stuffed."""
    bits = np.bincount(interval, weights=length, minlength=n).astype(np.int64)
    size = (bits + 7) // 8
    start = np.concatenate(([0], np.cumsum(size)))
    within = np.cumsum(length) - length
    first = np.concatenate(([0], np.cumsum(bits)))[interval]
    at = within - first + 8 * start[interval]
    word, shift = at >> 5, (64 - (at & 31) - length).astype(np.uint64)
    wide = entry.astype(np.uint64) << shift
    total = int(start[-1]) // 4 + 3
    words = np.bincount(word, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=total) + np.bincount(word + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total)
    data = words.astype(np.uint32).astype(">u4").view(np.uint8)
    full = np.flatnonzero(bits)
    data[start[full + 1] - 1] |= ((1 << ((-bits[full]) % 8)) - 1).astype(np.uint8)
    raw = data.tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in pairwise(start.tolist())]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def encode(coefficients: list[np.ndarray], layouts: list[Layout], quantisers: np.ndarray | None = None, script=SCRIPT, restart: int = RESTART) -> list[bytes]:
    """Progressive files of pictures given as quantised coefficients (blocks in layout order, 64 in zigzag order)."""
    quant = np.ones(64, dtype=np.uint8) if quantisers is None else np.asarray(quantisers, dtype=np.uint8)
    base = np.concatenate(([0], np.cumsum([x.blocks for x in layouts])))
    all_rows = np.concatenate(coefficients).astype(np.int64)
    components = len(layouts[0].sampling)
    tables = b"".join(_segment(0xC4, bytes([kind]) + bytes(code.counts) + bytes(code.symbols)) for kind, code in ((0x00, DC_CODE), (0x10, AC_CODE)))
    head = b"\xff\xd8" + _segment(0xDB, b"\0" + quant.tobytes())
    files = [[head + _segment(0xC2, struct.pack(">BHHB", 8, x.height, x.width, components) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(x.sampling))) + tables + _segment(0xDD, struct.pack(">H", restart))] for x in layouts]
    for first, last, high, low in script:
        for scan in [tuple(range(components))] if first == 0 else [(c,) for c in range(components)]:
            rows, comp, interval, per_file = [], [], [], []
            for i, x in enumerate(layouts):
                at, which, unit = x.order(scan)
                n = -(-len(at) // (unit * restart))
                rows.append(at + base[i])
                comp.append(which)
                interval.append(np.arange(len(at)) // (unit * restart) + sum(per_file))
                per_file.append(n)
            rows, comp, interval = np.concatenate(rows), np.concatenate(comp), np.concatenate(interval)
            n = sum(per_file)
            if first == 0 and not high:
                dc = all_rows[rows, 0] >> low
                diff = np.empty_like(dc)
                for c in range(len(scan)):
                    mine = np.flatnonzero(comp == c)
                    d, g = dc[mine], interval[mine]
                    diff[mine] = d - np.where(np.concatenate(([False], g[1:] == g[:-1])), np.concatenate(([0], d[:-1])), 0)
                size = _sizes(diff)
                entry, length = _with_code(DC_CODE, size, _extra(diff, size), size)
                owner = interval
            elif first == 0:
                entry, length, owner = (all_rows[rows, 0] >> low) & 1, np.ones(len(rows), dtype=np.int64), interval
            else:
                band = all_rows[rows, first : last + 1]
                row, entry, length = _ac_refine(band, low) if high else _ac_first(np.sign(band) * (np.abs(band) >> low))
                owner = interval[row]
            parts = _packed(owner, entry, length, n)
            header = _segment(0xDA, bytes([len(scan)]) + b"".join(bytes([c + 1, 0]) for c in scan) + bytes([first, last, high << 4 | low]))
            at = 0
            for i, count in enumerate(per_file):
                files[i].append(header)
                for j in range(count):
                    if j:
                        files[i].append(bytes((255, 0xD0 + (j - 1) % 8)))
                    files[i].append(parts[at + j])
                at += count
    return [b"".join((*f, b"\xff\xd9")) for f in files]


# Reading


@dataclass
class Scan:
    components: tuple[int, ...]
    codes: tuple[tuple[Huffman | None, Huffman | None], ...]
    first: int
    last: int
    high: int
    low: int
    restart: int
    parts: list[bytes] = field(default_factory=list)


def parse(data: bytes) -> tuple[Layout, list[np.ndarray], list[Scan]]:
    """Layout, quantisers by component (zigzag order) and scans of a progressive file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, quants, codes, restart = 2, {}, {}, 0
    layout, selectors, scans, ids = None, [], [], []
    while at + 4 <= len(data):
        if data[at] != 255:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker == 255:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                codes[body[0]] = _huffman(bytes(body[1 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xC2:
            if body[0] != 8:
                raise ValueError("8-bit samples expected")
            height, width, n = struct.unpack(">HHB", body[1:6])
            ids = [body[6 + 3 * i] for i in range(n)]
            layout = Layout(width, height, tuple((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)))
            selectors = [body[8 + 3 * i] for i in range(n)]
        elif marker == 0xDA:
            n = body[0]
            which = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            tables = tuple((codes.get(body[2 + 2 * i] >> 4), codes.get(0x10 | body[2 + 2 * i] & 15)) for i in range(n))
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            scan = Scan(which, tables, first, last, approx >> 4, approx & 15, restart)
            begin = at
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    raise ValueError("scan without an end")
                after = data[at + 1]
                if after == 0:
                    at += 2
                    continue
                scan.parts.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
                if 0xD0 <= after <= 0xD7:
                    at += 2
                    begin = at
                    continue
                break
            scans.append(scan)
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("no progressive Huffman file")
    if layout is None:
        raise ValueError("no frame")
    return layout, [quants[s] for s in selectors], scans


_CODES: dict[bytes, Huffman] = {}


def _huffman(spec: bytes) -> Huffman:
    if spec not in _CODES:
        if len(_CODES) > 64:
            _CODES.clear()
        _CODES[spec] = Huffman(list(spec[:16]), list(spec[16:]))
    return _CODES[spec]


class _Chains:
    """Restart intervals of one scan of many files, read side by side."""

    def __init__(self, scans: list[Scan], layouts: list[Layout], base: list[int]):
        rows, comp, self.begin, self.count, parts = [], [], [], [], []
        held = 0
        for scan, layout, offset in zip(scans, layouts, base, strict=True):
            at, which, unit = layout.order(scan.components)
            rows.append(at + offset)
            comp.append(which)
            step = scan.restart * unit or len(at)
            edges = [*range(0, len(at), step), len(at)] if len(at) else [0]
            if len(edges) - 1 > len(scan.parts):
                raise ValueError("restart interval missing")
            for (a, b), part in zip(pairwise(edges), scan.parts, strict=False):
                self.begin.append(held + a)
                self.count.append(b - a)
                parts.append(part)
            held += len(at)
        self.rows, self.comp = np.concatenate(rows), np.concatenate(comp)
        self.begin, self.count = np.array(self.begin, dtype=np.int64), np.array(self.count, dtype=np.int64)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.bit = 8 * np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.data = b"".join(parts) + bytes(16)
        self.window = np.ndarray((len(self.data) - 8,), dtype=">u8", buffer=self.data, strides=(1,))
        self.most = len(self.data) - 9

    def peek(self, p: np.ndarray) -> np.ndarray:
        return self.window[np.minimum(p >> 3, self.most)].astype(np.uint64) << (p & 7).astype(np.uint64)


def _bits(w: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (((w << skip.astype(np.uint64)) >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _extended(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < (np.int64(1) << np.maximum(s - 1, 0)), v - (np.int64(1) << s) + 1, v)


def _read_dc_first(c: _Chains, scan: Scan, out: np.ndarray) -> None:
    tables = np.stack([t[0].lookup for t in scan.codes])
    alive = np.arange(len(c.begin))
    p, last = c.bit.copy(), np.zeros((len(alive), len(scan.components)), dtype=np.int64)
    for turn in range(int(c.count.max(initial=0))):
        alive = alive[c.count[alive] > turn]
        at = c.begin[alive] + turn
        w = c.peek(p[alive])
        found = tables[c.comp[at], (w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        n, s = found >> 8, found & 255
        last[alive, c.comp[at]] += _extended(_bits(w, n, s), s)
        out[c.rows[at], 0] = last[alive, c.comp[at]] << scan.low
        p[alive] += n + s


def _read_dc_refine(c: _Chains, scan: Scan, out: np.ndarray) -> None:
    chain = np.repeat(np.arange(len(c.begin)), c.count)
    at = np.arange(len(chain)) - np.repeat(np.cumsum(c.count) - c.count, c.count)
    place = c.bit[chain] + at
    bit = (np.frombuffer(c.data, dtype=np.uint8)[place >> 3] >> (7 - (place & 7))) & 1
    out[c.rows[c.begin[chain] + at], 0] |= (bit.astype(out.dtype) << scan.low).astype(out.dtype)


def _read_ac_first(c: _Chains, scan: Scan, out: np.ndarray) -> None:
    table = scan.codes[0][1].lookup
    flat = out.reshape(-1)
    end = c.begin + c.count
    at, p, stop = c.begin.copy(), c.bit.copy(), end
    k = np.full(len(at), scan.first, dtype=np.int64)
    while True:
        live = at < stop
        if not live.all():
            at, p, stop, k = at[live], p[live], stop[live], k[live]
        if not len(at):
            return
        w = c.peek(p)
        found = table[(w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        n, r, s = found >> 8, (found >> 4) & 15, found & 15
        if not n.all():
            raise ValueError("unknown code")
        sized = s > 0
        if sized.all():
            v = _bits(w, n, s)
            k += r
            flat[c.rows[at] * 64 + k] = _extended(v, s) << scan.low
            p += n + s
            k += 1
        else:
            extra = np.where(sized, s, np.where(r < 15, r, 0))
            v = _bits(w, n, extra)
            k += np.where(sized | (r == 15), r, 0)
            flat[c.rows[at[sized]] * 64 + k[sized]] = _extended(v[sized], s[sized]) << scan.low
            p += n + extra
            k += 1
            over = ~sized & (r < 15)
            at += np.where(over, (np.int64(1) << r) + v - 1, 0)
            k[over] = 64
        done = k > scan.last
        at += done
        k[done] = scan.first


def _read_ac_refine(c: _Chains, scan: Scan, out: np.ndarray) -> None:
    """One coefficient of each interval per step: a symbol is read where one is due."""
    table, step = scan.codes[0][1].lookup, 1 << scan.low
    flat = out.reshape(-1)
    at, p, stop = c.begin.copy(), c.bit.copy(), c.begin + c.count
    k = np.full(len(at), scan.first, dtype=np.int64)
    run, new, rest, due = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.ones(len(at), bool)
    while True:
        live = at < stop
        if not live.all():
            at, p, stop, k, run, new, rest, due = at[live], p[live], stop[live], k[live], run[live], new[live], rest[live], due[live]
        if not len(at):
            return
        ask = np.flatnonzero(due & (rest == 0))
        if len(ask):
            w = c.peek(p[ask])
            found = table[(w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
            n, r, s = found >> 8, (found >> 4) & 15, found & 15
            if not n.all():
                raise ValueError("unknown code")
            extra = np.where(s > 0, 1, np.where(r < 15, r, 0))
            v = _bits(w, n, extra)
            p[ask] += n + extra
            ends = (s == 0) & (r < 15)
            rest[ask] = np.where(ends, (np.int64(1) << r) + v, 0)
            run[ask] = r
            new[ask] = np.where(s > 0, np.where(v > 0, step, -step), 0)
            due[ask] = ends
        place = c.rows[at] * 64 + k
        have = flat[place]
        known = np.flatnonzero(have)
        if len(known):
            bit = (c.peek(p[known]) >> np.uint64(63)).astype(np.int64)
            flat[place[known]] += (np.sign(have[known]) * bit * step).astype(flat.dtype)
            p[known] += 1
        blank = np.flatnonzero((have == 0) & (rest == 0))
        if len(blank):
            here = blank[run[blank] == 0]
            flat[place[here]] = new[here]
            due[here] = True
            run[blank] -= 1
        k += 1
        done = k > scan.last
        k[done] = scan.first
        at += done
        rest -= done & (rest > 0)
        due |= done


def read_coefficients(files: list[bytes]) -> tuple[list[Layout], list[list[np.ndarray]], np.ndarray, list[int]]:
    """Layouts, quantisers, all quantised coefficients (blocks x 64, zigzag) and where each file's begin."""
    parsed = [parse(x) for x in files]
    layouts = [x[0] for x in parsed]
    base = np.concatenate(([0], np.cumsum([x.blocks for x in layouts]))).tolist()
    out = np.zeros((base[-1], 64), dtype=np.int32)
    for turn in range(max((len(x[2]) for x in parsed), default=0)):
        groups: dict[tuple, list[int]] = defaultdict(list)
        for i, (_, _, scans) in enumerate(parsed):
            if turn < len(scans):
                s = scans[turn]
                groups[(len(s.components), s.first, s.last, s.high, s.low, tuple((id(a), id(b)) for a, b in s.codes))].append(i)
        for members in groups.values():
            scan = parsed[members[0]][2][turn]
            chains = _Chains([parsed[i][2][turn] for i in members], [layouts[i] for i in members], [base[i] for i in members])
            read = (_read_dc_refine if scan.high else _read_dc_first) if scan.first == 0 else (_read_ac_refine if scan.high else _read_ac_first)
            read(chains, scan, out)
    return layouts, [x[1] for x in parsed], out, base


def _basis() -> np.ndarray:
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return (np.where(u == 0, np.sqrt(0.5), 1.0) * 0.5 * np.cos((2 * x + 1) * u * np.pi / 16)).astype(np.float32)


_COS = _basis()


def inverse_transform(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 8, 8) of dequantised coefficients (n, 64, zigzag), element by element so that a block's samples don't depend on its neighbours."""
    out = np.empty((len(blocks), 8, 8), dtype=np.float32)
    for a in range(0, len(blocks), 2048):
        f = np.empty((64, len(blocks[a : a + 2048])), dtype=np.float32)
        f[ZIGZAG] = blocks[a : a + 2048].T
        f = f.reshape(8, 8, -1)
        rows = np.zeros_like(f)
        for x in range(8):
            for u in range(8):
                rows[:, x] += _COS[u, x] * f[:, u]
        done = np.zeros_like(f)
        for y in range(8):
            for v in range(8):
                done[y] += _COS[v, y] * rows[v]
        out[a : a + 2048] = np.moveaxis(done, 2, 0)
    return np.clip(np.floor(out + np.float32(128.5)), 0, 255)


def _rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Of samples of equal shape; a new last axis holds red, green and blue."""
    b, r = cb - 128, cr - 128
    full = np.stack((y + np.float32(1.402) * r, y - np.float32(0.344136) * b - np.float32(0.714136) * r, y + np.float32(1.772) * b), axis=-1)
    return np.clip(np.floor(full + np.float32(0.5)), 0, 255).astype(np.uint8)


def picture(layout: Layout, quantisers: list[np.ndarray], coefficients: np.ndarray) -> np.ndarray:
    """Full-resolution RGB tensor (height, width, 3)."""
    planes = []
    for c, (h, v) in enumerate(layout.sampling):
        rows, cols = layout.grid[c]
        s = inverse_transform(coefficients[layout.start[c] : layout.start[c + 1]].astype(np.float32) * quantisers[c])
        plane = s.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
        plane = np.repeat(np.repeat(plane, layout.vmax // v, axis=0), layout.hmax // h, axis=1)
        planes.append(plane[: layout.height, : layout.width])
    return np.repeat(planes[0][..., None], 3, axis=2).astype(np.uint8) if len(planes) == 1 else _rgb(*planes[:3])


def decode(files: list[bytes]) -> list[np.ndarray]:
    """RGB tensors of progressive files."""
    layouts, quants, rows, base = read_coefficients(files)
    return [picture(x, q, rows[a:b]) for x, q, (a, b) in zip(layouts, quants, pairwise(base), strict=True)]


# Payloads


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text and its payload: filled up with spaces to a positive multiple of 192."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    return len(data), data.ljust(max(192, -(-len(data) // 192) * 192), b" ")


#: A stored picture's components: a unit (MCU) is four blocks of luma and one of each chroma, 384 payload bytes.
SAMPLING, UNIT = ((2, 2), (1, 1), (1, 1)), 384


def store(payloads: list[bytes]) -> list[bytes]:
    """A progressive file of each payload; its number of bytes stands in a comment segment."""
    coefficients, layouts = [], []
    for p in payloads:
        units = -(-len(p) // UNIT)
        across = -(-units // SIDE)
        down = -(-units // across)
        v = np.zeros(across * down * UNIT, dtype=np.int16)
        v[: len(p)] = np.frombuffer(p, dtype=np.uint8).astype(np.int16) - 128
        coefficients.append(v.reshape(-1, 64))
        layouts.append(Layout(16 * across, 16 * down, SAMPLING))
    return [f[:2] + _segment(0xFE, b"payload bytes %d" % len(p)) + f[2:] for f, p in zip(encode(coefficients, layouts), payloads, strict=True)]


def stored_bytes(data: bytes) -> int:
    """The payload's length, from the comment at the start of a stored file."""
    comment = data[6 : 4 + int.from_bytes(data[4:6], "big")]
    if data[2:4] != b"\xff\xfe" or not comment.startswith(b"payload bytes "):
        raise ValueError("no stored payload")
    return int(comment[14:])


def restore(files: list[bytes]) -> tuple[list[bytes], list[str]]:
    """Payloads of stored files, and a feature of each picture: its size, the sums and the SHA-256 of its full-resolution RGB tensor."""
    layouts, quants, rows, base = read_coefficients(files)
    payloads = [(rows[a:b].reshape(-1)[: stored_bytes(f)] + 128).astype(np.uint8).tobytes() for f, (a, b) in zip(files, pairwise(base), strict=True)]
    units = np.array([x.blocks // 6 for x in layouts])
    plain = all((q == 1).all() for own in quants for q in own)
    if plain and all(x.sampling == SAMPLING and x.width == 16 for x in layouts):  # all pictures at once, unit by unit
        samples = inverse_transform(rows.astype(np.float32))
        unit = np.arange(int(units.sum())) - np.repeat(np.cumsum(units) - units, units)
        first, many = np.repeat(np.array(base[:-1]), units), np.repeat(units, units)
        y = samples[(first + 4 * unit)[:, None] + np.arange(4)].reshape(-1, 2, 2, 8, 8).swapaxes(2, 3).reshape(-1, 16, 16)
        chroma = [samples[first + (4 + c) * many + unit].repeat(2, axis=1).repeat(2, axis=2) for c in (0, 1)]
        rgb = _rgb(y, *chroma)
        tensors_of = np.split(rgb.reshape(-1, 16, 3), 16 * np.cumsum(units)[:-1])
    else:
        tensors_of = [picture(x, q, rows[a:b]) for x, q, (a, b) in zip(layouts, quants, pairwise(base), strict=True)]
    features = []
    for x, t in zip(layouts, tensors_of, strict=True):
        s = t.reshape(-1, 3).sum(axis=0, dtype=np.int64)
        features.append(f"{x.width}x{x.height}:{s[0]}:{s[1]}:{s[2]}:{hashlib.sha256(np.ascontiguousarray(t)).hexdigest()}")
    return payloads, features


def _groups(sizes: list[int]) -> Iterator[slice]:
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > TOGETHER:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores every text as a picture, reads it back and describes both."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["t"].tolist()
            lengths = [len(t) if isinstance(t, str) else 1 for t in texts]
            for part in _groups(lengths):
                given = [payload_of(t) for t in texts[part]]
                files = store([p for _, p in given])
                back, features = restore(files)
                yield pd.DataFrame(
                    {
                        "doc_id": b["k"].iloc[part].values,
                        "n_bytes": [n for n, _ in given],
                        "payload_bytes": [len(p) for p in back],
                        "payload_sha256": [hashlib.sha256(p).hexdigest() for p in back],
                        "tail_crc32": [zlib.crc32(p[-16:]) for p in back],
                        "media_bytes": [len(f) for f in files],
                        "media_sha256": [hashlib.sha256(f).hexdigest() for f in files],
                        "feature": features,
                    }
                )

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t")).mapInPandas(run, schema)


def tensors(files: DataFrame, id_col: str = "id", data_col: str = "content") -> DataFrame:
    """id, width, height and rgb (packed bytes) of each progressive file; null files give null tensors."""
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, x in zip(b["i"], b["d"], strict=True):
                if x is None:
                    yield pd.DataFrame({"id": [i], "width": pd.array([None], "Int32"), "height": pd.array([None], "Int32"), "rgb": [None]})
                else:
                    t = decode([bytes(x)])[0]
                    yield pd.DataFrame({"id": [i], "width": pd.array([t.shape[1]], "Int32"), "height": pd.array([t.shape[0]], "Int32"), "rgb": [t.tobytes()]})

    return files.select(F.col(id_col).alias("i"), F.col(data_col).alias("d")).mapInPandas(run, f"id {kind}, width int, height int, rgb binary")
