"""Removal of word windows that also start in a document with a smaller id, behind a count-min prefilter.

Texts are dealt once into groups of a few megabytes, by a hash of id and text. Every window has an *anchor*, the
least hash among its half-length shingles, so equal windows have equal anchors and a text has about one anchor for
thirteen words.

First pass: each group counts its anchors into a partial count-min sketch of two rows, whose slices have CELLS cells a
row each and whose number follows from the input's size; only the cells in use are sent. A slice's partial sketches are
merged by addition (two is as good as many), and each group learns which of its anchors are estimated in two documents or
more. The merged estimate is never below the number of documents that hold the window, so a window with an
estimate of one is unique: none that repeats is lost.

Second pass: a group sends each distinct window with such an anchor once (80 bits of hash and its least document id in
the group), so a passage of all documents is one row a group. A slice's least ids are exact, and each group learns
where its own isn't the least. Third, each group takes out the words of its repeated windows.

Windows are judged on the input. Rows with a null id take part in nothing and lose nothing; null and short texts
lose nothing; rows with equal ids are one document and don't count against one another; very long texts are groups
of their own size; empty tables give empty results; extra columns are ignored or kept, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliospark.llm import textgrams as tg

#: Cells of a row of a sketch's slice, and anchors expected in a slice.
CELLS, EXPECTED = 1 << 20, 1 << 17
_REPLY = "g long, s long, bits binary"


def _anchors(texts: list[str | None], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their offsets, window starts that stay in their text, and the anchor of each."""
    words, offsets = tg.word_hashes(texts)
    half = max(1, window // 2)
    starts = np.flatnonzero(tg.inside(offsets, window))
    if not len(starts):
        return words, offsets, starts, np.zeros(0, dtype=np.uint64)
    least = tg.sliding_min(tg.windows(words, half), window - half + 1)
    return words, offsets, starts, least[starts]


def _by_slice(slices: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slice numbers and where they stand, from numbers in order."""
    edge = np.flatnonzero(np.concatenate(([True], slices[1:] != slices[:-1], [True]))) if len(slices) else []
    for a, b in pairwise(edge):
        yield int(slices[a]), slice(int(a), int(b))


def _slices(keys: np.ndarray, n: int) -> np.ndarray:
    """Slice of each of the sorted keys: equal ranges, so slices are in order too."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _distinct(texts: list[str | None], ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors in order, and whether two documents of the group or more have them."""
    _, offsets, starts, anchor = _anchors(texts, window)
    if not len(starts):
        return anchor, np.zeros(0, dtype=bool)
    doc = ids[tg.owner(offsets)[starts]]
    changed = np.ones(len(anchor), dtype=bool)  # neighbours mostly have the same anchor
    changed[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    anchor, doc = anchor[changed], doc[changed]
    order = np.lexsort((doc, anchor))
    anchor, doc = anchor[order], doc[order]
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    return anchor[first], doc[first] != doc[np.append(first[1:], len(doc)) - 1]


def _cells(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple((tg.mix(anchor, 77 + row) % np.uint64(CELLS)).astype(np.uint32) for row in (0, 1))


def _merged_sketch(rows: pd.DataFrame) -> pd.DataFrame:
    """Which cells of each partial sketch (g, s, one, two, many) are estimated at two or more in the sum of all."""
    sizes = [len(x) // 4 for x in rows["one"]]
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows["many"], sizes, strict=True)])
    least = None
    for row in ("one", "two"):
        cells = np.frombuffer(b"".join(rows[row]), dtype=np.uint32)
        total = np.bincount(cells, weights=1.0 + many, minlength=CELLS)[cells]
        least = total if least is None else np.minimum(least, total)
    bits = [np.packbits(x >= 2).tobytes() for x in np.split(least, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"g": rows["g"], "s": rows["s"], "bits": bits})


def _not_least(rows: pd.DataFrame) -> pd.DataFrame:
    """For each window of each row (g, s, h1, h2, k): whether another group has it in a document with a smaller id."""
    h1, h2, k = (np.frombuffer(b"".join(rows[c]), dtype=kind) for c, kind in (("h1", np.uint64), ("h2", np.uint16), ("k", np.int64)))
    order = np.lexsort((k, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = k[order][np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
    out = np.zeros(len(a), dtype=bool)
    out[order] = k[order] > least
    bits = [np.packbits(x).tobytes() for x in np.split(out, np.cumsum([len(x) // 8 for x in rows["k"]])[:-1])]
    return pd.DataFrame({"g": rows["g"], "s": rows["s"], "bits": bits})


def _answers(replies: pa.Table, keys: np.ndarray, slices: int) -> np.ndarray:
    """The replies' bit of each of the sorted keys."""
    got = dict(zip(replies.column("s").to_pylist(), replies.column("bits").to_pylist(), strict=True))
    out = np.zeros(len(keys), dtype=bool)
    for s, at in _by_slice(_slices(keys, slices)):
        if s in got:
            out[at] = np.unpackbits(np.frombuffer(got[s], np.uint8), count=at.stop - at.start).astype(bool)
    return out


class _Windows:
    """The windows of a group whose anchors are estimated to repeat: text, place and hash of each, and each distinct one's least id."""

    def __init__(self, texts: list[str | None], ids: np.ndarray, flagged: np.ndarray, window: int):
        words, offsets, starts, anchor = _anchors(texts, window)
        starts = starts[np.isin(anchor, flagged)] if len(flagged) else starts[:0]
        self.doc = tg.owner(offsets)[starts]
        self.place = starts - offsets[self.doc]
        self.ids = ids[self.doc]
        h1 = tg.windows(words, window)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
        h2 = (tg.windows(words, window, 991)[starts] >> np.uint64(48)).astype(np.uint16) if len(starts) else np.zeros(0, dtype=np.uint16)
        order = np.lexsort((self.ids, h2, h1))
        a, b = h1[order], h2[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.h1, self.h2, self.least = a[new], b[new], self.ids[order][new]
        self.which = np.zeros(len(a), dtype=np.int64)
        self.which[order] = np.cumsum(new) - 1

    def repeated(self, elsewhere: np.ndarray) -> np.ndarray:
        return elsewhere[self.which] | (self.ids > self.least[self.which])


def _columns(t: pa.Table) -> tuple[list[str | None], np.ndarray]:
    return t.column("t").to_pylist(), t.column("k").to_numpy().astype(np.int64)


def _by_group(rows: DataFrame, replies: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType | str) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:  # Spark looks at the signature of what it is given
        return fn(left, right)

    return rows.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(run, schema)


def _changed(docs: DataFrame, window: int, id_col: str, text_col: str, change: Callable[[pa.Table, list[bytes | None]], pa.Table], schema: StructType | str) -> DataFrame:
    """``change`` of each group of rows (g, k, t, row) and the packed starts of each row's repeated windows, for rows with an id."""
    known = docs.where(F.col(id_col).isNotNull())
    total = known.agg(F.sum(F.length(text_col))).first()[0] or 0
    groups = max(1, math.ceil(total / min(16 << 20, max(4 << 20, 200 * math.sqrt(total)))))
    slices = max(1, math.ceil(total / 80 / EXPECTED))
    key = F.col(id_col).cast("long")
    rows = known.select(F.pmod(F.xxhash64(key, text_col), F.lit(groups)).alias("g"), key.alias("k"), F.col(text_col).alias("t"), F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row"))

    def sketch(group: pa.Table) -> pa.Table:
        anchor, many = _distinct(*_columns(group), window)
        one, two = _cells(anchor)
        out = [(s, one[at].tobytes(), two[at].tobytes(), np.packbits(many[at]).tobytes()) for s, at in _by_slice(_slices(anchor, slices))]
        g = group.column("g")[0].as_py()
        return pa.table({"g": pa.array([g] * len(out), pa.int64()), "s": pa.array([x[0] for x in out], pa.int64()), **{c: pa.array([x[i] for x in out], pa.binary()) for i, c in ((1, "one"), (2, "two"), (3, "many"))}})

    def candidates(group: pa.Table, replies: pa.Table) -> _Windows | None:
        if not len(group):
            return None
        texts, ids = _columns(group)
        if not len(replies):
            return None
        anchor, _ = _distinct(texts, ids, window)
        return _Windows(texts, ids, anchor[_answers(replies, anchor, slices)], window)

    def windows(group: pa.Table, replies: pa.Table) -> pa.Table:
        w = candidates(group, replies)
        out = [] if w is None else [(s, w.h1[at].tobytes(), w.h2[at].tobytes(), w.least[at].tobytes()) for s, at in _by_slice(_slices(w.h1, 2 * slices))]
        g = group.column("g")[0].as_py() if len(group) else 0
        return pa.table({"g": pa.array([g] * len(out), pa.int64()), "s": pa.array([x[0] for x in out], pa.int64()), **{c: pa.array([x[i] for x in out], pa.binary()) for i, c in ((1, "h1"), (2, "h2"), (3, "k"))}})

    def remove(group: pa.Table, replies: pa.Table) -> pa.Table:
        first = replies.filter(pa.array([s < slices for s in replies.column("s").to_pylist()], pa.bool_()))
        w = candidates(group, first)
        starts: list[bytes | None] = [None] * len(group)
        if w is not None and len(w.h1):
            second = replies.filter(pa.array([s >= slices for s in replies.column("s").to_pylist()], pa.bool_()))
            second = pa.table({"s": pa.array([s - slices for s in second.column("s").to_pylist()], pa.int64()), "bits": second.column("bits")})
            hit = np.flatnonzero(w.repeated(_answers(second, w.h1, 2 * slices)))
            for i, at in _by_slice(w.doc[hit]):
                starts[i] = w.place[hit][at].astype(np.uint32).tobytes()
        return change(group, starts)

    flags = rows.groupBy("g").applyInArrow(sketch, "g long, s long, one binary, two binary, many binary").groupBy("s").applyInPandas(_merged_sketch, _REPLY)
    exact = _by_group(rows, flags, windows, "g long, s long, h1 binary, h2 binary, k binary").groupBy("s").applyInPandas(_not_least, _REPLY)
    return _by_group(rows, flags.union(exact.withColumn("s", F.col("s") + slices)), remove, schema)


def covered_mask(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    starts = starts[starts < n]
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n), -1)
    return np.cumsum(change[:n]) > 0


def _kept(text: str | None, starts: bytes | None, window: int) -> tuple[int, int, bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not starts:
        return len(words), 0, b" ".join(words)
    gone = covered_mask(len(words), np.frombuffer(starts, np.uint32).astype(np.int64), window)
    return len(words), int(gone.sum()), b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])


def dedup(docs: DataFrame, window: int = 50, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and text (words that stay, joined by one space), or kept_sha256 with ``digest``."""
    kind, last = docs.schema[id_col].dataType, "kept_sha256" if digest else "text"
    schema = StructType().add("doc_id", kind).add("n_words", "long").add("n_removed", "long").add(last, "string")

    def told(texts: list[str | None], starts: list[bytes | None]) -> dict[str, pa.Array]:
        done = [_kept(t, p, window) for t, p in zip(texts, starts, strict=True)]
        texts_left = [hashlib.sha256(x[2]).hexdigest() if digest else x[2].decode("utf-8", "surrogatepass") for x in done]
        return {"n_words": pa.array([x[0] for x in done], pa.int64()), "n_removed": pa.array([x[1] for x in done], pa.int64()), last: pa.array(texts_left, pa.string())}

    def change(group: pa.Table, starts: list[bytes | None]) -> pa.Table:
        ids = group.column("row").combine_chunks().field(0)
        return pa.table({"doc_id": ids, **told(group.column("t").to_pylist(), starts)})

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), **told(b.column(1).to_pylist(), [None] * len(b))})

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return _changed(plain, window, "doc_id", "t", change, schema).union(plain.where("doc_id IS NULL").mapInArrow(alone, schema))


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """Documents with repeated windows taken out of their texts; a text that loses nothing stays as it is,
    one that loses all its words goes. ``size_col`` is set anew, if there is one; other columns stay."""
    names = docs.columns
    others = [c for c in names if c != text_col]

    def change(group: pa.Table, starts: list[bytes | None]) -> pa.Table:
        given = group.column("t").to_pylist()
        texts = [t if p is None else _kept(t, p, window)[2].decode("utf-8", "surrogatepass") for t, p in zip(given, starts, strict=True)]
        row = group.column("row").combine_chunks()
        fields = {c: row.field(i) for i, c in enumerate(others)}
        if size_col in fields:
            old = fields[size_col]
            new = pa.array([None if p is None else len(t) for t, p in zip(texts, starts, strict=True)], old.type)
            fields[size_col] = pa.compute.if_else(pa.array([p is None for p in starts]), old, new)
        fields[text_col] = pa.array(texts, pa.string())
        stays = pa.array([p is None or t != "" for t, p in zip(texts, starts, strict=True)], pa.bool_())
        return pa.table({c: fields[c] for c in names}).filter(stays)

    schema = StructType([docs.schema[c] for c in names])
    return _changed(docs, window, id_col, text_col, change, schema).union(docs.where(F.col(id_col).isNull()))
