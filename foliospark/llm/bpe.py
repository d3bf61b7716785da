"""Byte-level BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list decides where a token ends after a bounded number of further bytes. That number, the
*sufficient lookahead*, is computed from the list itself: whether rule ``(a, b)`` fires at a place can
only be changed by lower-ranked rules that take ``b`` (or a piece of its right edge) to the right, so the
reach of every rule follows from the reaches of lower-ranked ones, in one pass in rank order. Every
pre-token is pushed through a buffer of a few lookaheads: what ends a lookahead before the end of
the buffer is stable and is emitted, the rest is kept. What the transducer gave for a pre-token is remembered in
REMEMBERED bytes at most. New pre-tokens of some megabytes of texts, if their buffers never fill, are merged side by side, one merge of
each at a time. Memory doesn't grow with the text.

Null texts count as empty (0 tokens); equal rows give equal rows, null and repeated ids too; empty tables give
empty results; very long texts go chunk by chunk; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import text_parts, tidy, tokenizer_path

#: Fixed value: the pre-token pattern of the public byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters handed to the transducer at once.
CHUNK = 1 << 16
#: Bytes of pre-tokens and ids that a worker remembers, about; the memory is emptied when full.
REMEMBERED = 24 << 20
#: Bytes of the longest pre-tokens that are merged side by side, how many at least, and at once.
SHORT, FEW, ROWS = 64, 200, 2048


def printable_bytes() -> dict[str, int]:
    """The printable character of each byte in a byte-level vocabulary: itself if visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in visible}
    for b in range(256):
        if b not in visible:
            out[chr(256 + len(out) - len(visible))] = b
    return out


class MergeTable:
    """Ranks, tokens' bytes, special strings and the sufficient lookahead of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = printable_bytes()
        vocab = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.special = special
        size = max([*vocab.values(), *special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [0] * 256
        for c, b in to_byte.items():
            if c in vocab:
                self.byte_id[b] = vocab[c]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.rank = {pair: rank for pair, (rank, _) in self.merge.items()}
        self.made = {rank: made for rank, made in self.merge.values()}
        self.none = len(self.merge) + 1_000_000
        self.id_text = [str(i) for i in range(size)]
        self.ids = list(range(size))  # one object for each id, wherever it is remembered
        self.pad = size
        pairs = np.array([a * (size + 1) + b for a, b in self.rank] + [np.iinfo(np.int64).max], dtype=np.int64)
        by = np.argsort(pairs)
        self._pairs, self._ranks = pairs[by], np.array([*self.rank.values(), self.none], dtype=np.int64)[by]
        self._made = np.zeros(len(self.merge) and max(self.made) + 1, dtype=np.int64)
        self._made[list(self.made)] = list(self.made.values())
        self._bytes = np.array(self.byte_id, dtype=np.int64)
        self._first = self._ranks_of(np.repeat(self._bytes, 256), np.tile(self._bytes, 256)).astype(np.int32)  # of two bytes
        self.lookahead = self._sufficient_lookahead()
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def _sufficient_lookahead(self) -> int:
        """Bytes after a token's end that can still change it, at most."""
        onward: dict[int, int] = {}  # token -> reach of the rules with it on the left, so far
        edge: dict[int, int] = {}  # token -> bytes after its end on which its forming depends
        most = 1
        for (a, b), (_, made) in sorted(self.merge.items(), key=lambda x: x[1][0]):
            after_b = max(edge.get(b, 0), onward.get(b, 0))
            reach = len(self.token_bytes[b]) + after_b
            onward[a] = max(onward.get(a, 0), reach)
            edge[made] = max(edge.get(made, 0), after_b)
            most = max(most, reach)
        return most

    def encode_bytes(self, data: bytes) -> list[int]:
        """Merges of lowest rank first, leftmost first, until none applies."""
        ids = [self.byte_id[b] for b in data]
        get = self.merge.get
        if len(ids) <= 64:
            ranks = [*map(self.rank.get, zip(ids, ids[1:], strict=False), repeat(self.none))]
            while ranks and (low := min(ranks)) != self.none:
                i = ranks.index(low)
                ids[i : i + 2] = [self.made[low]]
                del ranks[i]
                if i:
                    ranks[i - 1] = self.rank.get((ids[i - 1], ids[i]), self.none)
                if i < len(ranks):
                    ranks[i] = self.rank.get((ids[i], ids[i + 1]), self.none)
            return ids
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if m := get((made, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, made, ids[after[i]], m[1]))
            if before[i] >= 0 and (m := get((ids[before[i]], made))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], made, m[1]))
        return [x for x in ids if x >= 0]


    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs = a * (self.pad + 1) + b
        at = np.searchsorted(self._pairs, pairs)
        return np.where(self._pairs[at] == pairs, self._ranks[at], self.none)

    def encode_side_by_side(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """``encode_bytes`` of each piece, none empty: a row of ids for each, in which every round makes the merge of lowest rank."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ids = np.full((len(pieces), int(sizes.max())), self.pad, dtype=np.int32)
        inside = np.arange(ids.shape[1]) < sizes[:, None]
        ids[inside] = self._bytes[data]
        done, rows, ranks = np.full(ids.shape, self.pad, dtype=np.int32), np.arange(len(ids)), np.full((len(ids), ids.shape[1] - 1), self.none, dtype=np.int32)
        both = np.delete(data[:-1].astype(np.int64) * 256 + data[1:], np.cumsum(sizes)[:-1] - 1)
        ranks[inside[:, 1:]] = self._first[both]
        while ranks.size:
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(at)), at]
            go = low < self.none
            if not go.all():
                done[rows[~go], : ids.shape[1]] = ids[~go]
                rows, ids, ranks, at, low = rows[go], ids[go], ranks[go], at[go], low[go]
                if not len(rows):
                    break
            n, place = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            ids = np.where(place > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[n, at] = self._made[low]
            ranks = np.where(place[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < ranks.shape[1])
            r, k = np.concatenate((left, right)), np.concatenate((at[left] - 1, at[right]))  # the pairs with what was made
            ranks[r, k] = self._ranks_of(ids[r, k].astype(np.int64), ids[r, k + 1])
        done[rows, : ids.shape[1]] = ids
        kept = done != self.pad
        flat = [*map(self.ids.__getitem__, done[kept].tolist())]
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        return [tuple(flat[x:y]) for x, y in zip([0, *ends], ends, strict=False)]


class PieceTransducer:
    """Encodes one pre-token that arrives in pieces. Holds one lookahead and one token more than what arrives at once."""

    def __init__(self, table: MergeTable, lookahead: int | None = None, room: int | None = None):
        self.table, self.buffer = table, b""
        self.lookahead = table.lookahead if lookahead is None else lookahead
        self.room = room or 4 * self.lookahead

    def push(self, data: bytes) -> list[int]:
        """The ids that no further byte can change."""
        out: list[int] = []
        for k in range(0, len(data), self.room):
            self.buffer += data[k : k + self.room]
            end, stable = 0, len(self.buffer) - self.lookahead
            if stable <= 0:
                continue
            for i in self.table.encode_bytes(self.buffer):
                step = end + len(self.table.token_bytes[i])
                if step > stable:
                    break
                out.append(i)
                end = step
            self.buffer = self.buffer[end:]
        return out

    def finish(self) -> list[int]:
        out, self.buffer = self.table.encode_bytes(self.buffer), b""
        return out


class _Remembered(dict):
    """Ids by pre-token; a missing one goes through the transducer."""

    def __init__(self, table: MergeTable):
        super().__init__()
        self.table, self.held = table, 0

    def __missing__(self, piece: str) -> tuple[int, ...]:
        t = PieceTransducer(self.table)
        ids = (*t.push(piece.encode("utf-8", "surrogatepass")), *t.finish())
        self.held += 200 + len(piece) + 8 * len(ids)
        if self.held > REMEMBERED:
            self.clear()
            self.held = 0
        else:
            self[piece] = ids
        return ids

    def learn(self, texts: list[list[str]]) -> None:
        """Remembers the pieces of texts, if those that are new aren't few; what doesn't fill a buffer is encoded together."""
        pieces = set().union(*texts)
        new = [p for p in pieces if p not in self]
        if len(new) < FEW:
            return
        if self.held + sum(200 + 9 * len(p) for p in new) > REMEMBERED:
            self.clear()
            self.held, new = 0, pieces
        most = min(SHORT, self.table.lookahead)
        short = sorted(((len(d), p, d) for p in new if 0 < len(d := p.encode("utf-8", "surrogatepass")) <= most), key=lambda x: x[0])
        for k in range(0, len(short), ROWS):
            some = short[k : k + ROWS]
            for (_, p, _), ids in zip(some, self.table.encode_side_by_side([d for _, _, d in some]), strict=True):
                self[p] = ids
                self.held += 200 + len(p) + 8 * len(ids)


_RUNS = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "O": regex.compile(r"[^\s\p{L}\p{N}]*"), "S": regex.compile(r"\s*")}


def _kind(c: str) -> str:
    return "S" if c.isspace() or regex.match(r"\s", c) else "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "O"


class StreamingEncoder:
    """feed(text) gives the ids that are settled so far, finish() the rest.

    Text is cut only where a non-space is followed by a space, which no pre-token crosses. A run
    without such a place that outgrows a chunk is handed on piece by piece as one open pre-token.
    """

    def __init__(self, table: MergeTable, remembered: _Remembered | None = None):
        self.table = table
        self.known = remembered if remembered is not None else _Remembered(table)
        self.split = regex.compile(PATTERN).findall
        self.last_cut = regex.compile(r"(?r)(?<=\S)(?=\s)")
        self.pending, self.open, self.kind = "", None, ""

    def _pieces(self, text: str) -> Iterable[int]:
        return chain.from_iterable(map(self.known.__getitem__, self.split(text)))

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        self.pending += text
        if self.open is not None:
            self._go_on(out)
            if self.open is not None:
                return out
        if len(self.pending) < CHUNK:
            return out
        m = self.last_cut.search(self.pending)
        if m and m.start() > 0:
            out.extend(self._pieces(self.pending[: m.start()]))
            self.pending = self.pending[m.start() :]
        else:
            pieces = self.split(self.pending)
            done = "".join(pieces[:-2])
            out.extend(chain.from_iterable(map(self.known.__getitem__, pieces[:-2])))
            self.pending = self.pending[len(done) :]
        if len(self.pending) >= CHUNK:
            first = self.split(self.pending)[0]
            if len(first) >= CHUNK // 2:
                self.open, self.kind = PieceTransducer(self.table), _kind(first[-1])
                if first[0] == " " and self.kind != "S":
                    out.extend(self.open.push(b" "))
                    self.pending = self.pending[1:]
                self._go_on(out)
        return out

    def _go_on(self, out: list[int]) -> None:
        """Hand on what belongs to the open pre-token; the last space of a run may belong to the next one."""
        end = _RUNS[self.kind].match(self.pending).end()
        held = 1 if self.kind == "S" else 0
        whole = end == len(self.pending)
        take = max(0, end - held)
        out.extend(self.open.push(self.pending[:take].encode("utf-8", "surrogatepass")))
        self.pending = self.pending[take:]
        if not whole:
            out.extend(self.open.finish())
            self.open = None

    def finish(self) -> list[int]:
        out: list[int] = []
        if self.open is not None:
            out.extend(self.open.push(self.pending.encode("utf-8", "surrogatepass")))
            out.extend(self.open.finish())
            self.open, self.pending = None, ""
        out.extend(self._pieces(self.pending))
        self.pending = ""
        return out


class StreamingDecoder:
    """push(ids) gives text as soon as its bytes are whole characters; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.table.token_bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=4)
def load(path: str) -> tuple[MergeTable, _Remembered]:
    table = MergeTable(path)
    return table, _Remembered(table)


def together(texts: list[str], table: MergeTable, known: _Remembered) -> Iterator[Iterator[list[int]]]:
    """``encode_parts`` of each text; pre-tokens of those that are no longer than a chunk and hold no special string are split once and learned first."""
    split, special = regex.compile(PATTERN).findall, table.special_pattern
    pieces = [split(t) if len(t) < CHUNK and not (special and special.search(t)) else None for t in texts]
    known.learn([p for p in pieces if p is not None])
    for t, p in zip(texts, pieces, strict=True):
        yield encode_parts(t, table, known) if p is None else iter(([*chain.from_iterable(map(known.__getitem__, p))],))


def encode_parts(text: str, table: MergeTable, known: _Remembered, chunk: int = CHUNK) -> Iterator[list[int]]:
    """Settled ids of a text, part by part; special strings stand for themselves."""
    places = [(m.start(), m.end()) for m in table.special_pattern.finditer(text)] if table.special_pattern else []
    at = 0
    for start, end in [*places, (len(text), None)]:
        encoder = StreamingEncoder(table, known)
        for k in range(at, start, chunk):
            yield encoder.feed(text[k : min(start, k + chunk)])
        yield encoder.finish()
        if end is not None:
            yield [table.special[text[start:end]]]
            at = end


def encode_text(text: str, path: str | None = None) -> list[int]:
    table, known = load(path or tokenizer_path())
    return [i for part in encode_parts(text, table, known) for i in part]


def decode_ids(ids: Iterable[int], path: str | None = None) -> str:
    decoder = StreamingDecoder(load(path or tokenizer_path())[0])
    return decoder.push(ids) + decoder.finish()


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every text; null counts as empty."""
    path = path or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = load(path)
        for b in text_parts(batches):
            texts = [t if isinstance(t, str) else "" for t in b["t"]]
            yield pd.DataFrame({"doc_id": b["k"], "ids": [list(chain.from_iterable(parts)) for parts in together(texts, table, known)]})

    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInPandas(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every id list; null counts as empty."""
    path = path or tokenizer_path()
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, _ = load(path)
        for b in batches:
            out = []
            for ids in b["ids"]:
                d = StreamingDecoder(table)
                out.append(d.push(ids if ids is not None else []) + d.finish())
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": out})

    return encoded.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, text string")


def round_trip_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, exact of every whole text, in one pass and without keeping the ids."""
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = load(path)
        number = table.id_text.__getitem__
        for b in text_parts(batches):
            rows = []
            texts = [t if isinstance(t, str) else "" for t in b["t"]]
            for text, parts in zip(texts, together(texts, table, known), strict=True):
                ids_sha, text_sha, n, decoder = hashlib.sha256(), hashlib.sha256(), 0, StreamingDecoder(table)
                for part in parts:
                    if not part:
                        continue
                    ids_sha.update((("," if n else "") + ",".join(map(number, part))).encode())
                    n += len(part)
                    text_sha.update(decoder.push(part).encode("utf-8", "surrogatepass"))
                text_sha.update(decoder.finish().encode())
                rows.append((n, ids_sha.hexdigest(), text_sha.hexdigest(), text_sha.digest() == hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "exact"])
            out.insert(0, "doc_id", b["k"].values)
            yield out

    return docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t")).mapInPandas(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
