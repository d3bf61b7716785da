"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

Each word is a vector of two halves: a hashed word embedding and the mean of hashed embeddings of its
character 4-grams (bytes, with its borders). A forward and a backward gated recurrent layer read windows
of 32 words that overlap by half; attention pools the states of a window into one logit, and a
document's logit is the largest of all its windows, over the whole text. Scores are calibrated on documents.

The network is fitted in one task with Adam on a bounded sample of labelled rows (``SAMPLE`` of each
label, in hash order; of a text with more than ``TRAINED`` characters, runs of words chosen by hash up to that length),
never on rows with crc32(doc_id) mod 5 = 0; of a repeated id its least text. The first coordinate of each embedding
starts at the label's log odds of its bucket. Labels, lang, source and doc_id are no inputs.

Null and empty texts are one window without words; a very long text is read in segments of a megabyte that overlap by a
window; equal texts have equal scores; rows with several labels are toxic if any says so; without labels of both kinds
every score is the share of toxic ones (0.5 without labels); labels without a text and empty tables are fine; extra columns
are ignored or kept, whatever they are called.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import textgrams as tg
from foliospark.llm.common import give_back, text_parts, tidy

#: Labelled rows of each label that the fit sees at most, and characters of each: 100 million characters in the task that fits at most.
SAMPLE, TRAINED = 2500, 20_000
WINDOW, STRIDE = 32, 16
BUCKETS, DIM, HIDDEN = 1 << 15, 8, 8
_JOIN = 1 << 20
#: Of the fit: bytes of text hashed at once, texts counted at once, and windows at once.
FIT_BYTES, FIT_TEXTS, AT_ONCE = 1 << 18, 200, 4096
_SPACE = re.compile(r"\s")

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _pieces(texts: list[str | None], together: int = _JOIN) -> Iterator[tuple[bytes, np.ndarray]]:
    """Joined texts of about ``together`` bytes and the text's index of each byte's block: (bytes, ends by text)."""
    group: list[bytes] = []
    held = 0
    for t in texts:
        data = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        group.append(data)
        held += len(data)
        if held >= together:
            yield b" ".join(group), np.cumsum([len(x) + 1 for x in group])
            group, held = [], 0
    if group:
        yield b" ".join(group), np.cumsum([len(x) + 1 for x in group])


def _segments(text: str | None) -> Iterator[str | None]:
    """The text, or if it is very long its segments, each of which takes up a window of words before its start."""
    if not isinstance(text, str) or len(text) <= _JOIN:
        yield text
        return
    start = 0
    while start < len(text):
        space = _SPACE.search(text, min(len(text), start + _JOIN))
        end, back = space.start() if space else len(text), start
        for _ in range(WINDOW if start else 0):
            found = text.rfind(" ", max(0, start - _JOIN), back)
            back = found if found >= 0 else back
        yield text[back:end]
        start = end


def _trained_part(text: str) -> str:
    """The text, or if it is long, runs of its words in hash order up to TRAINED characters."""
    if len(text) <= TRAINED:
        return text
    words = text.split()
    runs = [" ".join(words[i : i + 4 * WINDOW])[:TRAINED] for i in range(0, len(words), 4 * WINDOW)]
    out, held = [], 0
    for run in sorted(runs, key=lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass"))):
        if held + len(run) <= TRAINED:
            out.append(run)
            held += len(run) + 1
    return " ".join(out)


class Words:
    """Distinct words of a piece: ``word`` bucket, ``grams`` buckets and ``first`` gram of each; ``ids`` and ``doc`` of each occurrence."""

    def __init__(self, data: bytes, ends: np.ndarray):
        raw = np.frombuffer(b" " + data + b"    ", dtype=np.uint8)
        is_word = _IS_WORD[raw]
        low = np.where(is_word, np.where((raw >= 65) & (raw <= 90), raw + 32, raw), 32).astype(np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        with np.errstate(over="ignore"):
            h = tg.mix(tg._ranges(low.astype(np.uint64) + np.uint64(1), start, end, tg._P)) if len(start) else np.zeros(0, dtype=np.uint64)
        keys, at, self.ids = np.unique(h, return_index=True, return_inverse=True)
        self.keys = keys
        self.doc = np.searchsorted(ends, start - 1, side="right")
        self.word = (keys % np.uint64(BUCKETS)).astype(np.int64)
        s, n = start[at], np.maximum(end[at] - start[at] - 1, 1)
        self.first = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else np.zeros(0, dtype=np.int64)
        place = np.repeat(s - 1 - self.first, n) + np.arange(int(n.sum()))
        wide = low.astype(np.uint64)
        gram = wide[place] | (wide[place + 1] << np.uint64(8)) | (wide[place + 2] << np.uint64(16)) | (wide[np.minimum(place + 3, len(wide) - 1)] << np.uint64(24))
        self.grams = (tg.mix(gram) % np.uint64(BUCKETS)).astype(np.int64)
        self.n_grams = n


    @staticmethod
    def of(texts: list[str | None]) -> Words:
        """Of all texts, piece by piece: only distinct words and the occurrences' numbers are held together."""
        parts, docs = [], 0
        for data, ends in _pieces(texts, FIT_BYTES):
            w = Words(data, ends)
            w.doc, w.ids, w.grams = (w.doc + docs).astype(np.int32), w.ids.astype(np.int32), w.grams.astype(np.int32)
            docs += len(ends)
            parts.append(w)
        out = object.__new__(Words)
        sizes = [len(w.keys) for w in parts]
        keys, at, inverse = np.unique(np.concatenate([w.keys for w in parts]), return_index=True, return_inverse=True)
        before, inverse = np.cumsum([0, *sizes]), inverse.astype(np.int32)
        out.keys, out.word = keys, (keys % np.uint64(BUCKETS)).astype(np.int64)
        out.ids = np.concatenate([inverse[b + w.ids] for b, w in zip(before, parts, strict=False)])
        out.doc = np.concatenate([w.doc for w in parts])
        held = np.cumsum([0, *(len(w.grams) for w in parts)])
        first = np.concatenate([w.first + h for h, w in zip(held, parts, strict=False)])[at]
        out.n_grams = np.concatenate([w.n_grams for w in parts])[at]
        out.first = np.cumsum(out.n_grams) - out.n_grams
        grams = np.concatenate([w.grams for w in parts])
        total = int(out.n_grams.sum())
        out.grams = grams[np.repeat(first - out.first, out.n_grams) + np.arange(total)]
        return out


def _windows(ids: np.ndarray, doc: np.ndarray, n_docs: int, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of each window (``none`` where it has no more) and its text; a text without words has one empty window."""
    counts = np.bincount(doc, minlength=n_docs)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    n_windows = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    of = np.repeat(np.arange(n_docs), n_windows)
    turn = np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(n_windows)[:-1])), n_windows)
    padded, out = np.append(ids, none).astype(np.int32), np.empty((len(of), WINDOW), dtype=np.int32)
    for a in range(0, len(of), 8192):  # some windows at once, as places are wider than numbers
        place = turn[a : a + 8192, None] * STRIDE + np.arange(WINDOW)[None, :]
        mine = of[a : a + 8192]
        out[a : a + 8192] = padded[np.where(place < counts[mine][:, None], place + begin[mine][:, None], -1)]
    return out, of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """Parameters and both passes; float32 throughout."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        r = lambda *shape: (g.standard_normal(shape) * 0.2).astype(np.float32)
        self.p = {"word": r(BUCKETS + 1, DIM) * 0.1, "char": r(BUCKETS, DIM) * 0.1, "v": r(2 * HIDDEN), "w": r(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": r(2 * DIM, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": r(HIDDEN, 3 * HIDDEN)}
        self.scale, self.shift = 1.0, 0.0
        self.constant: float | None = None

    def vectors(self, w: Words) -> np.ndarray:
        """A row for each distinct word, and one of zeros at the end for no word."""
        out = np.zeros((len(w.word) + 1, 2 * DIM), dtype=np.float32)
        for a in range(0, len(w.word), 20_000):  # some words at once, as each has several grams
            b = min(len(w.word), a + 20_000)
            start, end = w.first[a], w.first[b - 1] + w.n_grams[b - 1]
            out[a:b, :DIM] = self.p["word"][w.word[a:b]]
            out[a:b, DIM:] = np.add.reduceat(self.p["char"][w.grams[start:end]], w.first[a:b] - start, axis=0) / w.n_grams[a:b, None].astype(np.float32)
        return out

    def _run(self, inputs: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """inputs: projections (steps, windows, 3 * HIDDEN), in reading order."""
        u, n = self.p[f"U{d}"], inputs.shape[1]
        h, out = np.zeros((n, HIDDEN), dtype=np.float32), np.empty((len(inputs), n, HIDDEN), dtype=np.float32)
        for t, x in enumerate(inputs):
            hu = h @ u
            zr = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            cand = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((h, z, r, cand, hu[:, 2 * HIDDEN :]))
            h = cand + z * (h - cand)
            out[t] = h
        return out

    def logits(self, vectors: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; ids: rows of ``vectors`` (windows, WINDOW), the last row for none."""
        steps = ids.T
        mask = steps != len(vectors) - 1
        states = []
        for d in "fb":
            table = vectors @ self.p[f"W{d}"] + self.p[f"c{d}"]
            order = steps if d == "f" else steps[::-1]
            kept: list | None = [] if keep is not None else None
            out = self._run(table[order], d, kept)
            states.append(out if d == "f" else out[::-1])
            if keep is not None:
                keep[d] = kept
        h = np.concatenate(states, axis=2)
        e = np.where(mask, h @ self.p["v"], np.float32(-1e4))
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep |= {"h": h, "a": a, "pooled": pooled, "mask": mask}
        return pooled @ self.p["w"] + self.p["b"][0]

    def gradients(self, vectors: np.ndarray, ids: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the weighted log loss, by parameter; and by row of ``vectors``."""
        k: dict = {}
        logit = self.logits(vectors, ids, k)
        g = ((_sigmoid(logit) - label) * weight / len(ids)).astype(np.float32)
        out = {"w": k["pooled"].T @ g, "b": np.array([g.sum()], np.float32)}
        gp = g[:, None] * self.p["w"]
        h, a = k["h"], k["a"]
        ga = (h * gp[None]).sum(axis=2)
        ge = a * (ga - (a * ga).sum(axis=0)) * k["mask"]
        gh = a[:, :, None] * gp[None] + ge[:, :, None] * self.p["v"]
        out["v"] = np.einsum("twh,tw->h", h, ge)
        gv = np.zeros_like(vectors)
        steps = ids.T
        for n, d in enumerate("fb"):
            mine = gh[:, :, n * HIDDEN : (n + 1) * HIDDEN]
            mine = mine if d == "f" else mine[::-1]
            order = steps if d == "f" else steps[::-1]
            u, gx = self.p[f"U{d}"], np.empty((len(steps), len(ids), 3 * HIDDEN), np.float32)
            gu, carry = np.zeros_like(u), np.zeros((len(ids), HIDDEN), np.float32)
            for t in range(len(steps) - 1, -1, -1):
                before, z, r, cand, un = k[d][t]
                carry = carry + mine[t]
                gc = carry * (1 - z) * (1 - cand * cand)
                gz = carry * (before - cand) * z * (1 - z)
                gr = gc * un * r * (1 - r)
                gx[t] = np.concatenate([gz, gr, gc], axis=1)
                gh_u = np.concatenate([gz, gr, gc * r], axis=1)
                gu += before.T @ gh_u
                carry = carry * z + gh_u @ u.T
            table = np.zeros((len(vectors), 3 * HIDDEN), np.float32)
            np.add.at(table, order.ravel(), gx.reshape(-1, 3 * HIDDEN))
            out |= {f"U{d}": gu, f"c{d}": gx.sum(axis=(0, 1)), f"W{d}": vectors.T @ table}
            gv += table @ self.p[f"W{d}"].T
        return out, gv

    def document_logits(self, texts: list[str | None], together: int = _JOIN) -> np.ndarray:
        """The largest logit of all windows of each whole text."""
        segments, first = [], [0]
        for t in texts:
            segments.extend(_segments(t))
            first.append(len(segments))
        return np.maximum.reduceat(self._piece_logits(segments, together), first[:-1]) if texts else np.zeros(0)

    def _piece_logits(self, segments: list[str | None], together: int) -> np.ndarray:
        out = []
        for data, ends in _pieces(segments, together):
            w = Words(data, ends)
            vectors = self.vectors(w)
            ids, of = _windows(w.ids, w.doc, len(ends), len(vectors) - 1)
            best = np.full(len(ends), -np.inf)
            for at in range(0, len(ids), AT_ONCE):
                np.maximum.at(best, of[at : at + AT_ONCE], self.logits(vectors, ids[at : at + AT_ONCE]))
            out.append(best)
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return np.round(_sigmoid(self.scale * self.document_logits(texts) + self.shift), 6)


def _log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Of bucket counts by label, shrunk where there are few."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    seen = toxic + clean
    return (odds * seen / (seen + 20) / 2).astype(np.float32)


def fit(texts: list[str | None], labels: np.ndarray, epochs: int = 6, seed: int = 7) -> Net:
    """The network fitted to labelled texts."""
    net = Net(seed)
    labels = np.asarray(labels, dtype=np.float32)
    n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
    if not n1 or not n0:
        net.constant = float(labels.mean()) if len(labels) else 0.5
        return net
    w = Words.of(texts)
    give_back()  # of many small pieces
    none = len(w.word)
    ids, of = _windows(w.ids, w.doc, len(texts), none)
    counts = np.zeros((2, 2, BUCKETS), dtype=np.float64)  # by kind of bucket and label, in documents
    edges = np.searchsorted(w.doc, np.arange(0, len(texts) + FIT_TEXTS, FIT_TEXTS))
    for a, b in pairwise(edges.tolist()):
        once = np.unique(w.doc[a:b] * np.int64(none + 1) + w.ids[a:b])
        text, word = once // (none + 1), once % (none + 1)
        total = w.n_grams[word]
        at = np.repeat(w.first[word] - np.concatenate(([0], np.cumsum(total)[:-1])), total) + np.arange(int(total.sum()))
        for kind, (whose, bucket) in enumerate(((text, w.word[word]), (np.repeat(text, total), w.grams[at]))):
            pairs = np.unique(whose * np.int64(BUCKETS) + bucket)
            np.add.at(counts[kind], (labels[pairs // BUCKETS].astype(int), pairs % BUCKETS), 1)
    net.p["word"][:BUCKETS, 0] = _log_odds(counts[0, 1], counts[0, 0], n1, n0)
    net.p["char"][:, 0] = _log_odds(counts[1, 1], counts[1, 0], n1, n0)
    start = net.vectors(w)
    hint = np.maximum(start[:, 0], start[:, DIM])
    del start
    guess = np.concatenate([hint[ids[a : a + 8192]].max(axis=1) for a in range(0, len(ids), 8192)])
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.p.items()}
    random, turn = np.random.default_rng(seed), 0
    first = np.searchsorted(of, np.arange(len(texts)))
    spread = np.searchsorted(of, np.arange(len(texts)), side="right") - first
    for epoch in range(epochs):
        if epoch >= 2:  # from now on the network itself says which window of a text counts
            vectors = net.vectors(w)
            guess = np.concatenate([net.logits(vectors, ids[a : a + AT_ONCE]) for a in range(0, len(ids), AT_ONCE)])
        best = np.lexsort((guess, of))[np.cumsum(spread) - 1]
        extra = first[labels == 0] + (random.random(n0) * spread[labels == 0]).astype(int)
        chosen = np.concatenate((best, extra))
        target = labels[of[chosen]]
        weight = np.where(target == 1, len(chosen) / (2 * n1), len(chosen) / (2 * (len(chosen) - n1))).astype(np.float32)
        order = random.permutation(len(chosen))
        for a in range(0, len(order), 128):
            at = order[a : a + 128]
            rows, local = np.unique(ids[chosen[at]], return_inverse=True)
            if rows[-1] != none:
                rows = np.append(rows, none)
            sub = net.vectors_of(w, rows[:-1])
            grads, gv = net.gradients(sub, local.reshape(len(at), WINDOW), target[at], weight[at])
            grads["word"] = np.zeros_like(net.p["word"])
            np.add.at(grads["word"], w.word[rows[:-1]], gv[:-1, :DIM])
            total = w.n_grams[rows[:-1]]
            where = np.repeat(w.first[rows[:-1]] - np.concatenate(([0], np.cumsum(total)[:-1])), total) + np.arange(int(total.sum()))
            grads["char"] = np.zeros_like(net.p["char"])
            np.add.at(grads["char"], w.grams[where], np.repeat(gv[:-1, DIM:] / total[:, None], total, axis=0))
            turn += 1
            for k, x in net.p.items():
                m, v = moments[k]
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                rate = 0.003 if k in ("word", "char") else 0.01
                x -= (rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    z = net.document_logits(texts, FIT_BYTES)
    scale, shift = 1.0, -float(np.median(z))
    for _ in range(500):  # calibration on whole documents; clean ones weigh more, as they are more frequent
        p = _sigmoid(scale * z + shift)
        g = (p - labels) * np.where(labels == 1, 0.25 / n1, 0.75 / n0)
        scale -= 0.2 * (float((g * z).sum()) + 0.001 * (scale - 1))
        shift -= 0.2 * float(g.sum())
    net.scale, net.shift = scale, shift
    return net


def _vectors_of(self: Net, w: Words, rows: np.ndarray) -> np.ndarray:
    """``vectors`` of some distinct words only."""
    out = np.zeros((len(rows) + 1, 2 * DIM), dtype=np.float32)
    if len(rows):
        total = w.n_grams[rows]
        first = np.concatenate(([0], np.cumsum(total)[:-1]))
        where = np.repeat(w.first[rows] - first, total) + np.arange(int(total.sum()))
        out[:-1, :DIM] = self.p["word"][w.word[rows]]
        out[:-1, DIM:] = np.add.reduceat(self.p["char"][w.grams[where]], first, axis=0) / total[:, None].astype(np.float32)
    return out


Net.vectors_of = _vectors_of


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Net:
    """A network from a bounded sample of the labelled rows outside the held-out fold."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.select("doc_id", "text").where(~held_out()).where("text IS NOT NULL")
    known = usable.select("doc_id", F.xxhash64("doc_id").alias("order")).distinct().join(marks, "doc_id")  # ids only
    zero, one = (known.where(F.col("toxic") == y).orderBy("order", "doc_id").limit(SAMPLE) for y in (0, 1))
    chosen = F.broadcast(zero.union(one))  # 2 * SAMPLE ids at most

    def shortened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[_trained_part(t) for t in b["text"]])

    found = usable.join(chosen, "doc_id")
    rows = found.select("toxic", "order", F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(tidy(shortened), "toxic int, order long, doc_id string, text string")
    sample = rows.groupBy("toxic", "order", "doc_id").agg(F.min("text").alias("text")).repartition(1)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            known = pd.concat(parts, ignore_index=True).sort_values(["toxic", "order", "doc_id"])
            yield pd.DataFrame({"net": [pickle.dumps(fit(known["text"].tolist(), known["toxic"].to_numpy(), seed=seed))]})

    made = sample.mapInPandas(tidy(fitted), "net binary").collect()  # two embedding tables of BUCKETS rows
    return pickle.loads(made[0]["net"]) if made else fit([], np.zeros(0), seed=seed)


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of a fixed size: two embedding tables of BUCKETS rows
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in text_parts(batches):
            yield pd.DataFrame({"doc_id": b["k"].values, "score": shared.value.scores(b["t"].tolist())})

    return docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t")).mapInPandas(tidy(run), f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with a score below 0.5, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shared.value.scores(b.column(place).slice(at, 500).to_pylist()) for at in range(0, b.num_rows, 500)]
            yield b.filter(pa.array(np.concatenate([np.zeros(0), *scores]) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
