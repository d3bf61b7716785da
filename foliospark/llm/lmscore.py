"""Cross-entropy difference: two matched n-gram models score each document by its loss per token.

Both models are interpolated bigram models over the words of one shared vocabulary, all words of the corpus, with the same
weights; the background model counts every document, the target model those marked as target. A document is scored by
what the other documents count: its own n-grams are taken out of each model that holds them. Its score is its loss
per token under the target model less that under the background model: the lower, the more it is like the target.

Texts are dealt once into groups of a few megabytes. A group counts its words and pairs of words (64-bit hashes) and
sends each distinct one once, dealt into slices by hash; a slice adds up the counts, which grow with the corpus and are held
nowhere together, and sends each group the totals that differ from its own counts. Only the number of words reaches the driver.

A text begins after a start mark. Null and empty texts have no tokens and a score of 0; very long texts are groups of
their own size; rows with equal ids are documents of their own and all targets if the id is; rows with a null id are none; without
target documents the target model knows no word; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import textgrams as tg
from foliospark.llm.mixing import WORD
from foliospark.llm.substring import _by_slice, _slices

#: Weights of the bigram and unigram parts and of the part for unknown words; fixed values.
WEIGHTS = (0.6, 0.3, 0.1)
#: Characters of a group, and distinct n-grams expected in a slice.
TOGETHER, EXPECTED = 8 << 20, 1 << 19
_START = np.uint64(1)


class _Grams:
    """Words and pairs of a group of texts: each text is its start mark and its words."""

    def __init__(self, texts: list[str | None], target: np.ndarray):
        words, offsets = tg.word_hashes(texts)
        self.n = np.diff(offsets)
        starts = offsets[:-1] + np.arange(len(texts))
        marks = np.zeros(len(words) + len(texts), dtype=bool)
        marks[starts] = True
        line = np.full(len(marks), _START, dtype=np.uint64)
        line[~marks] = words
        self.doc = np.repeat(np.arange(len(texts)), self.n + 1)
        at = np.flatnonzero(~marks)
        with np.errstate(over="ignore"):
            one = tg.mix(line, 101)
            two = tg.mix(tg.mix(line[at - 1], 202) * np.uint64(tg._Q) + line[at], 303)
        used = np.repeat(self.n > 0, self.n + 1)  # a text without words has no start either
        self.keys, which = np.unique(np.concatenate((one[used], two)), return_inverse=True)
        self.one = np.zeros(len(one), dtype=np.int64)
        self.one[used], self.two = which[: int(used.sum())], which[int(used.sum()) :]
        self.at = at
        every = np.concatenate((self.one[used], self.two))
        owner = np.concatenate((self.doc[used], self.doc[at]))
        self.counts = [np.bincount(every, minlength=len(self.keys)), np.bincount(every[target[owner]], minlength=len(self.keys))]

    def own(self, which: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """How often each place's n-gram occurs in its own text."""
        _, inverse, times = np.unique(doc * np.int64(len(self.keys) + 1) + which, return_inverse=True, return_counts=True)
        return times[inverse]

    def losses(self, totals: list[np.ndarray], words: tuple[int, int], target: np.ndarray) -> list[np.ndarray]:
        """Each text's sum of losses (background, target)."""
        doc, one, before = self.doc[self.at], self.one[self.at], self.one[self.at - 1]
        own_one, own_two = self.own(self.one, self.doc), self.own(self.two, doc)
        out = []
        for m in (0, 1):
            mine = np.ones(len(doc), dtype=bool) if m == 0 else target[doc]
            left = lambda total, own, mine=mine: total - np.where(mine, own, 0)
            part = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
            c2, c1 = left(totals[m][self.two], own_two), left(totals[m][one], own_one[self.at])
            context, all_words = left(totals[m][before], own_one[self.at - 1]), left(np.full(len(doc), words[m]), self.n[doc])
            p = WEIGHTS[0] * part(c2, context) + WEIGHTS[1] * part(c1, all_words) + WEIGHTS[2] / (words[0] + 1)
            out.append(np.bincount(doc, weights=-np.log(p), minlength=len(self.n)))
        return out


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes() if len(x) else b""


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, dtype=np.int64)


def _packed(keys: np.ndarray) -> bytes:
    """Keys in order: the first one and the steps to the others, in as few bytes each as the largest step needs."""
    steps = np.diff(keys).astype("<u8")
    width = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width, first = data[0], np.frombuffer(data, dtype="<u8", count=1, offset=1)
    steps = np.zeros(((len(data) - 9) // width if width else 0, 8), dtype=np.uint8)
    steps[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(-1, max(1, width)) if width else 0
    with np.errstate(over="ignore"):
        return np.cumsum(np.concatenate((first, steps.reshape(-1).view("<u8"))), dtype=np.uint64)


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the totals of the n-grams that the groups of a slice have sent (g, s, keys, b, t) differ from a group's own counts, and those totals."""
    keys = [_unpacked(x) for x in rows["keys"]]
    sizes = [len(x) for x in keys]
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    own = [np.concatenate([_wide(x, n) for x, n in zip(rows[c], sizes, strict=True)]) for c in ("b", "t")]
    totals = [np.bincount(which, weights=x).astype(np.int64)[which] for x in own]
    more = (totals[0] != own[0]) | (totals[1] != own[1])
    ends = np.cumsum(sizes)[:-1]
    parts = [np.split(x, ends) for x in (more, *totals)]
    return pd.DataFrame({"g": rows["g"], "s": rows["s"], "bits": [np.packbits(m).tobytes() for m in parts[0]], **{c: [_small(x[m]) for m, x in zip(parts[0], parts[i], strict=True)] for i, c in ((1, "b"), (2, "t"))}})


def score(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (all per token) of every row; ``targets`` has the target documents' ids."""
    goods = targets.select(F.col("doc_id").cast("long").alias("k")).where("k IS NOT NULL").distinct()
    key = F.col("doc_id").cast("long")
    sizes = docs.select(key.alias("k"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("n"), F.length("text").alias("size"))
    marked = sizes.join(goods.withColumn("y", F.lit(True)).hint("merge"), "k", "left")  # targets grow with the documents: no broadcast at any size
    n, n_target, size = marked.agg(F.sum("n"), F.sum(F.when(F.col("y"), F.col("n"))), F.sum("size")).first()
    words, size = (n or 0, n_target or 0), size or 0
    groups, slices = max(1, math.ceil(size / TOGETHER)), max(1, math.ceil(size / 6 / EXPECTED))
    group = lambda k: F.pmod(F.xxhash64(*k), F.lit(groups)).alias("g")
    # a null id is no target, so its rows needn't stand together
    rows = docs.select(F.when(key.isNull(), group(["text"])).otherwise(group([key])).alias("g"), key.alias("k"), F.col("text").alias("t"), F.struct("doc_id").alias("row"))
    asked = goods.select(group(["k"]), F.lit(-1).cast("long").alias("s"), F.col("k"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(table: pa.Table, told: pa.Table) -> tuple[_Grams, np.ndarray]:
        good = set(told.column("k").to_pylist())
        target = np.array([k is not None and k in good for k in table.column("k").to_pylist()], dtype=bool)
        return _Grams(table.column("t").to_pylist(), target), target

    def count(table: pa.Table, told: pa.Table) -> pa.Table:
        out, g = [], 0
        if len(table):
            grams, _ = read(table, told)
            g = table.column("g")[0].as_py()
            out = [(s, _packed(grams.keys[at]), *(_small(c[at]) for c in grams.counts)) for s, at in _by_slice(_slices(grams.keys, slices))]
        return pa.table({"g": pa.array([g] * len(out), pa.int64()), "s": pa.array([x[0] for x in out], pa.int64()), **{c: pa.array([x[i] for x in out], pa.binary()) for i, c in ((1, "keys"), (2, "b"), (3, "t"))}})

    def loss(table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"doc_id": pa.array([], table.schema.field("row").type.field(0).type), "n_tokens": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in ("target_loss", "background_loss", "score")}})
        replies = told.filter(pa.array([s >= 0 for s in told.column("s").to_pylist()], pa.bool_()))
        grams, target = read(table, told.filter(pa.array([s < 0 for s in told.column("s").to_pylist()], pa.bool_())))
        reply = {s: x for s, *x in zip(*(replies.column(c).to_pylist() for c in ("s", "bits", "b", "t")), strict=True)}
        totals = [c.astype(np.int64) for c in grams.counts]
        for s, at in _by_slice(_slices(grams.keys, slices)):
            more = np.flatnonzero(np.unpackbits(np.frombuffer(reply[s][0], np.uint8), count=at.stop - at.start)) + at.start
            for m in (0, 1):
                totals[m][more] = _wide(reply[s][1 + m], len(more))
        background, wanted = grams.losses(totals, words, target)
        by = np.maximum(grams.n, 1)
        return pa.table({"doc_id": table.column("row").combine_chunks().field(0), "n_tokens": grams.n, "target_loss": wanted / by, "background_loss": background / by, "score": (wanted - background) / by})

    counted = rows.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(lambda a, b: count(a, b), "g long, s long, keys binary, b binary, t binary")
    totals = counted.groupBy("s").applyInPandas(_summed, "g long, s long, bits binary, b binary, t binary")
    told = totals.select("g", "s", F.lit(None).cast("long").alias("k"), "bits", "b", "t").union(asked.select("g", "s", "k", *[F.lit(None).cast("binary")] * 3))
    return rows.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(lambda a, b: loss(a, b), f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")


def difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents; the target documents are those labelled with quality 1."""
    return score(docs, labels.where("quality = 1").select("doc_id"))
