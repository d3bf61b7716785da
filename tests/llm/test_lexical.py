"""Ranked lexical search: packing, blocks that stay packed, results against a plain ranking, messy rows."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from foliospark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=50):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, k=50, limit=lexical.SHARD, parts=3):
    full = spark.createDataFrame([(i, t, 3, "clash", 1) for i, t in docs], "doc_id long, text string, shard long, h string, named int").repartition(parts)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, block int")
    return sorted((tuple(r) for r in lexical.Index(full, limit=limit).search(asked, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_packing_round_trip():
    g = np.random.default_rng(1)
    values = np.concatenate([g.integers(0, 1 << b, 200) for b in (1, 7, 8, 14, 15, 21, 28, 32)])
    data, end = lexical.packed(values)
    assert (lexical.unpacked(data) == values).all() and len(end) == len(values)
    assert len(lexical.packed(np.zeros(0, dtype=np.int64))[0]) == 0


def corpus(n, seed=2):
    g = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(g.choices(words, weights, k=g.randrange(1, 80)))) for i in range(n)]


def test_messy_rows(spark):
    long = " ".join(f"v{i % 700}" for i in range(150_000))
    docs = [(1, None), (2, ""), (3, " .,;\n"), (4, "Éa-B c_d ÀÉ don't 42"), (4, "a b"), (4, "a b"), (None, "a b"), (5, long), (6, "x" * 1_200_000), (7, "A b"), *[(100 + i, "a b") for i in range(70)]]
    items = [(1, "a B"), (1, "c"), (2, None), (3, " "), (None, "a"), (4, "v3 v3 v699 nowhere"), (5, "Éa d 42"), (6, "x" * 1_200_000)]
    assert searched(spark, docs, items) == plain(docs, items)
    assert searched(spark, docs, items, k=3, limit=40) == plain(docs, items, 3)
    assert searched(spark, [], items) == [] == searched(spark, docs[:3], items) == searched(spark, docs, [])


@pytest.mark.parametrize("limit", [700, 30_000, lexical.SHARD])
def test_same_as_a_plain_ranking(spark, limit):
    docs = corpus(3000)
    g = random.Random(4)
    items = [(i, " ".join(f"w{g.randrange(300)}" for _ in range(g.randrange(1, 30)))) for i in range(25)]
    docs += [(5000 + i, docs[i % 5][1]) for i in range(200)]  # ties
    assert searched(spark, docs, items, 20, limit) == plain(docs, items, 20)


def test_block_maxima_spare_unpacking():
    docs = corpus(20_000, 6)
    frames = list(lexical._lists(0, np.arange(len(docs)), np.ones(len(docs), dtype=bool), [t for _, t in docs]))
    by = {int(r.h): r for r in frames[0].itertuples()}
    sizes = np.frombuffer(frames[1]["sizes"][0], dtype="<u4").astype(np.int64)
    m_of = lambda n: 50 + 50 * n * len(sizes) // int(sizes.sum())
    words, _ = lexical.tg.word_hashes(["w0 w1 w2 w290 w280"], lower=True, terms=True)
    lists = [lexical.List(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * by[h].df + 1))), by[h].heads, by[h].data, m_of) for h in words.view(np.int64).tolist()]
    lexical.List.unpacks = 0
    found, scores = lexical.best(lists, m_of(sizes), 10)
    total = np.zeros(len(sizes), dtype=np.int64)
    for x in lists:
        doc, times = x.postings(0, len(x.last))
        total[doc] += x.scores(times, m_of(sizes)[doc])
    blocks = sum(len(x.last) for x in lists)
    assert lexical.List.unpacks - blocks < 0.5 * blocks
    order = np.lexsort((np.arange(len(total)), -total))[:10]
    assert found.tolist() == order.tolist() and scores.tolist() == total[order].tolist()


def test_a_shard_is_built_in_little_memory(monkeypatch):
    """A task holds the hashes of a shard's texts, not the texts, and hands its lists on in parts."""
    monkeypatch.setattr(lexical, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("At", (), {"partitionId": staticmethod(lambda: 0)}))}))
    g = np.random.default_rng(7)
    batches = lambda: (pd.DataFrame({"k": range(i, i + 250), "named": True, "t": [" ".join(f"v{x}" for x in g.zipf(1.3, 600) % 90_000) for _ in range(250)]}) for i in range(0, 3000, 250))
    chars = sum(int(b["t"].str.len().sum()) for b in batches())
    tracemalloc.start()
    sizes = [len(f) for f in lexical._shards(batches(), lexical.SHARD)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert chars < lexical.SHARD and max(sizes) <= 20_000 < sum(sizes)
    assert most < 14 * chars


def test_packing_in_pieces(monkeypatch):
    values = np.random.default_rng(2).integers(0, 1 << 30, 1000)
    data, end = lexical.packed(values)
    monkeypatch.setattr(lexical, "PACKED", 64)
    again, stop = lexical.packed(values)
    assert (data == again).all() and (end == stop).all()
