"""Jaccard join: windows, local and distributed recursion and messy rows against all pairs."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from foliospark.llm import jaccardjoin as jj
from foliospark.llm.common import Tables
from foliospark.llm.neardup import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(sets, percent=80):
    """Least id reachable of each id."""
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = [k for k in sets if sets[k]]
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: find(k) for k in sets}


def result(spark, rows, **limits):
    df = spark.createDataFrame([(k, t, 1, 2, b"x", "clash") for k, t in rows], "doc_id long, text string, k long, r long, s binary, region string").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.join(df, **limits).collect()), key=repr)


def copies(g, n, length=120, edits=(0, 1, 2, 4, 6, 9), families=3):
    base = [[f"w{g.randrange(9000)}" for _ in range(length)] for _ in range(families)]
    rows = []
    for i in range(n):
        w = list(base[i % families])
        for _ in range(g.choice(edits)):
            w[g.randrange(length)] = f"x{g.randrange(9999)}"
        rows.append((i, " ".join(w)))
    return rows


def family(g, n):
    """Sets at all distances, in chains and rings around some centres."""
    sets = []
    for _ in range(n):
        s = g.choice(5000, 60, replace=False) if not sets or g.random() < 0.05 else sets[g.integers(len(sets))].copy()
        new = g.integers(0, 16)
        s[g.choice(len(s), new, replace=False)] = g.integers(5000, 9000, new)
        sets.append(np.unique(s))
    return [s.astype(np.uint64) for s in sets]


@pytest.mark.parametrize("seed", range(2))
def test_pivots_lose_no_link(seed):
    sets = family(np.random.default_rng(seed), 250)
    want = plain({i: set(s.tolist()) for i, s in enumerate(sets)})
    assert jj.joined(sets, np.arange(len(sets)), 80).tolist() == [want[i] for i in range(len(sets))]


def test_work_is_bounded_where_windows_overlap():
    """Sets that share half of their elements with all others: every window holds most of them."""
    g = np.random.default_rng(4)
    base = np.arange(60)
    sets = [np.unique(np.concatenate((g.choice(base, 48, replace=False), g.integers(100, 2000, 12)))).astype(np.uint64) for _ in range(600)]
    asked = []
    held, jj.linked_labels = jj.linked_labels, lambda *a, **k: asked.append(len(a[0])) or held(*a, **k)
    try:
        label = jj.joined(sets, np.arange(len(sets)), 80)
    finally:
        jj.linked_labels = held
    assert sum(asked) <= 4 * len(sets)
    want = plain({i: set(s.tolist()) for i, s in enumerate(sets)})
    assert label.tolist() == [want[i] for i in range(len(sets))]


def test_windows_hold_every_linked_pair():
    g = np.random.default_rng(9)
    smaller = 0
    for _ in range(20):
        sets = family(g, 120)
        far, _ = jj.distances(sets, [sets[i] for i in g.choice(120, jj.PIVOTS, replace=False)], 80)
        both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        n = np.array([len(s) for s in sets])
        pairs = np.argwhere(100 * both >= 80 * (n[:, None] + n[None, :] - both))
        for reach in (None, jj.RADIUS):
            parts = [set(p.tolist()) for p in jj.divided(far, 80, reach)]
            assert all(any(i in p and j in p for p in parts) for i, j in pairs.tolist())
            smaller += sum(len(p) < 60 for p in parts)
    assert smaller > 100


@pytest.mark.parametrize("limit", [jj.LIMIT, 40, 7])
def test_same_as_all_pairs(spark, limit):
    g = random.Random(5)
    rows = copies(g, 150) + [(200 + i, " ".join(f"u{g.randrange(99999)}" for _ in range(60))) for i in range(20)]
    want = plain({k: shingles(t) for k, t in rows})
    assert result(spark, rows, limit=limit) == sorted(((k, len(shingles(t)), want[k]) for k, t in rows), key=repr)


@pytest.mark.parametrize("levels", [0, 3])
def test_large_regions_across_tasks(spark, levels):
    sets = family(np.random.default_rng(11), 300)
    rows = spark.createDataFrame(pd.DataFrame({"region": [i % 2 for i in range(300)], "r": range(300), "n": [len(s) for s in sets]}), "region long, r long, n long")
    packed = spark.createDataFrame(pd.DataFrame({"r": range(300), "s": [s.tobytes() for s in sets]}), "r long, s binary")
    tables = Tables(spark, "test")
    links = jj.region_links(rows, packed, tables, 80, limit=30, levels=levels)
    found = {r.r: r.root for r in components(links, tables).collect()}
    want = {}
    for part in (0, 1):
        want |= plain({i: set(sets[i].tolist()) for i in range(300) if i % 2 == part})
    assert {i: found.get(i, i) for i in range(300)} == want


def test_messy_rows(spark):
    g = random.Random(3)
    words = [f"w{g.randrange(400)}" for _ in range(200)]
    near = [*words[:10], "changed", *words[11:]]
    long = " ".join(f"v{g.randrange(90_000)}" for _ in range(250_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "A"), (6, "A b c d"), (7, "a b  c\td"), (8, " ".join(words)), (9, " ".join(near)), (10, long), (11, long + " end"), (12, "x" * 70_000), (13, "\x00 zero \x7f é ß")]
    want = plain({k: shingles(t) for k, t in rows})
    expected = [(k, len(shingles(t)), want[k]) for k, t in rows]
    odd = [(None, None), (None, " ".join(words))]
    again = [(9, " ".join(near))] * 30  # repeated rows
    assert result(spark, rows + odd + again) == sorted(expected + [(None, len(shingles(t)), None) for _, t in odd] + [(9, len(shingles(again[0][1])), 8)] * 30, key=repr)
    assert result(spark, []) == [] and result(spark, rows[:3]) == [(k, 0, k) for k, _ in rows[:3]]
    two = [(8, " ".join(words)), (9, " ".join(near)), (9, "quite another text of some words"), (10, "quite another text of some words")]
    assert result(spark, two) == sorted([(8, 196, 8), (9, 196, 8), (9, 2, 9), (10, 2, 9)], key=repr)


def test_frequent_shingles_are_held_in_bounds():
    many = jj.MANY * 2 + 5
    g = np.concatenate((np.full(3, -5), np.full(many, 7), np.full(1, 8), np.full(2, 9)))
    r = np.concatenate((np.array([1, 1, 2]), np.arange(many), np.array([4]), np.array([4, 5])))
    frames = [pd.DataFrame({"g": g[i : i + 1000], "r": r[i : i + 1000]}) for i in range(0, len(g), 1000)]
    got = pd.concat(jj.shared(iter(frames)))
    assert sorted(got.groupby("g")["r"].count().items()) == [(-5, 2), (7, many), (9, 2)]
    assert set(got[got["g"] == 7]["df"]) == {jj.MANY} and set(got[got["g"] != 7]["df"]) == {2}
