"""Centroid clustering: bounds against sampled spheres, results against plain integer rounds, messy rows."""

import hashlib
import math

import numpy as np
import pytest

from foliospark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, x binary, cluster string, part int"


def plain(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    middle = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(middle)):
            if mine := [v for (_, v), a in zip(kept, at, strict=True) if a == j]:
                middle[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    sums = {j: sum(d for _, d, a in last if a == j) for j in range(len(middle))}
    return sorted(((i, a, d, sums[a], sum(sums.values()), hashlib.sha256(",".join(map(str, middle[a])).encode()).hexdigest()) for i, d, a in last), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, b"x", "clash", 3) for i, v in rows], SCHEMA).repartition(3)


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize("nearest", [False, True])
def test_loosening_holds_for_every_point_of_the_sphere_and_is_less_than_the_drift(nearest):
    g = np.random.default_rng(1)
    less = tight = 0
    for _ in range(60):
        k, d = 5, int(g.choice([2, 3, 16]))
        old = g.normal(0, 50, (k, d)).round()
        new = (old + g.normal(0, g.choice([1, 20, 80]), (k, d))).round()
        radius = g.uniform(0, 90, k)
        bound = centroids.loosening(old, new, radius, nearest)
        drift = np.sqrt(((new - old) ** 2).sum(axis=1))
        assert (bound <= drift * (1 + 1e-6)).all() and (bound >= 0).all()
        less += int((bound < 0.9 * drift).sum())
        for i in range(k):
            step = g.normal(size=(4000, d))
            x = old[i] + step / np.sqrt((step**2).sum(axis=1, keepdims=True)) * radius[i] * g.uniform(0, 1, (4000, 1)) ** 0.1
            for j in range(k):
                before = np.sqrt(((x - old[j]) ** 2).sum(axis=1))
                fall = before - np.sqrt(((x - new[j]) ** 2).sum(axis=1))
                if nearest:
                    fall = fall[np.sqrt(((x - old[i]) ** 2).sum(axis=1)) <= before]
                if i != j and len(fall):
                    assert fall.max() <= bound[i, j] + 1e-6
                    tight += bool(fall.max() > 0.8 * bound[i, j])
    assert less > 250 and tight > 300


@pytest.mark.parametrize("scale", [1.0, 3000.0, 100_000.0])
def test_same_as_plain_rounds(spark, scale):
    g = np.random.default_rng(2)
    spots = g.normal(0, 1, (6, 64)) * scale
    rows = [(i, (spots[i % 6] + g.normal(0, 0.2 * scale, 64)).astype(np.float32).tolist()) for i in range(300)]
    assert found(centroids.cluster(table(spark, rows))) == plain(rows)


def test_messy_rows(spark):
    g = np.random.default_rng(3)
    one = g.normal(0, 1, 64).astype(np.float32).tolist()
    odd = [(90, None), (91, []), (92, [1.0] * 63), (93, [1.0] * 65), (94, [None] + one[1:]), (95, [float("nan")] + one[1:]), (96, [float("-inf")] + one[1:])]
    same = [(i, one) for i in range(40)]  # ties: all centroids start alike
    rows = [*odd, *same, (3, one), (3, [0.0] * 64), (97, [0.0] * 64), (None, [-0.5] * 64)]
    assert found(centroids.cluster(table(spark, rows))) == plain(rows)
    assert found(centroids.cluster(table(spark, rows[:10]))) == plain(rows[:10])
    assert found(centroids.cluster(table(spark, odd))) == [] == found(centroids.cluster(table(spark, [])))
    huge = [(98, [1e30] * 64)]  # its squared distance is no long
    assert found(centroids.cluster(table(spark, same + huge))) == plain(same)


def test_bounds_spare_most_scans(spark):
    g = np.random.default_rng(4)
    spots = g.normal(0, 1, (8, 64))
    rows = [(i, (spots[i % 8] + g.normal(0, 0.25, 64)).astype(np.float32).tolist()) for i in range(2000)]
    run = centroids.Clustering(table(spark, rows))
    assert run.scans[0] == 2000
    assert sum(run.scans[1:]) < 0.5 * 2000 * max(1, len(run.scans) - 1)
