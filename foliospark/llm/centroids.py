"""Exact integer centroid clustering with geometric drift tightening.

Each vector keeps its cluster, an upper bound of the distance to that cluster's centroid and a lower bound of the
distance to every other one. When centroids move, the upper bound grows by its own centroid's drift. The lower bound
isn't loosened by the other centroids' full drift: all vectors of a cluster lie in a sphere around its old centroid,
and in the plane through that centre and the old and new places of another centroid, ``d(x, old) - d(x, new)`` is at
most ``drift * cos(angle)``, where the angle is that of the nearest line from the middle of the move that
touches the sphere. Spheres on the side that the centroid leaves behind need no loosening at all. Where the sphere holds the middle, the
plane halfway between both old centroids still bounds the angle, as all vectors of the cluster lie on its own side. Vectors whose bounds
still part keep their cluster unseen; the ambiguous ones are scanned exactly against all centroids.

Spark holds the vectors: a round is one narrow pass over a table of (id, packed integers, cluster, bounds), which
also yields for each task and cluster the change of count and sums and the sphere's radius. Only these few rows
(tasks x clusters, summed by Spark) reach the driver. A pass after which no centroid moves ends the rounds, since all later
ones would be equal to it.

Vectors that are null, have another number of components, or hold null or non-finite ones take no part; nor do those
of a squared length over ``LARGEST`` after scaling, whose squared distances a long may not hold. Fewer vectors than centroids
give as many centroids. Equal vectors are separate members; ties go to the smaller centroid. Rows that repeat an id are
members of their own; rows with a null id are members and never a start. An empty table gives no
rows. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Tables

#: Vectors of a larger squared length after scaling may lie farther apart than a long can say.
LARGEST = 2.0**60
#: Share by which bounds are widened, far above their rounding.
SLACK = 1e-9
_STATE = "vec_id long, x binary, cluster int, upper double, lower double, many long, sums array<long>, radius double, scanned long, part int"


def _turned(cos: np.ndarray, towards: np.ndarray) -> np.ndarray:
    """cos(a - b) of angles given by their cosines, 1 where b is the larger."""
    cos, towards = np.clip(cos, -1.0, 1.0), np.clip(towards, -1.0, 1.0)
    return np.where(cos >= towards, 1.0, cos * towards + np.sqrt((1 - cos * cos) * (1 - towards * towards)))


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray, nearest: bool = True) -> np.ndarray:
    """[i, j]: at most what d(x, j) falls by as centroid j moves, for x in the sphere of ``radius[i]`` around old centroid i,
    and with ``nearest`` no nearer to old centroid j."""
    a, b, r = old.astype(np.float64), new.astype(np.float64), np.asarray(radius, dtype=np.float64)
    out = np.zeros((len(a), len(a)))
    for j in range(len(a)):
        move = b[j] - a[j]
        drift = np.sqrt(move @ move)
        if not drift:
            continue
        middle = (a[j] + b[j]) / 2
        centre = a - middle
        far = np.sqrt((centre * centre).sum(axis=1))
        held = far <= r  # the sphere holds the middle: its vectors may lie in any direction
        some = np.where(held, 1.0, far)
        angle = _turned(centre @ move / (drift * some), np.sqrt(np.maximum(0.0, 1 - (r / some) ** 2)))
        cos = np.where(held, 1.0, angle)
        if nearest:
            gap = a[j] - a
            wide = np.sqrt((gap * gap).sum(axis=1))
            some = np.where(wide > 0, wide, 1.0)
            beyond = ((middle - (a + a[j]) / 2) * gap).sum(axis=1) / some  # of the middle, from the plane halfway
            side = _turned(-(gap @ move) / (drift * some), beyond / np.maximum(far + r, 1e-300))
            cos = np.where((wide > 0) & (beyond > 0), np.minimum(cos, side), cos)
        out[:, j] = drift * np.clip(cos + SLACK, 0.0, 1.0)
    return out


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows and centroids."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # whole numbers that doubles hold
        f, c = x.astype(np.float64), centroids.astype(np.float64)
        return np.rint((f * f).sum(axis=1)[:, None] - 2 * (f @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    wide, c = x.astype(np.int64), centroids.astype(np.int64)
    return np.stack([((wide - row) ** 2).sum(axis=1) for row in c], axis=1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the first of equals), distance to it and to the next one."""
    d = squared(x, centroids)
    best = d.argmin(axis=1)
    near = d[np.arange(len(x)), best]
    d[np.arange(len(x)), best] = np.iinfo(np.int64).max
    return best.astype(np.int32), np.sqrt(near.astype(np.float64)), np.sqrt(d.min(axis=1).astype(np.float64)) if len(centroids) > 1 else np.full(len(x), np.inf)


def settle(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, bounds and whether it was scanned of each row, after a move that the bounds allow for already."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    open_ = lambda at: at[~(upper[at] * (1 + SLACK) < lower[at] * (1 - SLACK))]
    at = open_(np.arange(len(x)))
    if len(at):
        mine = centroids[cluster[at]].astype(np.int64)
        upper[at] = np.sqrt(((x[at].astype(np.int64) - mine) ** 2).sum(axis=1).astype(np.float64))
        at = open_(at)
    scanned = np.zeros(len(x), dtype=bool)
    if len(at):
        cluster[at], upper[at], lower[at] = scan(x[at], centroids)
        scanned[at] = True
    return cluster, upper, lower, scanned


def _packed(x: np.ndarray) -> np.ndarray:
    kind = "<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<i4"
    return np.array([row.tobytes() for row in x.astype(kind)], dtype=object)


def _unpacked(packed: pd.Series, size: int) -> np.ndarray:
    out = np.empty((len(packed), size), dtype=np.int32)
    wide = packed.map(len).to_numpy() == 4 * size
    for kind, at in (("<i4", np.flatnonzero(wide)), ("<i2", np.flatnonzero(~wide))):
        out[at] = np.frombuffer(b"".join(packed.iloc[at]), dtype=kind).reshape(len(at), size)
    return out


def _pass(old: np.ndarray | None, new: np.ndarray, loose: np.ndarray | None, drift: np.ndarray | None):
    """A task's part of a round: its rows with new clusters and bounds, then one row for each cluster."""
    k, size = new.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many, sums, radius, seen = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64), np.zeros(k), np.zeros(k, dtype=np.int64)
        for b in batches:
            if not len(b):
                continue
            x = _unpacked(b["x"], size)
            if old is None:
                before = np.full(len(x), -1, dtype=np.int32)
                cluster, upper, lower = scan(x, new)
                scanned = np.ones(len(x), dtype=bool)
            else:
                before = b["cluster"].to_numpy().astype(np.int32)
                lower = np.maximum(0.0, b["lower"].to_numpy() * (1 - SLACK) - loose[before])
                cluster, upper, lower, scanned = settle(x, before, b["upper"].to_numpy() * (1 + SLACK) + drift[before], lower, new)
            moved = np.flatnonzero(cluster != before)
            if len(moved):
                for sign, to in ((1, cluster[moved]), (-1, before[moved])):
                    held = to >= 0
                    np.add.at(many, to[held], sign)
                    np.add.at(sums, to[held], sign * x[moved[held]].astype(np.int64))
            np.maximum.at(radius, cluster, upper)
            seen += np.bincount(cluster[scanned], minlength=k)
            yield pd.DataFrame({"vec_id": b["vec_id"], "x": b["x"], "cluster": cluster, "upper": upper, "lower": lower, "many": 0, "sums": None, "radius": 0.0, "scanned": 0, "part": 0})
        yield pd.DataFrame({"vec_id": pd.array([pd.NA] * k, dtype="Int64"), "x": None, "cluster": np.arange(k, dtype=np.int32), "upper": 0.0, "lower": 0.0, "many": many, "sums": list(sums), "radius": radius, "scanned": seen, "part": 1})

    return run


def kept(vectors: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, the packed integers floor(scale * component), of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + (c * scale) * (c * scale))
    rows = rows.where((F.size("v") == size) & fine & (length < LARGEST))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.floor(scale * np.stack(b["v"].to_list()).astype(np.float64)).astype(np.int64)
                yield pd.DataFrame({"vec_id": b["vec_id"], "x": _packed(x)})

    return rows.mapInPandas(pack, "vec_id long, x binary")


def starts(points: DataFrame, k: int, size: int, seed: int = 3) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in their order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.where("vec_id IS NOT NULL").select(order.alias("o"), "x").orderBy("o", "x").limit(k).collect()  # k rows
    return _unpacked(pd.Series([bytes(r.x) for r in first], dtype=object), size).astype(np.int64) if first else np.zeros((0, size), dtype=np.int64)


class Clustering:
    """The rounds over one table; ``scans`` holds the number of vectors scanned in each pass."""

    def __init__(self, vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"):
        spark, self.size = vectors.sparkSession, size
        self.tables, self.scans, self.table = Tables(spark, "centroids"), [], None
        points = kept(vectors, size, scale, id_col, vector_col)
        self.centroids = starts(points, k, size)
        self.counts, self.sums = np.zeros(len(self.centroids), dtype=np.int64), np.zeros((len(self.centroids), size), dtype=object)
        self.state = points.select("vec_id", "x", F.lit(0).alias("cluster")).where("false")
        old, loose, drift = None, None, None
        for turn in range(rounds + 1 if len(self.centroids) else 0):
            radius = self._advance(points if old is None else self.state, old, loose, drift)
            after = self._means()
            if turn == rounds or (after == self.centroids).all():
                break
            old, self.centroids = self.centroids, after
            each = loosening(old, after, radius)
            np.fill_diagonal(each, 0.0)
            loose, drift = each.max(axis=1), np.sqrt(((after - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)

    def _advance(self, rows: DataFrame, old, loose, drift) -> np.ndarray:
        """One pass with the present centroids: new state, counts and sums; the clusters' radii."""
        done = self.tables.keep(rows.mapInPandas(_pass(old, self.centroids, loose, drift), _STATE), "part")
        sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(self.size)]
        told = done.where("part = 1").groupBy("cluster").agg(F.sum("many").alias("many"), F.max("radius").alias("radius"), F.sum("scanned").alias("scanned"), *sums).collect()  # a row a centroid
        radius = np.zeros(len(self.centroids))
        for r in told:
            self.counts[r.cluster] += r.many
            self.sums[r.cluster] += np.array([int(r[f"s{i}"]) for i in range(self.size)], dtype=object)
            radius[r.cluster] = r.radius
        self.tables.drop(self.table)
        self.table, self.state = done, done.where("part = 0")
        self.scans.append(sum(r.scanned for r in told))
        return radius

    def _means(self) -> np.ndarray:
        out = self.centroids.copy()
        for c in np.flatnonzero(self.counts):
            out[c] = [int(s) // int(self.counts[c]) for s in self.sums[c]]
        return out

    def members(self) -> DataFrame:
        """vec_id, cluster, distance (squared, exact) of each vector."""
        centroids, size = self.centroids, self.size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    cluster = b["cluster"].to_numpy()
                    gap = _unpacked(b["x"], size).astype(np.int64) - centroids[cluster]
                    yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": cluster, "distance": (gap * gap).sum(axis=1)})

        return self.state.select("vec_id", "x", "cluster").mapInPandas(run, "vec_id long, cluster int, distance long")

    def result(self) -> DataFrame:
        """With each cluster's and the whole inertia, and the digest of its centroid."""
        found = self.members()
        spark = found.sparkSession
        sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # a row a centroid
        whole = sum(sums.values())
        named = [(c, sums[c], whole, hashlib.sha256(",".join(map(str, self.centroids[c].tolist())).encode()).hexdigest()) for c in sorted(sums)]
        told = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector after ``rounds`` rounds and a last assignment."""
    return Clustering(vectors, k, rounds, size, scale, id_col, vector_col).result()
