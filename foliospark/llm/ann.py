"""Nearest neighbours by largest inner product with cross-polytope hashing.

Each table rotates vectors twice, by three rounds of random signs and a fast Hadamard transform each, and assigns
them to the nearest signed axis of the first rotation and of the second one's first coordinates; the pair is the
key, and the more vectors there are, the more coordinates the second hash has. Every vector is indexed once in each
table; a query probes the ``probes`` keys of each that lie nearest to its own rotations. Keys travel by their first axis,
dealt into blocks of bounded size on either side; inside a block only vectors of probed keys are candidates, which are
reranked by their exact inner product in double precision, and each query's best are merged. Vectors are split
by norm into ranges with tables of their own, of whatever size; where norms differ within a range, its vectors get one more
coordinate that makes them equal, so that nearest by angle is nearest by product. In a smaller range the nearest are farther off, so
more keys are probed (``probes_for``). A range is scanned whole, block by block, only for the queries that found fewer than
``k`` + 1 of its classes under their keys.

Equal vectors are one class, searched once; a class keeps its ``k`` + 1 smallest ids, which is all that a
result can hold. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null
ids; rows that repeat both id and vector count once, an id with several vectors is a candidate with each of them; fewer than k candidates give all.
Empty tables give empty results. Only vectors of the same dimension are compared. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from foliospark.llm.common import cut

#: Vectors and queries of a block.
BLOCK = 8192
QUERY_BLOCK = 8192
#: Vectors of a range from which on ``probes`` keys a table reach the recall, and the power by which a smaller one takes more.
ENOUGH, MORE = 10_000, 0.3
#: Norm ranges for each factor of two.
RANGES = 4
#: A second hash has as many coordinates as the range has vectors of this number, 16 at least.
SECOND = 4096
_PLACE = "dim int, range int, table int, bucket int, subs binary, "


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, table: int, seed: int = 5) -> np.ndarray:
    """Pseudo-random rotation of rows whose length is a power of two."""
    g = np.random.default_rng((seed, table, x.shape[1]))
    for _ in range(3):
        x = hadamard(x * g.choice((-1.0, 1.0), x.shape[1]))
    return x


def prepared(x: np.ndarray, longest: float, query: bool, lift: bool) -> np.ndarray:
    """Rows padded to a power of two, lifted to one length if asked."""
    x = x.astype(np.float64)
    if lift:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, longest**2 - (x * x).sum(axis=1)))
        x = np.column_stack((x, extra))
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, size - x.shape[1])))


def axes(x: np.ndarray, table: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of each row along the signed axes of both hashes of a table over n vectors."""
    wide = min(x.shape[1], max(16, 1 << max(0, n // SECOND).bit_length() - 1 if n >= SECOND else 0))
    one, two = rotate(x, 2 * table), rotate(x, 2 * table + 1)[:, :wide]
    return np.concatenate((one, -one), axis=1), np.concatenate((two, -two), axis=1)


def keys(x: np.ndarray, table: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest axis of each row in either hash."""
    one, two = axes(x, table, n)
    return one.argmax(axis=1), two.argmax(axis=1)


def probes_for(n: int, probes: int) -> int:
    """Keys a table that a query probes in a range of n vectors."""
    return int(np.ceil(probes * max(1.0, (ENOUGH / max(1, n)) ** MORE)))


def probed(x: np.ndarray, table: int, n: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``probes`` pairs of axes of each row that lie least under its nearest ones, by the sum of squared gaps."""
    one, two = ((c.max(axis=1, keepdims=True) - c) ** 2 for c in axes(x, table, n))
    first, second = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
    i, j = np.divmod(np.arange(one.shape[1] * two.shape[1]), two.shape[1])
    i, j = i[near := (i + 1) * (j + 1) <= probes], j[near]  # any other pair of places has as many pairs before it
    gaps = np.take_along_axis(one, first, axis=1)[:, i] + np.take_along_axis(two, second, axis=1)[:, j]
    some = min(probes, gaps.shape[1])
    top = np.argpartition(gaps, some - 1, axis=1)[:, :some]
    return np.take_along_axis(first, i[top], axis=1), np.take_along_axis(second, j[top], axis=1)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where("id IS NOT NULL AND v IS NOT NULL").where(F.coalesce(fine, F.lit(False))).withColumns({"h1": F.xxhash64(F.lit(1), v), "h2": F.xxhash64(F.lit(2), v)})


def _sized(rows: DataFrame) -> DataFrame:
    """With the dimension and the base 2 logarithm of the norm, which no component is too large for."""
    most = F.array_max(F.transform("v", F.abs))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / most) * (x / most))
    return rows.withColumns({"dim": F.size("v"), "lg": F.log2(most) + F.log2(length) / 2})


def _packed(vectors: np.ndarray, kind: str) -> list[bytes]:
    return [row.tobytes() for row in vectors.astype(kind)]


def _hashed(rows: DataFrame, key: list[str], tables: int, probes: int, query: bool, kind: str) -> DataFrame:
    """dim, range, table, bucket (first axis), subs (packed second axes), the key columns and the packed vector; rows have their range's top, lift and n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (d, r), part in b.groupby(["dim", "range"], sort=False):
                x = np.stack(part["v"].to_list()).astype(np.float64)
                packed = np.array(_packed(x, kind), dtype=object)
                half = np.exp2(part["top"].iloc[0] / 2)
                unit = x / np.abs(x).max(axis=1, keepdims=True) if query else x / half / half
                if query:
                    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                ready, n = prepared(unit, 1.0, query, bool(part["lift"].iloc[0])), int(part["n"].iloc[0])
                for t in range(tables):
                    if query:
                        one, two = probed(ready, t, n, probes_for(n, probes))
                        row = np.repeat(np.arange(len(x)), one.shape[1])
                        order = np.lexsort((two.ravel(), one.ravel(), row))
                        row, one, two = row[order], one.ravel()[order], two.ravel()[order].astype(np.uint16)
                        edge = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (one[1:] != one[:-1]))))
                        row, one, subs = row[edge], one[edge], [s.tobytes() for s in np.split(two, edge[1:])]
                    else:
                        one, two = keys(ready, t, n)
                        row, subs = np.arange(len(x)), [s.tobytes() for s in two.astype(np.uint16)]
                    yield pd.DataFrame({"dim": np.int32(d), "range": np.int32(r), "table": np.int32(t), "bucket": one.astype(np.int32), "subs": subs, **{c: part[c].to_numpy()[row] for c in key}, "x": packed[row]})

    return rows.select(*key, "v", "dim", "range", "top", "lift", "n").mapInPandas(run, _PLACE + ", ".join(f"{c} long" for c in key) + ", x binary")


def _whole(rows: DataFrame, key: list[str], kind: str) -> DataFrame:
    """The same columns with a single bucket for each dimension and range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = [np.asarray(v, dtype=kind).tobytes() for v in b["v"]]
            yield pd.DataFrame({"dim": b["dim"], "range": b["range"], "table": np.int32(-1), "bucket": np.int32(0), "subs": bytes(2), **{c: b[c] for c in key}, "x": packed})

    return rows.select(*key, "v", "dim", "range").mapInPandas(run, _PLACE + ", ".join(f"{c} long" for c in key) + ", x binary")


def _best(q: pd.DataFrame, x: pd.DataFrame, k: int, kind: str) -> list[bytes]:
    """For each query (subs, x) its k + 1 best rows of those under its keys: packed reps and scores."""
    reps, sub = x["rep"].to_numpy(), np.frombuffer(b"".join(x["subs"]), dtype=np.uint16)
    order = np.argsort(sub, kind="stable")
    reps, sub = reps[order], sub[order]
    rows = np.frombuffer(b"".join(x["x"]), dtype=kind).reshape(len(x), -1)[order].astype(np.float64)
    wanted = np.frombuffer(b"".join(q["x"]), dtype=kind).reshape(len(q), -1).astype(np.float64)
    asked = np.frombuffer(b"".join(q["subs"]), dtype=np.uint16)
    owner = np.repeat(np.arange(len(q)), q["subs"].map(len).to_numpy() // 2)
    edge = np.flatnonzero(np.concatenate(([True], sub[1:] != sub[:-1], [True])))
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(q))]
    for a, b in pairwise(edge.tolist()):
        mine = owner[asked == sub[a]]
        for at in range(0, len(mine), 512):
            some = mine[at : at + 512]
            s = wanted[some] @ rows[a:b].T
            least = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)] if b - a > k + 1 else np.full(len(s), -np.inf)
            for i, row, low in zip(some.tolist(), s, least, strict=True):
                hit = np.flatnonzero(row >= low)
                out[i].append((reps[a + hit], row[hit]))
    best = []
    for lists in out:
        if not lists:
            best.append(b"")
            continue
        rep, score = np.concatenate([r for r, _ in lists]), np.concatenate([s for _, s in lists])
        top = np.lexsort((rep, -score))[: k + 1]
        best.append(rep[top].tobytes() + score[top].tobytes())
    return best


def _compared(data: DataFrame, probed: DataFrame, k: int, kind: str) -> DataFrame:
    """h1, h2, range, rep, s: the k + 1 best classes in the buckets that each query has of each range."""
    place = ["dim", "range", "table", "bucket"]
    # one row for each bucket: dimensions in use x norm ranges x tables x twice the dimension
    blocks = data.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    parts = probed.groupBy(*place).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    shape = F.broadcast(blocks.join(parts, place))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = data.join(shape, place).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("part", each("parts")).drop("blocks", "parts")
    right = probed.join(shape, place).withColumn("part", F.pmod(F.xxhash64("h2", "h1"), F.col("parts")).cast("int")).withColumn("block", each("blocks")).drop("blocks", "parts")
    key = [*place, "block", "part"]

    def rerank(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"h1": [], "h2": [], "range": [], "best": []})
        best = _best(q, x, k, kind)
        return pd.DataFrame({"h1": q["h1"], "h2": q["h2"], "range": q["range"], "best": best})[[len(x) > 0 for x in best]]

    found = right.groupBy(*key).cogroup(left.groupBy(*key)).applyInPandas(rerank, "h1 long, h2 long, range int, best binary")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h1, h2, r, lists in zip(b["h1"], b["h2"], b["range"], b["lists"], strict=True):
                reps = np.concatenate([np.frombuffer(x[: len(x) // 2], np.int64) for x in lists])
                score = np.concatenate([np.frombuffer(x[len(x) // 2 :], np.float64) for x in lists])
                reps, at = np.unique(reps, return_index=True)
                score = score[at]
                order = np.lexsort((reps, -score))[: k + 1]
                out.extend((h1, h2, r, int(i), float(s)) for i, s in zip(reps[order], score[order], strict=True))
            yield pd.DataFrame(out, columns=["h1", "h2", "range", "rep", "s"])

    return found.groupBy("h1", "h2", "range").agg(F.collect_list("best").alias("lists")).mapInPandas(merge, "h1 long, h2 long, range int, rep long, s double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 16, probes: int = 52, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the nearest found for each row of ``queries``, itself left out."""
    inner = getattr(vectors.schema[vector_col].dataType, "elementType", None)
    kind = "<f4" if isinstance(inner, FloatType) else "<f8"  # how vectors travel, without loss
    base, asked = valid(vectors, id_col, vector_col), valid(queries, id_col, vector_col)
    first = Window.partitionBy("h1", "h2").orderBy("id")
    once = base.groupBy("h1", "h2", "id").agg(F.first("v").alias("v"))  # a row may come many times
    distinct = once.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = distinct.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    sized = cut(_sized(classes))
    longest = sized.agg(F.max("lg")).first()[0] or 0.0
    known = sized.withColumn("range", F.floor((F.lit(longest) - F.col("lg")) * RANGES).cast("int"))
    asked_classes = asked.groupBy("h1", "h2").agg(F.first("v").alias("v")).withColumn("dim", F.size("v"))
    # one row for each dimension in use and norm range
    shape = cut(known.groupBy("dim", "range").agg(F.count("*").alias("n"), F.max("lg").alias("top"), F.min("lg").alias("low")))
    hashed = shape.select("dim", "range", "n", "top", (F.col("low") < F.col("top") + float(np.log2(0.999))).alias("lift"))
    in_tables = asked_classes.join(hashed, "dim")
    data = _hashed(known.join(hashed, ["dim", "range"]), ["rep"], tables, 1, False, kind)
    probes_of = _hashed(in_tables, ["h1", "h2"], tables, probes, True, kind)
    top = cut(_compared(data, probes_of, k, kind))
    have = top.groupBy("h1", "h2", "range").agg(F.count("*").alias("have"))
    short = cut(in_tables.join(have, ["h1", "h2", "range"], "left").where(F.coalesce("have", F.lit(0)) <= k).select("h1", "h2", "v", "dim", "range"))
    if not short.isEmpty():
        again = _compared(_whole(known.join(hashed, ["dim", "range"]), ["rep"], kind), _whole(short, ["h1", "h2"], kind), k, kind)
        top = top.join(short.select("h1", "h2", "range"), ["h1", "h2", "range"], "left_anti").unionByName(again)
    ids = top.join(known.select("rep", "ids"), "rep").select("h1", "h2", (-F.col("s")).alias("o"), F.explode("ids").alias("id"))
    listed = ids.groupBy("h1", "h2").agg(F.slice(F.sort_array(F.collect_list(F.struct("o", "id"))), 1, k + 1).alias("near"))  # of (k + 1) ** 2 a range at most
    mine = asked.select(F.col("id").alias("query_id"), "h1", "h2").distinct().join(listed, ["h1", "h2"])
    nearest = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(nearest).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.o")).alias("score"))
