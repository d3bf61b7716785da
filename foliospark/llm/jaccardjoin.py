"""Exact Jaccard join of word shingle sets in their metric space.

The Jaccard distance 1 - intersection / union is a metric. A region of documents is joined by some of them as pivots: every
document within ``RADIUS`` of a pivot belongs to the Voronoi region of its nearest one, the others form an outer
region. Links of a document at home with pivot p reach only documents whose distance to p is at most that of the region's
farthest member plus the link distance, and at most their own nearest pivot's plus twice the link distance; within this
window of the triangle inequality boundary documents are replicated. A pair of two documents at home nowhere meets in
the outer region, so no pair is lost. Regions are joined recursively in the same way; what is joined already
isn't compared again, and regions that are small, or that pivots divide too little to pay for the replicas, are compared exhaustively. All
distances are exact counts over whole sets; sets are of 64-bit hashes of words and shingles.

Where all is far from all, pivots tell nothing: documents without a common shingle have distance 1. So the first regions
are what shared shingles connect. Equal sets are one representative. A linked document shares at least ``percent`` of its own
shingles, so one with too many that no other has is out; that is first tried on a fixed share of the hash space, then
on the whole sets of what is left. Of the rest, each document names its rarest shared shingles, as many as a
linked one can't all miss, and documents that name the same one are connected. Small regions are joined in a task
each; larger ones are split by pivots across tasks, level by level, and what stays large is compared block by block.

Null and empty texts and those without words have an empty set and are linked with nothing; a text of fewer than five words
has its whole word sequence as its one shingle; very long texts are hashed a megabyte at a time. Rows that repeat
an id are judged by their own texts. Rows with a null id are returned alone, with a null component, and link
nothing. An empty table gives no rows. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import Tables, text_parts, tidy, whole_runs
from foliospark.llm.neardup import components, fingerprint, least_labels, linked_labels, shingle_sets

#: Pivots of a region, and the distance up to which documents belong to one.
PIVOTS, RADIUS = 8, 0.6
#: Documents that are compared exhaustively.
LEAF = 48
#: Documents and shingles of a region that one task joins.
LIMIT, SHINGLES = 4096, 2_000_000
#: Share of the hash space tried first, times the share of shingles that a linked document may have alone.
FIRST = 1.875
#: Shares of a region: pivots divide it if no part has more than MOST of it and all parts together, with their replicas, no more than ALL.
MOST, ALL = 0.7, 1.3
#: Documents of a shingle that are counted exactly; more count as so many.
MANY = 1 << 14
_SLACK = 1e-9


def fewest(n, percent: int):
    """Shingles that a document of ``n`` shares with each linked one, at least."""
    return -(-percent * n // 100)


def _fewest(percent: int):
    return F.expr(f"({percent} * n + 99) div 100")


def profiles(docs: DataFrame, percent: int, size: int = 5) -> DataFrame:
    """k, h, n, finger and first (packed hashes of the share tried first) of each document (k, h, t)."""
    below = np.uint64(int(min(1.0, FIRST * (100 - percent) / 100) * ((1 << 64) - 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in text_parts(batches):
            sets = shingle_sets(part["t"].tolist(), size)
            first = [s[: np.searchsorted(s, below)].tobytes() for s in sets]
            yield pd.DataFrame({"k": part["k"].values, "h": part["h"].values, "n": [len(s) for s in sets], "finger": [fingerprint(s) for s in sets], "first": first})

    return docs.mapInPandas(tidy(run), "k long, h long, n long, finger binary, first binary")


def postings(sets: DataFrame, col: str) -> DataFrame:
    """g, r for each hash g of the packed set of r, in order within partitions by g."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.cumsum([len(x) for x in b[col]]) // (1 << 22)
            for _, part in b.groupby(at, sort=False):
                yield pd.DataFrame({"g": np.frombuffer(b"".join(part[col]), dtype=np.int64), "r": np.repeat(part["r"].to_numpy(), part[col].map(len).to_numpy() // 8)})

    return sets.select("r", col).mapInPandas(run, "g long, r long").repartition("g").sortWithinPartitions("g", "r")


def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """r, g, df of ordered rows (g, r) whose g is in several documents; of a frequent one no more than MANY rows are held."""
    held_g, held_r = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hot = last = None

    def told(g: np.ndarray, r: np.ndarray) -> pd.DataFrame:
        edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True]))) if len(g) else np.zeros(1, dtype=np.int64)
        df = np.repeat(np.diff(edge), np.diff(edge))
        return pd.DataFrame({"r": r[df > 1], "g": g[df > 1], "df": np.minimum(df[df > 1], MANY)})

    for b in batches:
        g, r = b["g"].to_numpy(), b["r"].to_numpy()
        if not len(g):
            continue
        new = np.concatenate(([(int(g[0]), int(r[0])) != last], (g[1:] != g[:-1]) | (r[1:] != r[:-1])))  # a row may come twice
        last = (int(g[-1]), int(r[-1]))
        g, r = g[new], r[new]
        if hot is not None:
            same = int(np.searchsorted(g, hot, side="right"))
            yield pd.DataFrame({"r": r[:same], "g": g[:same], "df": MANY})
            g, r = g[same:], r[same:]
            hot = hot if not len(g) else None
        g, r = np.concatenate((held_g, g)), np.concatenate((held_r, r))
        if not len(g):
            continue
        end = int(np.searchsorted(g, g[-1]))
        yield told(g[:end], r[:end])
        held_g, held_r = g[end:], r[end:]
        if len(held_g) >= MANY:
            yield pd.DataFrame({"r": held_r, "g": held_g, "df": MANY})
            hot, held_g, held_r = int(held_g[0]), held_g[:0], held_r[:0]
    yield told(held_g, held_r)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in shared(batches):
        r, c = np.unique(b["r"].to_numpy(), return_counts=True)
        yield pd.DataFrame({"r": r, "c": c})


def sets_of(rows: DataFrame, alive: DataFrame, size: int = 5) -> DataFrame:
    """r and the packed set of each of ``alive`` (k, h, r), from rows (k, h, t); rows that follow an equal one are left out."""
    found = rows.join(alive.select("k", "h", "r").hint("merge"), ["k", "h"]).select("r", "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in text_parts(batches):
            r = b["r"].to_numpy()
            new = np.concatenate(([r[0] != last], r[1:] != r[:-1]))
            last = r[-1]
            yield pd.DataFrame({"r": r[new], "s": [s.tobytes() for s in shingle_sets(b["t"][new].tolist(), size)]})

    return found.mapInPandas(tidy(run), "r long, s binary")


def distances(sets: list[np.ndarray], pivots: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each set to each pivot, and which are linked; [pivot, set]."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    flat, starts = np.concatenate(sets), np.cumsum(n) - n
    far, linked = np.empty((len(pivots), len(sets))), np.empty((len(pivots), len(sets)), dtype=bool)
    for j, p in enumerate(pivots):
        at = np.minimum(np.searchsorted(p, flat), len(p) - 1)
        both = np.add.reduceat((p[at] == flat).astype(np.int64), starts)
        union = n + len(p) - both
        far[j], linked[j] = 1 - both / union, 100 * both >= percent * union
    return far, linked


def divided(far: np.ndarray, percent: int, reach: np.ndarray | float | None = None) -> list[np.ndarray]:
    """The sets of each pivot's Voronoi region with its window, and last those at home nowhere, from distances [pivot, set]."""
    link, home, near = 1 - percent / 100 + _SLACK, far.argmin(axis=0), far.min(axis=0)
    core = near <= RADIUS
    out = []
    for j, d in enumerate(far):
        mine = core & (home == j)
        farthest = RADIUS if reach is not None else d[mine].max(initial=-1.0)
        out.append(np.flatnonzero(mine | (d <= np.minimum(farthest + link, near + 2 * link))) if reach is not None or mine.any() else np.zeros(0, dtype=np.int64))
    return [*out, np.flatnonzero(~core)]


def joined(sets: list[np.ndarray], label: np.ndarray, percent: int) -> np.ndarray:
    """Labels (least places) once all links are joined to what ``label`` joins; by pivots, regions and windows."""
    todo = [(np.arange(len(sets)), 0)]
    while todo:
        at, depth = todo.pop()
        names = label[at]
        if (names == names[0]).all():
            continue
        if len(at) <= LEAF or depth < 0:
            _, first, where = np.unique(names, return_index=True, return_inverse=True)
            own = least_labels(np.arange(len(at)), np.arange(len(at)), first[where])
            after = linked_labels([sets[i] for i in at.tolist()], own, percent=percent)
            label = least_labels(label, at[after], at)
            continue
        some = np.random.default_rng((depth, len(at))).choice(at, PIVOTS, replace=False)
        far, linked = distances([sets[i] for i in at.tolist()], [sets[i] for i in some.tolist()], percent)
        j, x = np.nonzero(linked)
        label = least_labels(label, some[j], at[x])
        parts = divided(far, percent)
        if max(map(len, parts)) > MOST * len(at) or sum(map(len, parts)) > ALL * len(at):
            parts, depth = [np.arange(len(at))], -2
        todo += [(at[part], depth + 1) for part in parts if len(part) > 1]
    return label


def _region_links(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Links (a, b) that join the given parts (c) of each region, from rows (region, r, c, s) in order."""
    for g in whole_runs(batches, "region"):
        out_a, out_b = [], []
        g = g[~g.duplicated(["region", "r"])]
        names = g["region"].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1], [True])))
        for x, y in pairwise(edge.tolist()):
            part = g.iloc[x:y]
            r = part["r"].to_numpy()
            _, first, where = np.unique(part["c"].to_numpy(), return_index=True, return_inverse=True)
            label = least_labels(np.arange(len(r)), np.arange(len(r)), first[where])
            after = joined([np.frombuffer(s, dtype=np.uint64) for s in part["s"]], label, percent)
            new = np.flatnonzero((label == np.arange(len(r))) & (after != label))
            out_a.append(r[after[new]])
            out_b.append(r[new])
        yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def linked(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of each region (region, r, c) that one task joins."""
    rows = members.select("region", "r", "c").join(sets, "r").select("region", "r", "c", "s")
    return rows.repartition("region").sortWithinPartitions("region", "r").mapInPandas(tidy(lambda b: _region_links(b, percent)), "a long, b long")


def _split(level: int, percent: int):
    """Regions below (child) and links to pivots (pivot) of a slice's documents."""

    def run(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame({"r": [], "parent": [], "slot": [], "pivot": []})
        g, p = g.drop_duplicates("r"), p.drop_duplicates("p").sort_values("slot")
        r = g["r"].to_numpy()
        far, near = distances([np.frombuffer(s, dtype=np.uint64) for s in g["s"]], [np.frombuffer(s, dtype=np.uint64) for s in p["ps"]], percent)
        parts = divided(far, percent, RADIUS)
        j, x = np.nonzero(near)
        at = np.concatenate(parts)
        slot = np.repeat(np.arange(len(parts)), [len(y) for y in parts])
        rows = pd.DataFrame({"r": np.concatenate((r[at], r[x])), "parent": g["region"].iloc[0], "slot": np.concatenate((slot, np.full(len(x), -1))), "pivot": np.concatenate((np.zeros(len(at), dtype=np.int64), p["p"].to_numpy()[j]))})
        return rows

    return run


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("region").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("c").alias("low"), F.max("c").alias("high"))


def region_links(members: DataFrame, sets: DataFrame, tables: Tables, percent: int, limit: int = LIMIT, levels: int = 4) -> DataFrame:
    """a, b: links that join all linked documents of each region (region, r, n)."""
    members = members.withColumn("c", F.col("r"))
    links = None
    add = lambda x: x if links is None else links.union(x)
    for level in range(levels + 1):
        sizes = tables.keep(_sizes(members).where("low != high"))
        small = (F.col("size") <= limit) & (F.col("shingles") <= SHINGLES)
        links = add(linked(members.join(sizes.where(small), "region"), sets, percent))
        large = sizes.where(~small)
        if large.isEmpty():
            break
        half = max(1, limit // 2)
        slices = F.ceil(F.greatest(F.col("size") / half, F.col("shingles") / (SHINGLES // 2))).cast("int")
        inside = tables.keep(members.join(large.select("region", "size", slices.alias("slices")), "region"))
        if level == levels:
            links = add(_blocked(inside.drop("size", "slices"), sets, tables, percent, limit))
            break
        order = Window.partitionBy("region").orderBy(F.xxhash64(F.lit(level), "r"), "r")
        pivots = inside.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= PIVOTS).join(sets, "r")
        pivots = pivots.select(F.col("region").alias("of"), F.col("r").alias("p"), "slot", F.col("s").alias("ps"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("piece"))
        left = inside.join(sets, "r").select("region", "r", "s", F.pmod(F.xxhash64("r"), F.col("slices")).cast("int").alias("slice"))
        split = tables.keep(left.groupBy("region", "slice").cogroup(pivots.groupBy("of", "piece")).applyInPandas(_split(level, percent), "r long, parent long, slot int, pivot long"))
        links = tables.keep(add(split.where("slot < 0 AND r != pivot").select(F.col("pivot").alias("a"), F.col("r").alias("b"))))
        known = tables.keep(components(links, tables))
        told = tables.keep(inside.drop("c").join(known, "r", "left").withColumn("c", F.coalesce("root", "r")).drop("root"))
        parts = split.where("slot >= 0").groupBy("parent", "slot").agg(F.count("*").alias("m")).groupBy(F.col("parent").alias("region")).agg(F.sum("m").alias("all"), F.max("m").alias("most"))
        poor = tables.keep(parts.join(large.select("region", "size"), "region").where((F.col("most") > MOST * F.col("size")) | (F.col("all") > ALL * F.col("size"))).select("region"))
        if not poor.isEmpty():  # pivots don't divide these
            links = add(_blocked(tables.keep(told.drop("size", "slices").join(poor, "region")), sets, tables, percent, limit))
        below = split.where("slot >= 0").join(poor.withColumnRenamed("region", "parent"), "parent", "left_anti").select("r", F.xxhash64(F.lit(level), "parent", "slot").alias("region"))
        members = tables.keep(below.join(told.select("r", "n", "c").dropDuplicates(["r"]), "r"))
    return links


def _blocked(members: DataFrame, sets: DataFrame, tables: Tables, percent: int, limit: int) -> DataFrame:
    """Links of regions (region, r, n, c) that stay large: all documents are dealt into blocks, and what is outside the
    region's largest part into slices; each slice meets each block, so that every pair that isn't joined meets. A task gets a block and a slice."""
    half = max(1, limit // 2)
    many = lambda m, n: F.ceil(F.greatest(F.col(m) / half, F.col(n) / (SHINGLES // 2))).cast("int")
    parts = members.groupBy("region", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    main = parts.groupBy("region").agg(F.max(F.struct("m", "n", (-F.col("c")).alias("o"))).alias("x"), F.sum("m").alias("m"), F.sum("n").alias("n"))
    main = main.withColumns({"rest_m": F.col("m") - F.col("x.m"), "rest_n": F.col("n") - F.col("x.n")})
    told = tables.keep(main.select("region", (-F.col("x.o")).alias("main"), many("m", "n").alias("blocks"), many("rest_m", "rest_n").alias("slices")).where("slices > 0"))
    dealt = members.join(told, "region")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block, mine = F.pmod(F.xxhash64("r"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "r"), F.col("slices")).cast("int")
    as_block = F.transform(every("slices"), lambda s: F.struct(block.alias("b"), s.alias("s")))
    as_slice = F.transform(every("blocks"), lambda b: F.struct(b.alias("b"), mine.alias("s")))
    cells = F.when(F.col("c") != F.col("main"), F.array_union(as_block, as_slice)).otherwise(as_block)
    met = dealt.withColumn("e", F.explode(cells)).select(F.xxhash64("region", "e.b", "e.s").alias("region"), "r", "c")
    return linked(met, sets, percent)


def first_regions(reps: DataFrame, firsts: DataFrame, rows: DataFrame, tables: Tables, percent: int) -> tuple[DataFrame, DataFrame]:
    """region, r, n of the representatives (r, k, h, n, m) that shared shingles connect, and the sets (r, s) of what may be linked;
    ``firsts`` (r, first) are the m hashes of each document that are tried first."""
    tried = firsts.select("r", "first").join(reps.select("r"), "r")
    met = postings(tried, "first").mapInPandas(tidy(_counted), "r long, c long").groupBy("r").agg(F.sum("c").alias("c"))
    alone = F.col("m") - F.coalesce("c", F.lit(0))
    alive = tables.keep(reps.join(met, "r", "left").where(alone <= F.col("n") - _fewest(percent)).select("k", "h", "r", "n"))
    tables.drop(firsts)
    sets = tables.keep(sets_of(rows, alive))
    common = tables.keep(postings(sets, "s").mapInPandas(tidy(shared), "r long, g long, df long").join(alive.select("r", "n"), "r"))
    of = Window.partitionBy("r")
    rarest = common.withColumns({"m": F.count("*").over(of), "place": F.row_number().over(of.orderBy("df", "g"))})
    rarest = tables.keep(rarest.where(F.col("place") <= F.col("m") - _fewest(percent) + 1).select("r", "g"))
    heads = tables.keep(rarest.groupBy("g").agg(F.min("r").alias("a"), F.count("*").alias("c")).where("c > 1").select("g", "a"))
    edges = rarest.join(heads, "g").where("a != r").select("a", F.col("r").alias("b"))
    found = tables.keep(components(edges, tables))
    regions = tables.keep(found.join(alive.select("r", "n"), "r").select(F.col("root").alias("region"), "r", "n"))
    tables.drop(common, rarest, heads, found, alive)
    return regions, sets


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id of each document; documents link where 100 * intersection >= percent * union."""
    tables = Tables(docs.sparkSession, "jaccard")
    every = docs.select(F.col(id_col).cast("long").alias("k"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    rows = every.where("k IS NOT NULL")
    firsts = tables.keep(profiles(rows, percent).withColumn("r", F.monotonically_increasing_id()))
    known = tables.keep(firsts.select("k", "h", "n", "finger", "r", (F.length("first") / 8).cast("long").alias("m")))
    full = known.where("n > 0")
    copies = tables.keep(full.groupBy("finger").agg(F.min("r").alias("r"), F.min("k").alias("least")))
    reps = tables.keep(full.select("r", "k", "h", "n", "m").join(copies.select("r"), "r"))
    regions, sets = first_regions(reps, firsts, rows, tables, percent)
    links = tables.keep(region_links(regions, sets, tables, percent, limit))
    found = tables.keep(components(links, tables).join(copies, "r"))
    least = tables.keep(found.groupBy("root").agg(F.min("least").alias("id")))
    named = tables.keep(copies.join(found.join(least, "root").select("r", "id"), "r", "left").select("finger", F.coalesce("id", "least").alias("id")))
    tables.drop(reps, sets, regions, links, found, least, copies)
    classes = full.join(named, "finger").select(F.col("k").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    empty = known.where("n = 0").select("k", "n", "k")

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in text_parts(batches):
            yield pd.DataFrame({"doc_id": b["k"], "n_shingles": [len(s) for s in shingle_sets(b["t"].tolist())], "component_id": b["k"]})

    return classes.union(empty).union(every.where("k IS NULL").select("k", "t").mapInPandas(alone, "doc_id long, n_shingles long, component_id long"))
