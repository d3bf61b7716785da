"""Near-duplicate classes by a chosen-path set similarity join over word shingles.

Texts become sets of hashed 5-word shingles and fixed-length minwise signatures; equal sets are one
representative from then on. In each of several independent trees a node chooses, by a hash of its own
name, which signature places its documents branch on (1/threshold places on average), so a pair at the
threshold is expected to stay together in one child at each of them. Nodes of one document are dropped, nodes of up to
``node_limit`` documents are compared exhaustively on signatures, larger ones branch further. ``trees_for`` gives
the number of trees from the target recall. Where most of a large node is close to its first document, what is close
needs no more branching: distances add up, so all of its partners are near that document too and are tied
to it. What is still large after ``max_depth`` levels is tied to its first document whole.

The trees thus give coarse classes that contain every linked pair found. Inside a class all pairs that aren't
joined yet are counted exactly, from the lists of documents of each shingle, and linked by
100 * intersection >= 75 * union. A coarse class of more than ``class_limit`` documents or SHINGLES shingles is dealt
into blocks that share its leaders; what the blocks leave apart from the largest part then meets every block, slice by slice.

Null and empty texts have an empty set, are linked with nothing and stay; a text with fewer than five words has its
whole word sequence as its one shingle; very long texts are hashed a megabyte at a time. Rows with a null id are
returned alone. Of a repeated id each row is judged by its own text; rows that are equal in id and text stay or go
together. Empty tables give empty results. Extra columns are ignored or kept, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import textgrams as tg
from foliospark.llm.common import Tables, text_parts, tidy, whole_runs

#: Places of a minwise signature.
PLACES = 128
#: A screened pair of a node has at least this share of equal places: four standard deviations under 0.75.
SCREEN = 0.60
#: Documents this close to a large node's first one stop branching; their partners at 0.75 have at least 0.8 - 0.25 of it, less four standard deviations.
CLOSE, TIED = 0.80, 0.37
#: Shingles of a class, block or slice that one task compares, if of more than one document.
SHINGLES = 2_000_000
_MULTIPLIERS = [(0x9E3779B97F4A7C15 * (2 * i + 1) ^ (i << 40)) & ((1 << 64) - 1) | 1 for i in range(PLACES)]


def trees_for(recall: float, threshold: float, levels: int = 1) -> int:
    """Trees after which a pair at the threshold is missed with a probability of 1 - recall at most.

    A node branches on one place, and on a second with probability 1 / threshold - 1; a tree finds the pair
    if some path of ``levels`` equal places stays together.
    """
    found = 1.0
    for _ in range(levels):
        second = 1 / threshold - 1
        lost = 1 - threshold * found
        found = 1 - lost * (1 - second + second * lost)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    words, offsets = tg.word_hashes(texts, lower=True)
    runs = tg.windows(words, size)
    out = []
    for a, b in pairwise(offsets.tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(tg.windows(words[a:b], b - a, salt=1))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise signature of each non-empty set."""
    flat = tg.mix(np.concatenate(sets))
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), PLACES), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i, m in enumerate(_MULTIPLIERS):
            out[:, i] = (np.minimum.reduceat(flat * np.uint64(m), starts) >> np.uint64(32)).astype(np.uint32)
    return out


def _children(node: np.ndarray, sig: np.ndarray, places: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and names of the child nodes: each node chooses one place, and a second with what is over one."""
    first = tg.mix(node, 11)
    rows, names = [], []
    for turn, (place_hash, use) in enumerate(((first, np.ones(len(node), dtype=bool)), (tg.mix(first, 12), (tg.mix(first, 13) >> np.uint64(40)) / float(1 << 24) < places - 1))):
        place = (place_hash % np.uint64(PLACES)).astype(np.int64)
        at = np.flatnonzero(use)
        token = sig[at, place[at]].astype(np.uint64)
        rows.append(at)
        names.append(tg.mix(tg.mix(node[at], 17 + turn) ^ (token + (place[at].astype(np.uint64) << np.uint64(32))), 19))
    return np.concatenate(rows), np.concatenate(names)


def _lists(n: int, rows: np.ndarray, names: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for i, name in zip(rows.tolist(), names.view(np.int64).tolist(), strict=True):
        out[i].append(name)
    return out


def profiles(docs: DataFrame, trees: int, threshold: float, size: int = 5) -> DataFrame:
    """k, h, n, finger (of the set), sig (packed, 16 bits a place) and roots (nodes under the trees' roots) of each document (k, h, t)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in text_parts(batches):
            sets = shingle_sets(part["t"].tolist(), size)
            at = np.flatnonzero([len(s) > 0 for s in sets])
            sig, roots = [b""] * len(sets), [[] for _ in sets]
            if len(at):
                wide = signatures([sets[i] for i in at])  # all 32 bits for the roots, so that few meet by chance
                short = wide.astype(np.uint16)
                each = [_children(np.full(len(at), tree + 1, dtype=np.uint64), wide, 1 / threshold) for tree in range(trees)]
                found = _lists(len(at), np.concatenate([x for x, _ in each]), np.concatenate([y for _, y in each]))
                for i, row, names in zip(at.tolist(), short, found, strict=True):
                    sig[i], roots[i] = row.tobytes(), names
            yield pd.DataFrame({"k": part["k"].values, "h": part["h"].values, "n": [len(s) for s in sets], "finger": [fingerprint(s) for s in sets], "sig": sig, "roots": roots})

    return docs.mapInPandas(tidy(run), "k long, h long, n long, finger binary, sig binary, roots array<long>")


def least_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place of each component once the edges i-j join the components that ``label`` gives."""
    label = label.copy()
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def screened(sig: np.ndarray, low: float, block: int = 256) -> np.ndarray:
    """Labels (least places) of what pairs with enough equal places join, compared block by block."""
    label = np.arange(len(sig))
    for a in range(0, len(sig), block):
        left = sig[a : a + block]
        for b in range(a, len(sig), block):
            right = sig[b : b + block]
            same = np.zeros((len(left), len(right)), dtype=np.uint8)
            for p in range(PLACES):
                same += left[:, p, None] == right[None, :, p]
            i, j = np.nonzero(same >= low * PLACES)
            label = least_labels(label, i + a, j + b)
    return label


def _node_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars (a below b) of the screened pairs of each node, from rows (node, r, sig) in order; small nodes are compared side by side."""
    few = 16
    for g in whole_runs(batches, "node"):
        node, r = g["node"].to_numpy(), g["r"].to_numpy()
        sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint16).reshape(len(g), PLACES)
        edge = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        size = np.diff(np.append(edge, len(node)))
        small = np.repeat(size <= few, size)
        left, right = [], []
        for d in range(1, few):
            at = np.flatnonzero((node[d:] == node[:-d]) & small[d:])
            for part in np.split(at, range(20_000, len(at), 20_000)):
                hit = part[(sig[part] == sig[part + d]).sum(axis=1) >= SCREEN * PLACES]
                left.append(hit)
                right.append(hit + d)
        label = least_labels(np.arange(len(node)), np.concatenate(left), np.concatenate(right))
        for start, n in zip(edge[size > few].tolist(), size[size > few].tolist(), strict=True):
            label[start : start + n] = screened(sig[start : start + n], SCREEN) + start
        b = np.flatnonzero(label != np.arange(len(node)))
        yield pd.DataFrame({"a": r[label[b]], "b": r[b]})


def _branched(batches: Iterator[pd.DataFrame], places: float) -> Iterator[pd.DataFrame]:
    """Likeness of each row of a large node to the node's first document, and the row's child nodes."""
    for b in batches:
        if len(b):
            sig, first = (np.frombuffer(b"".join(b[c]), dtype=np.uint16).reshape(len(b), PLACES) for c in ("sig", "first"))
            at, names = _children(b["node"].to_numpy().astype(np.int64).view(np.uint64), sig, places)
            yield pd.DataFrame({"r": b["r"], "node": b["node"], "head": b["head"], "share": (sig == first).mean(axis=1), "below": _lists(len(b), at, names)})


def coarse_edges(reps: DataFrame, tables: Tables, threshold: float = 0.75, node_limit: int = 4096, max_depth: int = 6) -> tuple[DataFrame, list[DataFrame]]:
    """a, b: pairs of representatives (r, sig, roots) that tie what the trees found together; and the tables that they are read from."""
    sigs = reps.select("r", "sig")
    nodes, edges, used = reps.select("r", F.explode("roots").alias("node")), None, []
    for depth in range(1, max_depth + 1):
        sizes = tables.keep(nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("r").alias("head")).where("size > 1"))
        used.append(sizes)
        small = nodes.join(sizes.where(F.col("size") <= node_limit).select("node"), "node").join(sigs, "r")
        found = small.select("node", "r", "sig").repartition("node").sortWithinPartitions("node", "r").mapInPandas(tidy(_node_edges), "a long, b long")
        edges = found if edges is None else edges.union(found)
        crowded = sizes.where(F.col("size") > node_limit)
        if crowded.isEmpty():
            break
        large = nodes.join(crowded.select("node", "head"), "node")
        if depth == max_depth:
            edges = edges.union(large.where("r != head").select(F.col("head").alias("a"), F.col("r").alias("b")))
            break
        heads = tables.keep(crowded.select("node", F.col("head").alias("r")).join(sigs, "r").select("node", F.col("sig").alias("first")))
        rows = large.join(sigs, "r").join(heads, "node").select("r", "node", "head", "sig", "first")
        liked = tables.keep(rows.mapInPandas(tidy(lambda b: _branched(b, 1 / threshold)), "r long, node long, head long, share double, below array<long>"))
        dense = tables.keep(liked.groupBy("node").agg(F.avg((F.col("share") >= CLOSE).cast("int")).alias("close")).where("close >= 0.5"))
        marked = liked.join(dense, "node", "left")
        edges = edges.union(marked.where(F.col("close").isNotNull() & (F.col("share") >= TIED) & (F.col("r") != F.col("head"))).select(F.col("head").alias("a"), F.col("r").alias("b")))
        nodes = marked.where(F.col("close").isNull() | (F.col("share") < CLOSE)).select("r", F.explode("below").alias("node")).distinct()
        used += [heads, liked, dense]
    return edges, used


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """r, root: the least member of each connected component, by alternating large- and small-star steps over edges a, b.

    Least neighbours come from partial aggregation and are tables before they are joined, so a hub's rows can be split.
    """
    pairs = tables.keep(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(pairs):
        both = pairs.union(pairs.select(F.col("v"), F.col("u")))
        least = tables.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        star = tables.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        down = tables.keep(star.groupBy("u").agg(F.min("v").alias("m")))
        ends = star.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = tables.keep(ends.select("e.*").where("u != v").distinct())
        tables.drop(pairs, least, star, down)
        pairs = after
    return pairs.select(F.col("u").alias("r"), F.col("v").alias("root")).union(pairs.select(F.col("v"), F.col("v")).distinct())


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each u has one v only and is no v itself."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("top")).union(pairs.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up + top > 1").isEmpty()


def linked_labels(sets: list[np.ndarray], label: np.ndarray, leaders: int = 32, percent: int = 75) -> np.ndarray:
    """Labels (least places) once all pairs with 100 * intersection >= percent * union are joined to what ``label`` joins.

    Intersections are counted over the lists of documents of each shingle. After some leaders only documents outside
    the largest component are compared, each with all others: pairs inside it are joined already.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    doc = np.repeat(np.arange(len(sets)), n)
    _, run, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[run] > 1
    able = 100 * np.bincount(doc[shared], minlength=len(sets)) >= percent * n  # else too much of the set is in no other
    order = np.argsort(run, kind="stable")
    lists, first = doc[order], np.concatenate(([0], np.cumsum(times)))
    edge = np.concatenate(([0], np.cumsum(n)))

    def join(x: int) -> np.ndarray:
        own = run[edge[x] : edge[x + 1]]
        own = own[times[own] > 1]
        many = times[own]
        places = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        both = np.bincount(lists[places], minlength=len(sets))
        hit = np.flatnonzero(100 * both >= percent * (n + n[x] - both))
        return least_labels(label, np.full(len(hit), x), hit)

    todo = np.flatnonzero(able)
    for x in todo[:leaders].tolist():
        label = join(x)
    if len(todo) > leaders:
        main = np.bincount(label).argmax()
        for x in todo[leaders:].tolist():
            if label[x] != label[main]:
                label = join(x)
    return label


def _class_links(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Links (a, b) that join the given parts (c) of each class, from rows (key, r, c, finger, t) in order of the key."""
    for g in whole_runs(batches, key):
        keys = g[key].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        out_a, out_b = [], []
        for x, y in pairwise(edge.tolist()):
            part = g.iloc[x:y]
            part = part[~part["r"].duplicated().to_numpy()]  # rows that are equal in id and text
            sets = shingle_sets(part["t"].tolist())
            mine = np.array([fingerprint(s) == bytes(f) for s, f in zip(sets, part["finger"], strict=True)])  # a repeated id has several texts
            if mine.sum() < 2:
                continue
            r, c = part["r"].to_numpy()[mine], part["c"].to_numpy()[mine]
            _, at, start = np.unique(c, return_index=True, return_inverse=True)
            label = least_labels(np.arange(len(r)), np.arange(len(r)), at[start])
            after = linked_labels([s for s, m in zip(sets, mine.tolist(), strict=True) if m], label)
            new = np.flatnonzero((label == np.arange(len(r))) & (after != label))
            out_a.append(r[after[new]])
            out_b.append(r[new])
        if out_a:
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def _linked(members: DataFrame, *key: str) -> DataFrame:
    """Links of rows (key, r, c, finger, t), compared key by key."""
    rows = members.select(F.struct(*key).alias("s") if len(key) > 1 else F.col(key[0]).alias("s"), "r", "c", "finger", "t")
    rows = rows.withColumn("s", F.xxhash64("s")) if len(key) > 1 else rows
    return rows.repartition("s").sortWithinPartitions("s", "r").mapInPandas(tidy(lambda b: _class_links(b, "s")), "a long, b long")


def labelled(docs: DataFrame, tables: Tables, id_col: str, text_col: str, recall: float, node_limit: int, class_limit: int, max_depth: int) -> DataFrame:
    """k, h (hash of the text), n, component, first: of each row with an id; ``first`` is the class's least (k, h)."""
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).where("k IS NOT NULL")
    known = tables.keep(profiles(rows, trees_for(recall, 0.75, 2), 0.75).withColumn("r", F.monotonically_increasing_id()))
    full = known.where("n > 0")
    copies = tables.keep(full.groupBy("finger").agg(F.min("r").alias("r"), F.min(F.struct("k", "h")).alias("least")))
    reps = tables.keep(full.select("r", "k", "h", "n", "sig", "roots", "finger").join(copies.select("r"), "r"))
    edges, used = coarse_edges(reps, tables, 0.75, node_limit, max_depth)
    coarse = components(edges, tables)
    tables.drop(*used)
    classed = tables.keep(reps.select("r", "k", "h", "n", "finger").join(coarse, "r"))
    tables.drop(reps)
    sizes = tables.keep(classed.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")))
    small = (F.col("size") <= class_limit) & (F.col("shingles") <= SHINGLES)
    # classes grow with the documents: no broadcast at any size
    members = lambda which: rows.join(classed.join(sizes.where(which), "root").hint("merge"), ["k", "h"]).withColumn("c", F.col("r"))
    links = _linked(members(small), "root")
    if not sizes.where(~small).isEmpty():
        links = links.union(_large_classes(tables.keep(members(~small)), tables, class_limit))
    found = tables.keep(components(links, tables).join(copies, "r"))
    least = tables.keep(found.groupBy("root").agg(F.min("least").alias("first")))
    named = tables.keep(copies.join(found.join(least, "root").select("r", "first"), "r", "left").select("finger", F.coalesce("first", "least").alias("first")))
    tables.drop(classed, sizes, found, least, copies)
    judged = full.join(named, "finger").select("k", "h", "n", "first")
    return judged.union(known.where("n = 0").select("k", "h", "n", F.struct("k", "h").alias("first")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.999999, node_limit: int = 4096, class_limit: int = 4096, max_depth: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document; ``recall`` is what the trees are planned for, at the threshold."""
    tables = Tables(docs.sparkSession, "neardup")
    judged = labelled(docs, tables, id_col, text_col, recall, node_limit, class_limit, max_depth)
    alone = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).where("k IS NULL").mapInPandas(_alone, "doc_id long, n_shingles long, component_id long, kept boolean")
    return judged.select(F.col("k").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("first.k").alias("component_id"), (F.col("k") == F.col("first.k")).alias("kept")).union(alone)


def _alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in text_parts(batches):
        yield pd.DataFrame({"doc_id": b["k"], "n_shingles": [len(s) for s in shingle_sets(b["t"].tolist())], "component_id": b["k"], "kept": True})


def _large_classes(large: DataFrame, tables: Tables, limit: int) -> DataFrame:
    """Links of coarse classes that are too large for one task; no task gets more than about ``limit`` documents.

    First each class is dealt by hash into blocks of half a limit, and an eighth as many leaders, chosen by hash, go to
    all of its blocks: that joins most of what belongs together. Then every document outside its class's largest
    part is compared with all others: these are dealt into slices of half a limit, and each slice meets each block.
    Pairs inside the largest part are joined already, so no pair is left out, however many slices there are.
    """
    half = max(1, limit // 2)
    blocks = tables.keep(large.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / half, F.sum("n") / (SHINGLES // 2))).cast("int").alias("blocks"), F.count("*").alias("many")))
    dealt = large.join(blocks, "root").withColumn("hash", F.xxhash64("r"))
    own = F.pmod(F.shiftright("hash", 31), F.col("blocks")).cast("int")
    leads = F.pmod("hash", F.lit(1 << 30)) * F.col("blocks") * 8 < F.lit(float(1 << 30))
    spread = dealt.withColumn("block", F.explode(F.when(leads, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    links = tables.keep(_linked(spread.select("root", "block", "r", "c", "finger", "t"), "root", "block"))
    parts = tables.keep(components(links, tables).withColumnRenamed("root", "part"))
    joined = tables.keep(dealt.select("root", "r", "finger", "t", "n", "blocks", own.alias("block")).join(parts, "r", "left").withColumn("c", F.coalesce("part", "r")).drop("part"))
    shares = joined.groupBy("root", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    main = shares.groupBy("root").agg(F.max(F.struct("m", "n", (-F.col("c")).alias("o"))).alias("x"), F.sum("m").alias("m"), F.sum("n").alias("n"))
    main = tables.keep(main.select("root", (-F.col("x.o")).alias("main"), F.ceil(F.greatest((F.col("m") - F.col("x.m")) / half, (F.col("n") - F.col("x.n")) / (SHINGLES // 2))).cast("int").alias("slices")))
    told = joined.join(main, "root").where("slices > 0")
    rest = F.col("c") != F.col("main")
    mine = F.pmod(F.xxhash64(F.lit(1), "r"), F.col("slices")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cells = F.transform(every("slices"), lambda s: F.struct(F.col("block").alias("block"), s.alias("slice")))
    as_slice = F.transform(F.array_except(every("blocks"), F.array("block")), lambda b: F.struct(b.alias("block"), mine.alias("slice")))
    met = told.withColumn("e", F.explode(F.when(rest, F.concat(cells, as_slice)).otherwise(cells))).select("root", "e.block", "e.slice", "r", "c", "finger", "t")
    return links.union(_linked(met, "root", "block", "slice"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the first of their class, with their columns; rows with a null id stay."""
    judged = labelled(docs, Tables(docs.sparkSession, "neardup"), id_col, text_col, 0.999999, 4096, 4096, 6)
    gone = judged.where(F.struct("k", "h") != F.col("first")).select("k", "h").distinct()
    same = (docs[id_col].cast("long") == gone["k"]) & (F.xxhash64(docs[text_col]) == gone["h"])
    return docs.join(gone, same, "left_anti")
