"""Ranked lexical search with Block-Max MaxScore over document shards.

The index has a shard for every ``SHARD`` characters of a task's documents, so building it shuffles nothing. Texts are
hashed as they come, so that a task holds a shard's hashes and never its texts, and lists leave it ``ROWS`` at a time. A shard
holds, for each of its terms, a list of (document, occurrences) in blocks of ``BLOCK`` postings, packed as variable-length
gaps, and for each block its last document, most occurrences, shortest document and end: what bounds the
block's scores without unpacking it. Terms are told apart by 64-bit hashes of their bytes, never by the bytes themselves.

A search joins the lists with the queries' terms, sums document frequencies, and evaluates every shard for
a block of queries at a time. For a query the lists stand in order of their highest bound; those of the lowest bounds that
together can't pass the score of the ``k``-th document so far are non-essential. Candidates come from the
essential lists only. For each candidate the block maxima of the non-essential lists are added up first, and blocks are
unpacked only where a candidate may still pass; list by list, what has fallen behind is dropped. Documents are
met in order of their ids, so a later document with an equal score never enters. Every shard gives its ``k`` best, which Spark merges.

Documents with null, empty or termless texts have no terms, count nowhere and are never found; very long texts are hashed
a megabyte at a time. Rows that repeat an id are documents of their own; rows with a null id are found with a null id,
last among equal scores. Items that repeat an id are one item with the terms of all; items without id or term
give no rows. Empty tables give no rows. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm import textgrams as tg
from foliospark.llm.common import Tables, text_parts, tidy
from foliospark.sources.batches import map_files

#: Characters of a shard, if of more than one document.
SHARD = 16 << 20
#: Postings of a block.
BLOCK = 64
#: Lists that are Python objects at once, and values that are packed at once.
ROWS, PACKED = 20_000, 1 << 17
#: Items that a task evaluates on a shard at a time.
ITEMS = 256
_INDEX = "shard long, h long, df long, heads binary, data binary, ids binary, sizes binary, named long, docs long, terms long, part int"


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the values, seven bits a byte, the last under 128; and where each value's bytes end."""
    if len(values) > PACKED:  # what it takes beside the bytes doesn't grow with the values
        parts = [packed(values[k : k + PACKED]) for k in range(0, len(values), PACKED)]
        past = np.cumsum([0, *(len(x) for x, _ in parts)])
        return np.concatenate([x for x, _ in parts]), np.concatenate([e + n for (_, e), n in zip(parts, past, strict=False)])
    v = values.astype(np.int64)
    size = np.ones(len(v), dtype=np.int64)
    for bits in (7, 14, 21, 28):
        size += v >= 1 << bits
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(v) else 0, dtype=np.uint8)
    for turn in range(5):
        at = np.flatnonzero(size > turn)
        out[end[at] - size[at] + turn] = (v[at] >> 7 * turn & 127) + np.where(size[at] > turn + 1, 128, 0)
    return out, end


def unpacked(data: np.ndarray) -> np.ndarray:
    last = data < 128
    if last.all():
        return data.astype(np.int64)
    end = np.flatnonzero(last)
    start = np.concatenate(([0], end[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(start, end - start + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, start)


def _lists(shard: int, ids: np.ndarray, named: np.ndarray, texts: list[str | None]) -> Iterator[pd.DataFrame]:
    """Index rows of a shard: its lists (part 0), then its documents (part 1)."""
    yield from _made(shard, ids, named, *_counted(texts))


def _counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text's number and occurrences of each term of each text, by text; and the terms of each text with repeats."""
    words, offsets = tg.word_hashes(texts, lower=True, terms=True)
    doc = tg.owner(offsets).astype(np.int32)
    by = np.lexsort((words, doc))
    h, doc = words[by], doc[by]
    at = np.flatnonzero(np.concatenate(([len(h) > 0], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
    return h[at], doc[at], np.diff(np.append(at, len(h))).astype(np.int32), np.diff(offsets)


def _made(shard: int, ids: np.ndarray, named: np.ndarray, h: np.ndarray, doc: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> Iterator[pd.DataFrame]:
    order = np.lexsort((ids, ~named))
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order))
    sizes = sizes[order]
    if len(h):
        doc = place[doc]
        by = np.lexsort((doc, h))
        h, doc, times = h[by], doc[by], times[by]
        del by
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        many = np.diff(np.append(first, len(h)))
        gaps = np.diff(doc, prepend=np.int32(0))
        gaps[first] = doc[first] + 1
        block = np.flatnonzero((np.arange(len(h)) - np.repeat(first, many)) % BLOCK == 0)
        ends = np.append(block[1:], len(h))
        data, stop = packed(np.column_stack((gaps, times)).ravel())
        began = np.repeat(np.concatenate(([0], stop[2 * (first[1:]) - 1])), -(-many // BLOCK))
        heads = np.column_stack((doc[ends - 1], np.maximum.reduceat(times, block), np.minimum.reduceat(sizes[doc], block), stop[2 * ends - 1] - began)).astype("<u4")
        edge = np.append(np.searchsorted(block, first), len(block))
        cuts = np.concatenate(([0], stop[2 * np.append(first[1:], len(h)) - 1]))
        raw, body, names = heads.tobytes(), data.tobytes(), h[first].view(np.int64)
        del h, doc, times, gaps, block, ends, data, stop, began, heads, first
        for k in range(0, len(names), ROWS):
            x, y = edge[k : k + ROWS + 1].tolist(), cuts[k : k + ROWS + 1].tolist()
            rows = {"h": names[k : k + ROWS], "df": many[k : k + ROWS], "heads": [raw[16 * a : 16 * b] for a, b in zip(x, x[1:], strict=False)], "data": [body[a:b] for a, b in zip(y, y[1:], strict=False)]}
            yield pd.DataFrame({"shard": shard, **rows, "ids": None, "sizes": None, "named": 0, "docs": 0, "terms": 0, "part": 0})
    told = {"ids": [ids[order].astype("<i8").tobytes()], "sizes": [sizes.astype("<u4").tobytes()], "named": int(named.sum()), "docs": int((sizes > 0).sum()), "terms": int(sizes.sum())}
    yield pd.DataFrame({"shard": shard, "h": 0, "df": 0, "heads": None, "data": None, **told, "part": 1})


def _shards(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    held: list[tuple[np.ndarray, ...]] = []
    size, shard, count = 0, TaskContext.get().partitionId() << 32, 0
    for b in text_parts(batches):
        lengths = b["t"].map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy(dtype=np.int64)
        start = 0
        while start < len(b):
            room = int(np.searchsorted(np.cumsum(lengths[start:]), max(1, limit - size), side="left")) + 1
            part = b.iloc[start : start + room]
            h, doc, times, sizes = _counted(part["t"].tolist())
            held.append((part["k"].to_numpy(), part["named"].to_numpy(dtype=bool), h, doc + np.int32(count), times, sizes))
            count += len(part)
            size += int(lengths[start : start + room].sum())
            start += room
            if size >= limit:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size, count = [], 0, 0
                yield from _made(shard, *whole)
                shard += 1
    if held:
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        held = []
        yield from _made(shard, *whole)


class List:
    """A term's list in a shard, with the bounds of its blocks; ``unpacks`` counts blocks unpacked."""

    unpacks = 0

    def __init__(self, weight: int, heads: bytes, data: bytes, m_of):
        self.weight, self.data = weight, np.frombuffer(data, dtype=np.uint8)
        self.last, top, least, self.ends = np.frombuffer(heads, dtype="<u4").reshape(-1, 4).T.astype(np.int64)
        self.bound = weight * (1_000_000_000 * top // (1000 * top + 20 * m_of(least)))
        self.most = int(self.bound.max())

    def postings(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and occurrences of blocks a to b - 1."""
        List.unpacks += b - a
        values = unpacked(self.data[self.ends[a - 1] if a else 0 : self.ends[b - 1]])
        return (self.last[a - 1] if a else -1) + np.cumsum(values[0::2]), values[1::2]

    def scores(self, times: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.weight * (1_000_000_000 * times // (1000 * times + 20 * m))


def best(lists: list[List], m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k documents of the highest scores above 0, ties to the earlier one, and their scores."""
    lists = sorted(lists, key=lambda x: x.most)
    sums = np.concatenate(([0], np.cumsum([x.most for x in lists])))
    docs, scores, floor = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    start, step = 0, 256
    while start < len(m):
        stop = min(len(m), start + step)
        weak = int(np.searchsorted(sums, floor, side="right")) - 1  # lists that together can't pass the floor
        if weak == len(lists):
            break
        total = np.zeros(stop - start, dtype=np.int64)
        for x in lists[weak:]:
            a, b = np.searchsorted(x.last, (start, stop - 1)).tolist()
            b = min(b + 1, len(x.last))
            if a < b:
                doc, times = x.postings(a, b)
                at = slice(*np.searchsorted(doc, (start, stop)).tolist())
                total[doc[at] - start] += x.scores(times[at], m[doc[at]])
        some = np.flatnonzero(total)
        have, some = total[some], some + start
        if len(some) and weak:
            where = [np.searchsorted(x.last, some) for x in lists[:weak]]
            hope = np.cumsum([np.append(x.bound, 0)[w] for x, w in zip(lists, where, strict=False)], axis=0)
            left = np.arange(len(some))
            for i in range(weak - 1, -1, -1):
                left = left[have[left] + hope[i][left] > floor]
                if not len(left):
                    break
                x, block = lists[i], where[i][left]
                inside = block < len(x.last)
                blocks = np.unique(block[inside])
                for run in np.split(blocks, np.flatnonzero(np.diff(blocks) > 1) + 1) if len(blocks) else ():
                    doc, times = x.postings(int(run[0]), int(run[-1]) + 1)
                    mine = left[(block >= run[0]) & (block <= run[-1])]
                    at = np.searchsorted(doc, some[mine])
                    hit = doc[np.minimum(at, len(doc) - 1)] == some[mine]
                    have[mine[hit]] += x.scores(times[at[hit]], m[some[mine[hit]]])
            some, have = some[left], have[left]
        up = np.flatnonzero(have > floor)
        if len(up):
            docs, scores = np.concatenate((docs, some[up])), np.concatenate((scores, have[up]))
            top = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[top], scores[top]
            floor = int(scores[-1]) if len(scores) == k else 0
        start, step = stop, min(4096, step * 2)
    return docs, scores


def _evaluated(n_docs: int, n_terms: int, k: int):
    m_of = lambda n: 50 + 50 * n * n_docs // n_terms

    def run(g: pd.DataFrame) -> pd.DataFrame:
        mine = g[g["ids"].notna()].iloc[0]
        ids, named = np.frombuffer(mine["ids"], dtype="<i8"), int(mine["named"])
        m = m_of(np.frombuffer(mine["sizes"], dtype="<u4").astype(np.int64))
        of: dict[int, list[List]] = {}
        for r in g[g["ids"].isna()].itertuples():
            one = List(int(r.w), r.heads, r.data, m_of)
            for item in r.items:
                of.setdefault(int(item), []).append(one)
        out = []
        for item, lists in of.items():
            docs, scores = best(lists, m, k)
            if len(docs):
                out.append(pd.DataFrame({"item_id": item, "doc_id": pd.array(ids[docs], dtype="Int64").copy(), "score": scores}))
                out[-1].loc[docs >= named, "doc_id"] = pd.NA
        return pd.concat(out) if out else pd.DataFrame({"item_id": [], "doc_id": [], "score": []})

    return run


class Index:
    """The shards of a table of documents, kept in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD):
        self.tables = Tables(docs.sparkSession, "lexical")
        k = F.col(id_col).cast("long")
        rows = docs.select(F.coalesce(k, F.lit(0)).alias("k"), k.isNotNull().alias("named"), F.col(text_col).alias("t"))
        made = self.tables.keep(map_files(rows, tidy(lambda b: _shards(b, limit)), _INDEX), "part")
        self.lists = made.where("part = 0").select("shard", "h", "df", "heads", "data")
        self.shards = made.where("part = 1").select("shard", "ids", "sizes", "named", "docs", "terms")
        told = self.shards.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
        self.docs, self.terms = told.docs or 0, told.terms or 0

    def search(self, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """item_id, rank, doc_id, score of each item's k best documents."""
        spark = queries.sparkSession
        if not self.docs:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                words, offsets = tg.word_hashes(b["t"].tolist(), lower=True, terms=True)
                yield pd.DataFrame({"item": b["k"].to_numpy()[tg.owner(offsets)], "h": words.view(np.int64)}).drop_duplicates()

        asked = queries.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).where("k IS NOT NULL")
        asked = self.tables.keep(asked.mapInPandas(split, "item long, h long").distinct())
        blocks = -(-(asked.agg(F.count_distinct("item")).first()[0]) // ITEMS)
        if not blocks:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        hit = self.lists.join(asked.select("h").distinct(), "h", "left_semi")
        weights = hit.groupBy("h").agg(F.sum("df").alias("df")).select("h", F.floor(1000 * F.log(F.lit(2.0 * self.docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
        terms = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).groupBy("block", "h").agg(F.collect_list("item").alias("items"))  # the items of a block: ITEMS on average
        terms = self.tables.keep(terms.join(weights, "h"))
        lists = self.lists.join(terms, "h").select("shard", "block", "w", "items", "heads", "data", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("sizes"), F.lit(0).cast("long").alias("named"))
        each = self.shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        whole = each.select("shard", "block", F.lit(0).cast("long").alias("w"), F.array().cast("array<long>").alias("items"), F.lit(None).cast("binary").alias("heads"), F.lit(None).cast("binary").alias("data"), "ids", "sizes", "named")
        found = lists.union(whole).groupBy("shard", "block").applyInPandas(_evaluated(self.docs, self.terms, k), "item_id long, doc_id long, score long")
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
