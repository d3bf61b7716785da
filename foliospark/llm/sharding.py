"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

At each level every child draws -ln(u)/weight, with u from a hash of the row's key and the child's name,
and the least draw wins, so a child gets rows in proportion to its weight and a changed weight moves rows
only into or out of that child's subtree. Law ``key``: the id and the tree decide; a further shard stands
in a region of its own, so it takes rows only into itself.

DataFrame functions only. Null ids draw as one key; null texts have size 1; very long texts count like any other; repeated
ids share a shard and get slots of their own, and their texts are spread over its parts; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a shard that are numbered apart; shards x parts rows of counts are the largest thing broadcast.
PARTS = 1024


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int = 16, per_rack: int = 4, per_region: int = 8) -> list[Leaf]:
    """Shards of weight 1, filled rack by rack and region by region."""
    return [Leaf(i // per_region, i // per_rack, i) for i in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a rack and region of its own."""
    return [*tree, Leaf(max(x.region for x in tree) + 1, max(x.rack for x in tree) + 1, max(x.shard for x in tree) + 1, weight)]


def _draw(key: Column, level: str, children: dict[int, float]) -> Column:
    """The child with the least weighted draw; ties (none expected) go to the smaller number."""
    draws = []
    for child, weight in sorted(children.items()):
        digits = F.substring(F.md5(F.concat(key, F.lit(f"/{level}/{child}")).cast("binary")), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(child).alias("child")))
    return draws[0]["child"] if len(draws) == 1 else F.array_min(F.array(*draws))["child"]


def place(key: Column, tree: list[Leaf]) -> Column:
    """Shard of a string key."""
    regions: dict[int, dict[int, dict[int, float]]] = defaultdict(lambda: defaultdict(dict))
    for x in tree:
        regions[x.region][x.rack][x.shard] = x.weight
    weight = {r: sum(sum(s.values()) for s in racks.values()) for r, racks in regions.items()}

    def pick(at: Column, options: dict[int, Column]) -> Column:
        first, *rest = sorted(options.items())
        out = F.when(at == first[0], first[1])
        for number, value in rest:
            out = out.when(at == number, value)
        return out

    def shard_of(racks: dict[int, dict[int, float]]) -> Column:
        rack = _draw(key, "rack", {k: sum(s.values()) for k, s in racks.items()})
        options = {k: _draw(key, "shard", s) for k, s in racks.items()}
        return next(iter(options.values())) if len(options) == 1 else pick(rack, options)

    options = {r: shard_of(racks) for r, racks in regions.items()}
    return (next(iter(options.values())) if len(options) == 1 else pick(_draw(key, "region", weight), options)).cast("int")


def assign(docs: DataFrame, tree: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard) and grown_shard of every row."""
    tree = tree or even_tree()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("d_size"), F.crc32(text.cast("binary")).alias("text_crc32")).select(
        "doc_id",
        (F.col("d_size") + 1).alias("size"),
        "text_crc32",
        place(key, tree).alias("shard"),
        place(key, grown(tree)).alias("grown_shard"),
        F.pmod(F.crc32(F.concat(key, F.lit(":"), F.col("text_crc32").cast("string")).cast("binary")), F.lit(PARTS)).cast("int").alias("part"),
    )
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))  # at most shards x PARTS rows
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(offsets), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
    )
