"""Joins by nearness on a line or in a plane: rows meet in bins, not all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(c: Column, width: float) -> Column:
    return F.floor(c / width).cast("long")


def _bins(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(_bin(low, width), _bin(F.greatest(low, high), width)))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], axes: list[tuple[str, str, str, str]], cell: float) -> DataFrame:
    """left and right with equal keys that overlap along every axis (left's low and high column, right's low and high column).

    Either side is dealt into the cells that it touches, and a pair is kept in the first cell that both touch, so it comes once. Cells about as large
    as the boxes make few copies of a box and few strangers in a cell.
    """
    names = [f"cell_{i}" for i in range(len(axes))]
    for name, (low, high, r_low, r_high) in zip(names, axes, strict=True):
        left = left.withColumn(name, _bins(F.col(low), F.col(high), cell))
        right = right.withColumn(name, _bins(F.col(r_low), F.col(r_high), cell))
    met = left.join(right, [*keys, *names])
    for name, (low, high, r_low, r_high) in zip(names, axes, strict=True):
        first = F.col(name) == _bin(F.greatest(F.col(low), F.col(r_low)), cell)
        met = met.where(first & (F.col(low) < F.col(r_high)) & (F.col(r_low) < F.col(high)))
    return met.drop(*names)


def within(left: DataFrame, right: DataFrame, keys: list[str], at: str, r_at: str, distance: float) -> DataFrame:
    """left and right with equal keys that stand within ``distance`` on a line: bins of that width, each left row in its own and both beside it."""
    own = _bin(F.col(at), distance)
    near = left.withColumn("cell_0", F.explode(F.array(own - 1, own, own + 1)))
    met = near.join(right.withColumn("cell_0", _bin(F.col(r_at), distance)), [*keys, "cell_0"]).drop("cell_0")
    return met.where(F.abs(F.col(at) - F.col(r_at)) <= distance)
