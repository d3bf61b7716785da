"""Folds over ordered rows in linear time: a key's rows stream through its fold, and only the state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Gives (what the row adds, the state after it) from the state before it, None at a key's first row, and the row's values.
Step = Callable[[tuple | None, tuple], tuple[tuple, tuple]]


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], values: list[str], step: Step, added: str) -> DataFrame:
    """The keys, the order and what ``step`` adds (DDL ``added``) for each row, in order within its key.

    Rows are dealt by key and sorted by Spark, which spills; a task goes through its batches once and carries the state of
    the last key from batch to batch, so neither a key's rows nor their results are ever one array.
    """
    names = [*keys, *order, *(x.split()[0] for x in added.split(","))]
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in (*keys, *order)), added])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            out = []
            columns = [b[c].tolist() for c in (*keys, *order, *values)]
            for row in zip(*columns, strict=True):
                key = row[: len(keys)]
                new, state = step(state if key == last else None, row[len(keys) + len(order) :])
                last = key
                out.append((*row[: len(keys) + len(order)], *new))
            yield pd.DataFrame(out, columns=names)

    return rows.select(*keys, *order, *values).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
