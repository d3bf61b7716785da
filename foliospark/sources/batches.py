"""Batches cut to a size in bytes before Python makes objects of their rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of rows that are Python objects at once, if of more than one row.
SLICE = 2 << 20

Run = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in pieces of about ``size`` bytes; a batch counts rows, which may be whole files."""
    for b in batches:
        if b.num_rows and b.nbytes > size:
            half = b.num_rows // 2
            yield from slices(iter((b.slice(0, half), b.slice(half))), size) if half else (b,)
        else:
            yield b


def portions(rows: Iterable[tuple], size_of: Callable[[tuple], int], size: int = SLICE) -> Iterator[list[tuple]]:
    """The same rows in order, in lists that end once they hold ``size`` bytes: a small archive may hold much text."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size_of(row)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def map_files(rows: DataFrame, run: Run, schema: str) -> DataFrame:
    """``rows.mapInPandas(run, schema)`` for rows that hold whole files or documents: in slices, so that memory follows these and not the rows of a batch."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.to_pandas() for b in slices(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return rows.mapInArrow(go, schema)
