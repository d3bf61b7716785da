"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file; FOLIOSPARK_TOKENIZERS overrides the installed folder."""
    folder = os.environ.get("FOLIOSPARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a plan in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Tables:
    """Intermediate tables of one job in the shared folder. A table's plan is a scan, so joins of two tables
    can be split where a key is hot. What a lazy result still reads has to stay; the rest is dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.held: dict[int, tuple[DataFrame, str]] = {}
        self.made = 0

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        """``df`` as a table, in folders by the columns ``by``, which must be its last."""
        path, self.made = f"{self.folder}/{self.made}", self.made + 1
        df.write.partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and id(t) in self.held:
                delete(self.spark, self.held.pop(id(t))[1])


def give_back() -> None:
    """Gives the process's free memory back to the system."""
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of a task's batches, after which the worker gives free memory back: workers are kept for other tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def text_parts(batches: Iterator[pd.DataFrame], col: str = "t", together: int = 2 << 20) -> Iterator[pd.DataFrame]:
    """Parts of the batches with a few megabytes of text, or one longer text."""
    for b in batches:
        if not len(b):
            continue
        size = np.cumsum([len(t) if isinstance(t, str) else 0 for t in b[col]]) // together
        edges = np.flatnonzero(np.concatenate(([True], size[1:] != size[:-1], [True])))
        for x, y in pairwise(edges.tolist()):
            yield b.iloc[x:y]


def whole_runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames that hold all neighbouring rows of their keys, from batches sorted by key; at most a batch longer than the longest run."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        keys = b[key].to_numpy()
        other = np.flatnonzero(keys != keys[-1])
        start = int(other[-1]) + 1 if len(other) else 0
        if held and (start or held[-1][key].iloc[-1] != keys[0]):
            if start and held[-1][key].iloc[-1] == keys[0]:
                held.append(b.iloc[:start])
                b, start = b.iloc[start:], 0
            yield pd.concat(held, ignore_index=True)
            held = []
        if start:
            yield b.iloc[:start].reset_index(drop=True)
        held.append(b.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)
