"""Which language a text is in, by profiles of character trigrams counted from texts whose language is known."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Languages of a profile table, at most: each is a column.
LANGUAGES = 200


def trigrams(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct trigrams of each text without case, as numbers, and how often each occurs; white space counts as one blank."""
    out = []
    for t in texts:
        c = np.frombuffer(" ".join((t or "").lower().split()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        out.append(np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True) if len(c) > 2 else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
    return out


def gram_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, gram, n of each text."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.iloc[at : at + 200]
                found = trigrams(part[text].tolist())
                yield pd.DataFrame({key: part[key].repeat([len(g) for g, _ in found]).to_numpy(), "gram": np.concatenate([g for g, _ in found]), "n": np.concatenate([n for _, n in found])})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, gram long, n long")


def profiles(known: DataFrame, lang: str, text: str) -> DataFrame:
    """gram and one column of log probabilities for each language (columns of ``known`` by name), each gram counted once more than it occurs."""
    counted = gram_counts(known.where(F.col(lang).isNotNull()), lang, text).groupBy(lang, "gram").agg(F.sum("n").alias("n"))
    names = sorted(r[0] for r in known.select(lang).distinct().limit(LANGUAGES + 1).collect() if r[0] is not None)
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    table = counted.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col(lang) == x, F.col("n"))), F.lit(0)).alias(x) for x in names])
    totals = table.agg(F.count("*").alias("grams"), *[F.sum(x).alias(x) for x in names]).first()
    return table.select("gram", *[F.log((F.col(x) + 1) / F.lit(float((totals[x] or 0) + totals["grams"]))).alias(x) for x in names])


def detected(rows: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """key, language, margin of each text: the language under whose profile it is likeliest, and by how much a character on
    average; null for texts that hold no trigram of any profile."""
    names = [c for c in known.columns if c != "gram"]
    sums = gram_counts(rows, key, text).join(known, "gram").groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(x)).alias(x) for x in names])
    ranked = F.sort_array(F.array(*[F.struct(F.col(x).alias("s"), F.lit(x).alias("language")) for x in names]), asc=False)
    best = sums.withColumn("r", ranked).select(key, F.col("r")[0]["language"].alias("language"), ((F.col("r")[0]["s"] - F.try_element_at("r", F.lit(2))["s"]) / F.col("n")).alias("margin"))
    return rows.select(key).join(best, key, "left")
