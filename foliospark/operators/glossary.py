"""Glossary checks, protected terms and translation memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.terms import LARGEST, automaton, letter, word


def term_pattern(term: Column) -> Column:
    """A pattern that finds the term as whole words, whatever its case."""
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), term, F.lit(r"\E(?![\p{L}\p{N}])"))


def _words(text: Column) -> Column:
    """Distinct runs of letters and digits whatever their case; a term can only stand where its first one does."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.upper(text)), F.lit(r"[\p{L}\p{N}]+"), 0))


def with_terms(rows: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """rows joined to the terms (column term) that stand in their text as whole words. A list of up to LARGEST terms is
    an automaton that reads each text once; a larger one is joined on the terms' first words."""
    listed = terms.select("term").distinct().limit(LARGEST + 1).collect()  # of bounded size
    if len(listed) > LARGEST:
        return _joined_terms(rows, text, terms)
    names = tuple(sorted(r["term"] for r in listed if r["term"]))

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = automaton(names, letter)
        for texts in batches:
            yield texts.map(lambda t: [names[n] for n in known.numbers(t or "")])

    return rows.withColumn("term", F.explode(found(text))).join(terms, "term").select(*rows.columns, *terms.columns)


def _joined_terms(rows: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """The same by an equi-join on the term's first word, then the pattern; terms without letters or digits are looked for by pattern alone."""
    ready = terms.withColumn("g_pattern", term_pattern(F.col("term"))).withColumn("g_first", F.try_element_at(_words(F.col("term")), F.lit(1)))
    plain = ready.where("g_first IS NULL")
    found = rows.withColumn("g_word", F.explode(_words(F.col(text)))).join(ready, F.col("g_word") == F.col("g_first")).drop("g_word")
    signs = rows.join(plain, F.expr(f"rlike(`{text}`, g_pattern)"))
    return found.where(F.expr(f"rlike(`{text}`, g_pattern)")).unionByName(signs).drop("g_pattern", "g_first")


def missing_terms(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """Pairs (source, translation) with a term in the source whose translation isn't in the target. The glossary is a
    person's list; it is broadcast only if Spark finds it small enough."""
    terms = glossary.where("trim(source) <> '' AND trim(target) <> ''").select(F.col("id").alias("term_id"), F.trim("source").alias("term"), F.trim("target").alias("wanted"))
    found = with_terms(pairs, "source", terms).withColumn("wanted_pattern", term_pattern(F.col("wanted")))
    return found.where(~F.expr("rlike(translation, wanted_pattern)"))


def add_terms(glossary: DataFrame, new: DataFrame) -> DataFrame:
    """The new terms that are filled and not there yet."""
    key = ["source_lang", "target_lang", "source", "target"]
    clean = new.withColumn("source", F.trim("source")).withColumn("target", F.trim("target")).where("source <> '' AND target <> ''")
    return clean.dropDuplicates(key).join(glossary, key, "left_anti")


#: What a mark begins and ends with; between them its number.
MARK = ("TERMQ", "QX")


def protect(text: str, terms: list[tuple[str, str]]) -> tuple[str, dict[str, str]]:
    """Terms replaced by numbered marks, longest term first; and what each mark stands for."""
    name = lambda k: f"{MARK[0]}{k:04d}{MARK[1]}"
    out, order = automaton(tuple(source for source, _ in terms), word).replaced(text, name)
    return out, {name(k): terms[n][1] for k, n in enumerate(order)}


def highlighted(text: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """The text with marks around the terms, wherever they stand."""
    names = tuple(terms)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else automaton(names).marked(t, before, after))

    return run(text)


def restore(text: str, marks: dict[str, str]) -> str | None:
    """The text with each mark replaced, or nothing if a mark isn't there exactly once."""
    for name, target in marks.items():
        if text.count(name) != 1:
            return None
        text = text.replace(name, target)
    return text


def restored(text: Column, marks: Column) -> Column:
    """The text with each mark of a map replaced, or null if a mark isn't there exactly once; inside Spark, mark by mark."""
    once = lambda m: F.length(text) - F.length(F.replace(text, m, F.lit(""))) == F.length(m)
    return F.when(F.forall(F.map_keys(marks), once), F.aggregate(F.map_entries(marks), text, lambda t, m: F.replace(t, m["key"], m["value"])))


def changed_terms(glossary: DataFrame, new: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The glossary (id, source, target) with other targets (id, target) and without terms (id); and the ids that it hasn't, which are errors."""
    told = new.select("id", F.col("target").alias("new_target"))
    after = glossary.join(gone.select("id").distinct(), "id", "left_anti").join(told, "id", "left").select("id", "source", F.coalesce("new_target", "target").alias("target"))
    return after, new.select("id").union(gone.select("id")).distinct().join(glossary, "id", "left_anti").select("id", F.lit("no such term").alias("error"))


def in_order(glossary: DataFrame) -> DataFrame:
    """glossary with ``place``: longest source first, then by source and id. Places are counted within each length, after the longer ones."""
    sized = glossary.withColumn("size", F.length("source"))
    lengths = sized.groupBy("size").agg(F.count("*").alias("many"))  # a row for each length
    before = lengths.withColumn("before", F.coalesce(F.sum("many").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("many")
    own = F.row_number().over(Window.partitionBy("size").orderBy("source", "id"))
    return sized.withColumn("own", own).join(before, "size").withColumn("place", F.col("before") + F.col("own")).drop("size", "own", "before")


def protected(rows: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """rows with ``protected``, ``marks`` (map) and ``restored`` of their text."""

    @F.pandas_udf("protected string, marks map<string,string>, restored string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            done = [protect(t or "", terms) for t in texts]
            yield pd.DataFrame({"protected": [t for t, _ in done], "marks": [m for _, m in done], "restored": [restore(t, m) for t, m in done]})

    return rows.withColumn("p", run("text")).select(*rows.columns, "p.*")


def tokens(text: Column) -> Column:
    """Distinct runs of four letters or more, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}{4,})"), 1), lambda x: F.lower(x)))


#: Confirmed pairs that a memory holds: the newest; fixed value.
MEMORY = 200


def overlaps(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each query (query_id, text) and pair of the memory (pair_id, source; smaller ids are newer) that share tokens, how
    many and the longest. The memory is the MEMORY newest pairs, so each query meets a bounded number; equal texts don't count.
    Tokens travel with ids and the texts' digests, not with the texts."""
    newest = pairs.orderBy("pair_id").limit(MEMORY)
    digest = lambda c: F.md5(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))).cast("binary"))
    q = queries.select("query_id", digest("text").alias("q"), F.explode(tokens(F.col("text"))).alias("token"))
    p = newest.select("pair_id", digest("source").alias("p"), F.explode(tokens(F.col("source"))).alias("token"))
    return q.join(p, "token").where("q <> p").groupBy("query_id", "pair_id").agg(F.count("*").alias("overlap"), F.max_by("token", F.struct(F.length("token"), "token")).alias("anchor"))


def memory_examples(queries: DataFrame, pairs: DataFrame, most: int = 3) -> DataFrame:
    """For each query the pairs of the memory that share most tokens with it."""
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "pair_id")
    return overlaps(queries, pairs).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def excerpt(text: Column, needle: Column, limit: int = 180) -> Column:
    """White space squeezed, and a window that begins a third before the needle if the text is long."""
    compact = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    at = F.when(needle == "", 0).otherwise(F.instr(F.lower(compact), F.lower(needle)))
    start = F.when(at > 0, F.greatest(at - limit // 3, F.lit(1))).otherwise(F.lit(1))
    return F.when(F.length(compact) <= limit, compact).otherwise(F.substring(compact, start, F.lit(limit)))
