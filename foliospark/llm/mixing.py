"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source with share s of all tokens gets weight s**a / sum(s**a). The exponent a is bisected in [0, 1]:
the flattest mixture whose sources are repeated at most ``max_repeats`` times, or the one whose weights
have ``entropy`` nats. Without a budget, the budget is the least that takes every source once in full,
so nothing is dropped. A source's tokens come as whole passes over a block permutation of its documents
(blocks in hash order, hash order within a block) and one last pass that stops where its budget ends.

DataFrame functions only. A source is split into up to 4096 blocks, so a hot one is never one group.
A null source is a source of its own; null texts have no words; a document counts one token more than
its words; very long texts are counted like any other. Blocks and order follow a hash of id and text, so null and
repeated ids are spread too. Repeated rows count each; ties in the permutation are equal rows. Empty tables give empty results. Extra
columns stay, whatever they are called; a column of the result whose name the documents have gets an underscore in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a word is a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
STEPS = 50


def tokens(text: str = "text") -> Column:
    return (F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)) + 1).cast("long")


def _exponent(totals: str, entropy: float | None, max_repeats: float, budget: float | None) -> str:
    """SQL of the bisected exponent over ``totals``, an array of tokens by source."""
    top = f"array_max({totals})"
    power = lambda x: f"pow({x} / {top}, mid)"
    total = f"aggregate({totals}, 0d, (z, t) -> z + {power('t')})"
    if entropy is not None:
        spread = f"aggregate({totals}, 0d, (h, t) -> h - ({power('t')} / {total}) * ln({power('t')} / {total}))"
        flatter = f"{spread} <= {entropy!r}d"  # too concentrated: a smaller exponent will do
    else:
        most = f"array_max(transform({totals}, t -> {power('t')} / t))"
        least = f"array_min(transform({totals}, t -> {power('t')} / t))"
        flatter = f"{most} / {least} <= {max_repeats!r}d" if budget is None else f"{most} / {total} * {budget!r}d <= {max_repeats!r}d"
    step = f"transform(array((x.lo + x.hi) / 2), mid -> if({flatter}, named_struct('lo', x.lo, 'hi', mid), named_struct('lo', mid, 'hi', x.hi)))[0]"
    return f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0d, 'hi', 1d), (x, i) -> {step}, x -> x.hi)"


def plan(sizes: DataFrame, entropy: float | None = None, max_repeats: float = 2.0, budget: float | None = None) -> DataFrame:
    """key, total, weight, quota, passes, rest by source, from key and total; its size is the number of sources."""
    one = sizes.agg(F.sort_array(F.collect_list(F.struct("key", F.col("total").cast("double").alias("t")))).alias("all"))
    one = one.withColumn("totals", F.transform("all", lambda x: x["t"])).withColumn("a", F.expr(_exponent("totals", entropy, max_repeats, budget)))
    one = one.withColumn("top", F.array_max("totals")).withColumn("norm", F.expr("aggregate(totals, 0d, (z, t) -> z + pow(t / top, a))"))
    one = one.withColumn("budget", F.lit(float(budget)) if budget is not None else F.expr("array_max(transform(totals, t -> t / (pow(t / top, a) / norm)))"))
    each = one.select(F.explode("all").alias("s"), "a", "top", "norm", "budget").select(F.col("s.key").alias("key"), F.col("s.t").cast("long").alias("total"), (F.pow(F.col("s.t") / F.col("top"), F.col("a")) / F.col("norm")).alias("weight"), F.col("budget"))
    quota = F.round(F.col("weight") * F.col("budget")).cast("long")
    return each.select("key", "total", "weight", quota.alias("quota"), F.expr("cast(round(weight * budget) as bigint) div total").alias("passes"), F.expr("cast(round(weight * budget) as bigint) % total").alias("rest"))


def _placed(docs: DataFrame, entropy: float | None, max_repeats: float, budget: float | None, seed: str, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """m_doc (the whole row), m_tokens, m_weight, m_pass and m_start, a row for each time that a document is taken."""
    key = F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null"))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("m_doc")  # whatever the columns are called
    rows = docs.select(whole, key.alias("m_key"), tokens(text_col).alias("m_tokens"), F.md5(named.cast("binary")).alias("m_order")).withColumn("m_block", F.substring("m_order", 1, 3))
    blocks = rows.groupBy("m_key", "m_block").agg(F.sum("m_tokens").alias("m_block_tokens"))
    sources = plan(blocks.groupBy(F.col("m_key").alias("key")).agg(F.sum("m_block_tokens").alias("total")), entropy, max_repeats, budget)
    before = F.coalesce(F.sum("m_block_tokens").over(Window.partitionBy("m_key").orderBy("m_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("m_key", "m_block", before.alias("m_before")).join(sources.withColumnRenamed("key", "m_key"), "m_key")  # up to 4096 rows a source
    inside = Window.partitionBy("m_key", "m_block").orderBy("m_order", "m_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(offsets, ["m_key", "m_block"]).withColumn("m_end", F.col("m_before") + F.sum("m_tokens").over(inside))
    times = F.col("passes") + (F.col("m_end") <= F.col("rest")).cast("long")
    taken = placed.withColumn("m_times", times).where("m_times > 0").withColumn("m_pass", F.explode(F.sequence(F.lit(0), (F.col("m_times") - 1).cast("int"))))
    return taken.select("m_doc", "m_tokens", F.col("weight").alias("m_weight"), "m_pass", (F.col("m_end") - F.col("m_tokens")).alias("m_start"))


def mix(docs: DataFrame, entropy: float | None = None, max_repeats: float = 2.0, budget: float | None = None, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with m_tokens, m_weight, m_pass (from 0) and m_start (tokens of the pass before the row), a row for each time that a document is taken."""

    def free(name: str) -> str:
        return name if name not in docs.columns else free(f"_{name}")

    placed = _placed(docs, entropy, max_repeats, budget, seed, id_col, source_col, text_col)
    return placed.select("m_doc.*", *[F.col(c).alias(free(c)) for c in ("m_tokens", "m_weight", "m_pass", "m_start")])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with their columns alone, each as often as it is taken."""
    given = dict(entropy=None, max_repeats=2.0, budget=None, seed="mix", id_col="doc_id", source_col="source", text_col="text")
    return _placed(docs, **(given | options)).select("m_doc.*")
