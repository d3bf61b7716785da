"""Writing systems: counts by script, what a language is written in, and checks of a translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.views import let

#: The characters counted for each script.
SCRIPTS = {
    "kana": r"[\x{3040}-\x{30ff}]",
    "hangul": r"[\x{ac00}-\x{d7af}]",
    "han": r"[\x{4e00}-\x{9fff}]",
    "cyrillic": "[А-Яа-яЁёІіЇїЄєҐґ]",
    "arabic": r"[\x{0600}-\x{06ff}]",
    "hebrew": r"[\x{0590}-\x{05ff}]",
    "greek": r"[\x{0370}-\x{03ff}]",
    "devanagari": r"[\x{0900}-\x{097f}]",
    "thai": r"[\x{0e00}-\x{0e7f}]",
    "latin": "[A-Za-zÀ-ÖØ-öø-ÿ]",
}
#: Languages that aren't written in Latin letters, by script.
WRITTEN = {
    "cyrillic": ("ru", "uk", "be", "bg", "kk", "mk", "mn", "sr"),
    "kana": ("ja",),
    "han": ("ja", "zh", "zh-Hant", "yue", "ko"),
    "hangul": ("ko",),
    "arabic": ("ar", "fa", "ur", "ug"),
    "hebrew": ("he",),
    "greek": ("el",),
    "devanagari": ("hi", "mr", "ne"),
    "thai": ("th",),
}
HAN_ONLY = ("zh", "zh-Hant", "yue")


def count(text: Column, script: str) -> Column:
    return F.regexp_count(text, F.lit(SCRIPTS[script])).cast("int")


def counts(text: Column) -> Column:
    """Map from script to its characters, for those that occur."""
    pairs = F.array(*[F.struct(F.lit(s).alias("key"), count(text, s).alias("value")) for s in SCRIPTS])
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"] > 0))


def target_scripts(code: Column) -> Column:
    """Scripts of a language: empty for none or auto, Latin for those not listed."""
    named = F.array_compact(F.array(*[F.when(code.isin(*langs), F.lit(s)) for s, langs in WRITTEN.items()]))
    none = F.array().cast("array<string>")
    return F.when(code.isNull() | code.isin("", "auto"), none).when(F.size(named) > 0, named).otherwise(F.array(F.lit("latin")))


def allowed_scripts(source: Column, code: Column) -> Column:
    return F.array_union(target_scripts(code), F.map_keys(counts(source)))


def _total(found: Column) -> Column:
    return F.aggregate(F.map_values(found), F.lit(0), lambda s, x: s + x)


def _measured(text: Column, wanted: Column) -> Column:
    """struct(found, wanted, total) of a text, its counts taken once."""
    return let(F.struct(counts(text).alias("found"), wanted.alias("wanted")), lambda x: F.struct(x["found"].alias("found"), x["wanted"].alias("wanted"), _total(x["found"]).alias("total")))


def fits(text: Column, code: Column) -> Column:
    """Most letters are of the language's scripts; too few letters always fit."""

    def judged(x: Column) -> Column:
        found, wanted, total = x["found"], x["wanted"], x["total"]
        hits = F.aggregate(F.map_entries(found), F.lit(0), lambda s, e: s + F.when(F.array_contains(wanted, e["key"]), e["value"]).otherwise(0))
        of = lambda name: F.coalesce(F.try_element_at(found, F.lit(name)), F.lit(0))
        kana = code.isin(*HAN_ONLY) & (of("kana") > of("han"))
        return F.when(F.size(wanted) == 0, True).when(total < 2, True).when(kana, False).otherwise(hits * 2 >= total)

    return let(_measured(text, target_scripts(code)), judged)


def intrusion(text: Column, source: Column, code: Column) -> Column:
    """A script that neither the source nor the language has: any Han, kana or hangul, others if they are half or more."""

    def judged(x: Column) -> Column:
        foreign = F.exists(F.map_entries(x["found"]), lambda e: ~F.array_contains(x["wanted"], e["key"]) & (e["key"].isin("han", "kana", "hangul") | (e["value"] * 2 >= x["total"])))
        return F.when(F.size(x["wanted"]) == 0, False).when(x["total"] < 2, False).otherwise(foreign)

    return let(_measured(text, allowed_scripts(source, code)), judged)


def _without(script: str):
    """What takes a script's characters away where it is among the bad ones."""
    return lambda text: F.when(F.array_contains("s_bad", script), F.regexp_replace(text, SCRIPTS[script], "")).otherwise(text)


def with_foreign_removed(rows: DataFrame, text: str, source: str, code: str, out: str) -> DataFrame:
    """rows with ``out``: the text without a foreign minority; one that is mostly foreign stays. Both texts are counted once, and
    the scripts' patterns are fixed, each used where its script has to go."""
    t = F.col(text)
    rows = rows.withColumns({"s_found": counts(t), "s_target": target_scripts(F.col(code)), "s_source": F.map_keys(counts(F.col(source)))})
    rows = rows.withColumns({"s_allowed": F.array_union("s_target", "s_source"), "s_total": _total(F.col("s_found"))})
    bad = F.map_filter("s_found", lambda k, _: ~F.array_contains("s_allowed", k))
    rows = rows.withColumns({"s_bad": F.map_keys(bad), "s_foreign": _total(bad), "s_strange": F.exists(F.map_entries(bad), lambda e: e["key"].isin("han", "kana", "hangul") | (e["value"] * 2 >= F.col("s_total")))})
    small = (F.size("s_target") > 0) & (F.col("s_total") >= 2) & F.col("s_strange") & (F.col("s_foreign") * 2 < F.col("s_total"))
    left = t
    for script in SCRIPTS:
        left = let(left, _without(script))
    rows = rows.withColumn("s_left", F.when(small, left))
    tidy = F.trim(F.regexp_replace(F.regexp_replace("s_left", r"[ \t]{2,}", " "), r" +(?=[,.;:!?…])", ""))
    return rows.withColumn(out, F.when(small, tidy).otherwise(t)).drop("s_found", "s_target", "s_source", "s_allowed", "s_total", "s_bad", "s_foreign", "s_strange", "s_left")
