"""Small text and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.operators.views import strip


def body_parts(text: Column) -> tuple[Column, Column, Column]:
    """White space before, body, white space after; together they give the text."""
    body = strip(text)
    return F.when(body == "", text).otherwise(F.regexp_extract(text, r"(?U)^(\s*)", 1)), body, F.when(body == "", "").otherwise(F.regexp_extract(text, r"(?U)(\s*)$", 1))


def with_edges_of(source: Column, output: Column) -> Column:
    """The stripped output between the source's own white space."""
    left, _, right = body_parts(source)
    return F.concat(left, strip(output), right)


def chunk_limit(context: Column) -> Column:
    own = F.greatest(F.lit(512), context)
    return F.when(own <= 2048, 700).when(own <= 4096, 1600).otherwise(2400)


def context_budget(context: Column) -> Column:
    own = F.greatest(F.lit(512), context)
    return F.when(own <= 2048, 480).when(own <= 4096, 1200).otherwise(2400)


def output_budget(source: Column, cap: Column) -> Column:
    return F.least(F.greatest(F.lit(32), cap), F.greatest(F.lit(128), F.length(source)))


def clipped(text: Column, limit: int = 720) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), r"(?U)\s+$", ""), F.lit("…")))


def worth_context(text: Column, kind: Column) -> Column:
    return (kind != "heading") & (F.regexp_count(text, F.lit(r"\p{L}{2,}")) >= 4)


def segment_height(text: Column) -> Column:
    return F.least(F.lit(14), F.greatest(F.lit(3), F.round(F.length(text) / 80))).cast("int")


def size_text(n: Column) -> Column:
    gb, mb = float(1024**3), float(1024**2)
    return F.when(n >= gb, F.concat(F.round(n / gb, 2).cast("decimal(18,2)").cast("string"), F.lit(" GB"))).otherwise(F.concat(F.round(n / mb).cast("long").cast("string"), F.lit(" MB")))


def percent(done: Column, total: Column) -> Column:
    return F.when(total <= 0, 0).otherwise(F.least(F.lit(100), F.floor(done / total * 100 + 0.5))).cast("int")


def language_of_id(n: Column) -> Column:
    """Code of a Windows language number: the low ten bits name the language. Fixed values."""
    primary, sub = n.bitwiseAND(0x3FF), F.shiftright(n.bitwiseAND(0xFFFF), 10)
    names = {0x09: "en", 0x19: "ru", 0x07: "de", 0x0C: "fr", 0x11: "ja", 0x12: "ko", 0x0A: "es", 0x10: "it"}
    out = F.when(primary == 4, F.when(sub.isin(2, 4), "zh").otherwise("zh-Hant"))
    for k, v in names.items():
        out = out.when(primary == k, v)
    return out.otherwise("")


def codes(text: Column) -> Column:
    """Codes of a list in free form, lower-cased, each once, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s,;]+"), lambda x: x != ""))


def locale_code(tag: Column) -> Column:
    """Catalogue code of a locale tag."""
    low, primary = F.lower(tag), F.lower(F.split_part(F.replace(tag, F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1)))
    hant = low.rlike("hant|-tw|-hk|-mo")
    return F.when(primary == "zh", F.when(hant, "zh-Hant").otherwise("zh")).when(primary.isin("nb", "nn"), "no").when(primary == "fil", "tl").otherwise(primary)


def failure_kind(message: Column) -> Column:
    """Class of an error message by the first rule that holds."""
    low = F.lower(message)
    return F.when(low.contains("memory"), "memory").when(low.contains("timeout") | low.contains("timed out"), "timeout").when(low.contains("disk") | low.contains("space"), "disk").otherwise("backend")


def eta(left: Column, rate: Column) -> Column:
    """Remaining time in words from what is left and the rate in a second."""
    seconds = F.round(left / rate)
    return F.when(rate <= 0, "").when(seconds < 60, "under a minute").when(seconds < 3600, F.concat(F.round(seconds / 60).cast("int").cast("string"), F.lit(" min"))).otherwise(F.concat(F.round(seconds / 3600).cast("int").cast("string"), F.lit(" h")))


def run_targets(target: Column, known: Column, existing: Column) -> Column:
    """The chosen target first, then the other known ones in their order."""
    return F.array_union(F.array(target), F.array_intersect(existing, known))


def plural(n: Column) -> Column:
    """Slavic plural class of a number: one, few or many."""
    return F.when((n % 10 == 1) & (n % 100 != 11), "one").when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), "few").otherwise("many")


def age(day: Column, today: Column) -> Column:
    n = F.datediff(today, day)
    return F.when(n <= 0, "today").when(n == 1, "yesterday").when(n < 7, "week").otherwise("older")


def safe_suffix(suffix: Column, allowed: list[str], default: str) -> Column:
    own = F.lower(F.trim(suffix))
    own = F.when((own != "") & ~own.startswith("."), F.concat(F.lit("."), own)).otherwise(own)
    return F.when(own.isin(*allowed), own).otherwise(default)


#: Ligatures and what they stand for.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
_CAPITAL, _LETTER = "A-ZА-ЯЁ", "A-Za-zА-Яа-яЁё"


def closed_up(text: Column) -> Column:
    """Four and more capitals with one space between them as a word; one that stands after two spaces isn't one of them."""
    spaced = rf"(?<![{_LETTER}])[{_CAPITAL}](?:[ \t][{_CAPITAL}]){{3,}}(?![{_LETTER}])"
    runs = F.regexp_extract_all(text, F.lit(f"({spaced})"), 1)
    return F.aggregate(F.array_distinct(runs), text, lambda t, run: F.replace(t, run, F.regexp_replace(run, r"[ \t]", "")))


def normalised(text: Column) -> Column:
    """Ligatures, hard spaces, spaces around apostrophes, before punctuation and after opening quotes, spaced-out capitals, runs of space."""
    t = text
    for sign, letters in LIGATURES.items():
        t = F.replace(t, F.lit(sign), F.lit(letters))
    t = F.replace(t, F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(t, r"(?iU)(?<=\w)\s+['’]\s*(?=(?:ll|ve|re|[dmst])\b)", "'")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+([,.;:!?])", "$1"), r"(?U)([«“\"])\s+", "$1")
    return F.trim(F.regexp_replace(closed_up(t), r"(?U)\s+", " "))


def joined_lines(lines: Column) -> Column:
    """A paragraph of its lines; a hyphen at a line's end goes if the next line begins in lower case."""
    clean = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(closed_up(x), r"(?U)\s+", " "))), lambda x: x != "")

    def step(done: Column, line: Column) -> Column:
        broken = F.endswith(done, F.lit("-")) & line.rlike(r"^\p{Ll}")
        return F.when(done == "", line).when(broken, F.concat(F.substring(done, F.lit(1), F.length(done) - 1), line)).otherwise(F.concat(done, F.lit(" "), line))

    return normalised(F.aggregate(clean, F.lit(""), step))
