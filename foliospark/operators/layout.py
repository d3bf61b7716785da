"""Paragraphs from lines with boxes: recognised lines and glyph lines of a page."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.folds import fold_sorted
from foliospark.operators.ranges import overlapping, within
from foliospark.operators.views import strip

#: Side of the cells in which boxes and lines of a page meet, about the length of a short line.
CELL = 64.0


def group_ocr_lines(lines: DataFrame) -> DataFrame:
    """lines with ``paragraph``: a new one far below, far above or beside the last line; lines of digits stand alone."""
    own = Window.partitionBy("page").orderBy("y0", "x0", "idx")
    rows = lines.where(strip("text") != "")
    last = lambda c: F.lag(c).over(own)
    gap, tall = F.col("y0") - last("y1"), F.greatest(last("y1") - last("y0"), F.col("y1") - F.col("y0"), F.lit(1))
    digits = lambda c: F.regexp_replace(c, r"\s+", "").rlike(r"^\d+$")
    fresh = last("idx").isNull() | digits(F.col("text")) | digits(last("text")) | (gap > tall * 0.85) | (gap < -(tall * 0.2)) | ((F.col("x0") >= last("x1") - 4) & (gap < tall * 0.35))
    return rows.withColumn("fresh", fresh.cast("int")).withColumn("paragraph", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)


def paragraph_text(lines: Column) -> Column:
    """Lines joined by spaces; a hyphen before a lower-case letter goes."""
    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(lines, lambda x: strip(x)), "\n"), r"-\n(?=\p{Ll})", ""), "\n", " ")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Text and box of each paragraph."""
    rows = group_ocr_lines(lines).groupBy("page", "paragraph")
    return rows.agg(paragraph_text(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "idx", "text"))), lambda x: x["text"])).alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def outside_boxes(lines: DataFrame, boxes: DataFrame, pad: int = 6, share: float = 0.35) -> DataFrame:
    """Lines of which no box of their page covers more than a share. Lines meet the boxes in the same cells of their page only."""
    b = boxes.select("page", *[(F.col(c) + d).alias(f"b_{c}") for c, d in (("x0", -pad), ("y0", -pad), ("x1", pad), ("y1", pad))])
    wide = F.least("x1", "b_x1") - F.greatest("x0", "b_x0")
    high = F.least("y1", "b_y1") - F.greatest("y0", "b_y0")
    area = F.greatest(F.lit(1), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    met = overlapping(lines, b, ["page"], [("x0", "x1", "b_x0", "b_x1"), ("y0", "y1", "b_y0", "b_y1")], CELL)
    covered = met.where(wide * high / area > share).select("page", "idx").distinct()
    return lines.join(covered, ["page", "idx"], "left_anti")


def column_of() -> Column:
    return F.when((F.col("x0") + F.col("x1")) / 2 < F.col("page_width") / 2, 0).otherwise(1)


def split_columns(lines: DataFrame) -> DataFrame:
    """lines with ``col`` and ``paragraph`` by gaps, indents and size classes against the line above."""
    rows = lines.withColumn("col", column_of())
    own = Window.partitionBy("page", "col")
    order = own.orderBy(F.desc("baseline"), "x0", "idx")
    last = lambda c: F.lag(c).over(order)
    rows = rows.withColumn("gap", last("baseline") - F.col("baseline")).withColumn("indent", F.col("x0") - last("x0")).withColumn("above_x0", last("x0")).withColumn("above_size", last("size"))
    body = F.min(F.when(F.col("size") >= 11.5, F.col("x0"))).over(own)
    left = F.coalesce(body, F.min("x0").over(own))
    usual = F.coalesce(F.median(F.when((F.col("gap") > 0) & (F.col("gap") < 30), F.col("gap"))).over(own), F.lit(16.0))
    rows = rows.withColumn("left", left).withColumn("usual", usual)
    fresh = (
        F.col("gap").isNull()
        | (F.col("gap") > F.col("usual") * 1.35)
        | F.col("indent").between(8.0, 26.0)
        | (F.col("indent") <= -8.0)
        | ((F.col("x0") > F.col("left") + 8) & (F.col("above_x0") > F.col("left") + 8))
        | ((F.col("above_size") < 11.4) != (F.col("size") < 11.4))
    )
    return rows.withColumn("fresh", fresh.cast("int")).withColumn("paragraph", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)


def merged_fragments(lines: DataFrame) -> DataFrame:
    """Fragments of one row of a page joined: baselines within 1.4 (averaged as they join) and a gap of -1 to 16.
    The row so far is carried from one fragment to the next; its last state is the row."""

    def step(row: tuple | None, f: tuple) -> tuple[tuple, tuple]:
        text, x1, baseline = f[0], f[1], f[2]
        if row and abs(row[4] - baseline) < 1.4 and -1.0 <= f[3] - row[3] <= 16.0:
            row = (row[0], f"{row[1]} {text}".strip(" "), min(row[2], f[3]), max(row[3], x1), (row[4] + baseline) / 2)
        else:
            row = (row[0] + 1 if row else 0, text, f[3], x1, baseline)
        return row, row

    ready = lines.select("page", (-F.col("baseline")).alias("o"), F.col("x0").alias("start"), "idx", "text", "x1", "baseline", "x0")
    folded = fold_sorted(ready, ["page"], ["o", "start", "idx"], ["text", "x1", "baseline", "x0"], step, "line int, text string, x0 double, x1 double, baseline double")
    last = F.max_by(F.struct("text", "x0", "x1", "baseline"), F.struct("o", "start", "idx"))
    return folded.groupBy("page", "line").agg(last.alias("x")).select("page", "line", "x.*")


def header_partner(headers: DataFrame) -> DataFrame:
    """The nearest header on the right half of the page, within two points of each one on the left."""
    rows = headers.withColumn("col", column_of())
    left = rows.where("col = 0").select("page", "idx", "baseline")
    right = rows.where("col = 1").select("page", F.col("idx").alias("partner"), F.col("baseline").alias("b"))
    far = F.abs(F.col("baseline") - F.col("b"))
    near = within(left, right, ["page"], "baseline", "b", 2.0).withColumn("n", F.row_number().over(Window.partitionBy("page", "idx").orderBy(far, "partner")))
    return near.where("n = 1").select("page", "idx", "partner")


def column_edges(lines: DataFrame) -> DataFrame:
    """Whether a line starts at its column's left edge."""
    rows = lines.withColumn("col", column_of())
    return rows.withColumn("at_edge", F.col("x0") <= F.min("x0").over(Window.partitionBy("page", "col")) + 3.0)


#: Signs before a sentence's first letter, what ends a sentence, and what may stand after that.
BEFORE, ENDS, AFTER = "«“\"'’([ ", ".!?…", "'\"”’)]"


def stitched(rows: DataFrame) -> DataFrame:
    """rows (doc, ord, page, text, at_edge) with ``anchor``: a paragraph that goes on from an unfinished one, in lower
    case or at the edge of a new page, belongs to it. What is unfinished is carried from one to the next."""

    def step(last: tuple | None, p: tuple) -> tuple[tuple, tuple]:
        place, page, text, at_edge = p
        goes_on = False
        if last is not None and not last[2]:
            first = text.lstrip(BEFORE)[:1]
            goes_on = unicodedata.category(first) == "Ll" if first else False
            goes_on = goes_on or page != last[1] and at_edge
        anchor = last[0] if goes_on else place
        return (anchor,), (anchor, page, text.strip().rstrip(AFTER)[-1:] in tuple(ENDS))

    return fold_sorted(rows.withColumn("place", F.col("ord")), ["doc"], ["ord"], ["place", "page", "text", "at_edge"], step, "anchor int")


def spaced_glyphs(glyphs: DataFrame) -> DataFrame:
    """page and text of glyphs (page, n, glyph, x0, x1, size): a gap of more than 1.8 points and 0.22 of the size is a space."""
    own = Window.partitionBy("page").orderBy("n")
    size = F.coalesce(F.nullif(F.lag("size").over(own), F.lit(0.0)), F.nullif(F.col("size"), F.lit(0.0)), F.lit(10.0))
    gap = (F.col("x0") - F.lag("x1").over(own) > F.greatest(F.lit(1.8), size * 0.22)) & (F.trim("glyph") != "") & ~F.coalesce(F.endswith(F.lag("glyph").over(own), F.lit(" ")), F.lit(False))
    rows = glyphs.select("page", "n", F.concat(F.when(gap, " ").otherwise(""), "glyph").alias("piece"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy("page").agg(F.trim(F.replace(line, F.lit("\n"), F.lit(" "))).alias("text"))
