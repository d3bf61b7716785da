"""Queries of layout, planning, state changes and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators import glossary as G
from foliospark.operators import layout as L
from foliospark.operators import planning as M
from foliospark.operators import segments as P
from foliospark.operators import state as D
from foliospark.operators import views as V
from foliospark.plans.files import RTF, RTF_BODY
from foliospark.plans.registry import query
from foliospark.shared import shared_dir
from foliospark.sources import formats as S
from foliospark.sources import importers as I
from foliospark.sources import sinks as K
from foliospark.sources import tables as T
from foliospark.sources.tables import with_tables

# Layout

_OCR = with_tables("ocr", more="g AS (SELECT *, lag(idx) OVER w AS l_idx, lag(text) OVER w AS l_text, lag(x1) OVER w AS l_x1, lag(y0) OVER w AS l_y0, lag(y1) OVER w AS l_y1 FROM ocr WHERE trim(text) <> '' WINDOW w AS (PARTITION BY page ORDER BY y0, x0, idx)), f AS (SELECT *, (l_idx IS NULL OR regexp_full_match(text, '\\d+') OR regexp_full_match(l_text, '\\d+') OR y0 - l_y1 > greatest(l_y1 - l_y0, y1 - y0, 1) * 0.85 OR y0 - l_y1 < -(greatest(l_y1 - l_y0, y1 - y0, 1) * 0.2) OR (x0 >= l_x1 - 4 AND y0 - l_y1 < greatest(l_y1 - l_y0, y1 - y0, 1) * 0.35)) AS fresh FROM g), p AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY page ORDER BY y0, x0, idx) - 1 AS paragraph FROM f)")


@query("win_11_ocr_groups", _OCR + "SELECT page, idx, paragraph::BIGINT AS paragraph FROM p")
def win_11(s, d):
    return L.group_ocr_lines(T.ocr_lines(s, d)).select("page", "idx", "paragraph")


@query("sc_63_paragraph_text", _OCR + "SELECT page, paragraph::BIGINT AS paragraph, replace(regexp_replace(string_agg(trim(text), chr(10) ORDER BY y0, x0, idx), '-\\n([a-z])', '\\1', 'g'), chr(10), ' ') AS text FROM p GROUP BY ALL")
def sc_63(s, d):
    return L.paragraphs(T.ocr_lines(s, d)).select("page", "paragraph", "text")


@query("ag_20_bounding_boxes", _OCR + "SELECT page, paragraph::BIGINT AS paragraph, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM p GROUP BY ALL")
def ag_20(s, d):
    return L.paragraphs(T.ocr_lines(s, d)).drop("text")


@query("jn_19_outside_boxes", with_tables("ocr") + "SELECT page, idx FROM ocr o WHERE NOT EXISTS (SELECT 1 FROM ocr b WHERE b.idx % 7 = 0 AND b.page = o.page AND least(o.x1, b.x1 - 30 + 6) - greatest(o.x0, b.x0 - 30 - 6) > 0 AND least(o.y1, b.y1 + 6) - greatest(o.y0, b.y0 - 6) > 0 AND (least(o.x1, b.x1 - 30 + 6) - greatest(o.x0, b.x0 - 30 - 6)) * (least(o.y1, b.y1 + 6) - greatest(o.y0, b.y0 - 6)) / greatest(1, (o.x1 - o.x0) * (o.y1 - o.y0)) > 0.35)")
def jn_19(s, d):
    lines = T.ocr_lines(s, d)
    boxes = lines.where("idx % 7 = 0").withColumn("x0", F.col("x0") - 30).withColumn("x1", F.col("x1") - 30)
    return L.outside_boxes(lines, boxes).select("page", "idx")


_COL = "CASE WHEN (x0 + x1) / 2 < page_width / 2 THEN 0 ELSE 1 END"
_GLY = with_tables("glyphs", more=f"c AS (SELECT *, {_COL} AS col FROM glyphs), g AS (SELECT *, lag(baseline) OVER w - baseline AS gap, x0 - lag(x0) OVER w AS indent, lag(x0) OVER w AS above_x0, lag(size) OVER w AS above_size FROM c WINDOW w AS (PARTITION BY page, col ORDER BY baseline DESC, x0, idx)), m AS (SELECT page, col, coalesce(min(x0) FILTER (WHERE size >= 11.5), min(x0)) AS l, coalesce(median(gap) FILTER (WHERE gap > 0 AND gap < 30), 16.0)::DOUBLE AS usual FROM g GROUP BY ALL), f AS (SELECT g.*, usual, l, gap IS NULL OR gap > usual * 1.35 OR indent BETWEEN 8 AND 26 OR indent <= -8 OR (x0 > l + 8 AND above_x0 > l + 8) OR (above_size < 11.4) <> (size < 11.4) AS fresh FROM g JOIN m USING (page, col)), p AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY page, col ORDER BY baseline DESC, x0, idx) - 1 AS paragraph FROM f)")


@query("win_13_split_columns", _GLY + "SELECT page, col, idx, paragraph::BIGINT AS paragraph FROM p")
def win_13(s, d):
    return L.split_columns(T.glyph_lines(s, d)).select("page", "col", "idx", "paragraph")


@query("ag_17_line_fonts", with_tables("glyphs") + "SELECT page, arg_max(font, (n, font)) AS font, max(m) AS baseline FROM (SELECT page, font, count(*) AS n FROM glyphs GROUP BY ALL) JOIN (SELECT page, median(baseline) AS m FROM glyphs GROUP BY page) USING (page) GROUP BY page")
def ag_17(s, d):
    lines = T.glyph_lines(s, d)
    fonts = lines.groupBy("page", "font").count().groupBy("page").agg(F.max_by("font", F.struct("count", "font")).alias("font"))
    return fonts.join(lines.groupBy("page").agg(F.median("baseline").alias("baseline")), "page")


@query("ag_18_usual_gap", _GLY + "SELECT DISTINCT page, col, usual FROM p")
def ag_18(s, d):
    return L.split_columns(T.glyph_lines(s, d)).select("page", "col", "usual").distinct()


@query("ag_19_colour_statistics", "SELECT p_size % 10 AS box, median(p_partkey % 256)::DOUBLE AS red, avg(p_partkey % 200) AS luma, round(var_pop(p_partkey % 200), 6) AS spread FROM part GROUP BY 1")
def ag_19(s, d):
    part = T.read(s, d, "part")
    return part.groupBy((F.col("p_size") % 10).alias("box")).agg(F.median(F.col("p_partkey") % 256).alias("red"), F.avg(F.col("p_partkey") % 200).alias("luma"), F.round(F.var_pop(F.col("p_partkey") % 200), 6).alias("spread"))


@query("jn_20_header_partner", with_tables("glyphs", more=f"c AS (SELECT *, {_COL} AS col FROM glyphs)") + "SELECT page, idx, partner FROM (SELECT l.page, l.idx, r.idx AS partner, row_number() OVER (PARTITION BY l.page, l.idx ORDER BY abs(l.baseline - r.baseline), r.idx) AS n FROM c l JOIN c r ON l.page = r.page AND l.col = 0 AND r.col = 1 AND abs(l.baseline - r.baseline) <= 2) WHERE n = 1")
def jn_20(s, d):
    return L.header_partner(T.glyph_lines(s, d))


@query("win_15_spread_headers", with_tables("glyphs", more=f"c AS (SELECT *, {_COL} AS col FROM glyphs)") + "SELECT page, idx, partner FROM (SELECT l.page, l.idx, r.idx AS partner, row_number() OVER (PARTITION BY l.page, l.idx ORDER BY abs(l.baseline - r.baseline), r.idx) AS n FROM c l JOIN c r ON l.page = r.page AND l.col = 0 AND r.col = 1 AND abs(l.baseline - r.baseline) <= 2) WHERE n = 1" + " QUALIFY row_number() OVER (PARTITION BY page, partner ORDER BY idx) = 1")
def win_15(s, d):
    """Each right half is used once: by the first left half that wants it."""
    near = L.header_partner(T.glyph_lines(s, d))
    return near.withColumn("n", F.row_number().over(Window.partitionBy("page", "partner").orderBy("idx"))).where("n = 1").drop("n")


@query("jn_25_column_edge", with_tables("glyphs", more=f"c AS (SELECT *, {_COL} AS col FROM glyphs)") + "SELECT page, idx, x0 <= min(x0) OVER (PARTITION BY page, col) + 3 AS at_edge FROM c")
def jn_25(s, d):
    return L.column_edges(T.glyph_lines(s, d)).select("page", "idx", "at_edge")


_FRAGMENTS = "o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY -baseline, x0, idx) AS n FROM glyphs), r AS (SELECT page, n, 0 AS line, text, x0, x1, baseline FROM o WHERE n = 1 UNION ALL SELECT page, n, CASE WHEN fits THEN line ELSE line + 1 END, CASE WHEN fits THEN trim(t || ' ' || text) ELSE text END, CASE WHEN fits THEN least(a0, x0) ELSE x0 END, CASE WHEN fits THEN greatest(a1, x1) ELSE x1 END, CASE WHEN fits THEN (b + baseline) / 2 ELSE baseline END FROM (SELECT o.page, o.n, r.line, r.text AS t, r.x0 AS a0, r.x1 AS a1, r.baseline AS b, o.text, o.x0, o.x1, o.baseline, abs(r.baseline - o.baseline) < 1.4 AND o.x0 - r.x1 BETWEEN -1.0 AND 16.0 AS fits FROM r JOIN o ON o.page = r.page AND o.n = r.n + 1))"


@query("win_12_merged_fragments", with_tables("glyphs", more=_FRAGMENTS, recursive=True) + "SELECT page, line, text, x0, x1, baseline FROM r QUALIFY row_number() OVER (PARTITION BY page, line ORDER BY n DESC) = 1")
def win_12(s, d):
    return L.merged_fragments(T.glyph_lines(s, d))


_STITCH = "o AS (SELECT document_id AS doc, ord, ord // 5 AS page, text, ord % 5 = 0 AS at_edge, row_number() OVER (PARTITION BY document_id ORDER BY ord) AS n FROM blocks WHERE kind <> 'gap'), e AS (SELECT *, regexp_matches(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '[.!?…][''\"”’)\\]]*$') AS ended, regexp_matches(text, '^[«“\"''’(\\[ ]*\\p{Ll}') AS low FROM o), r AS (SELECT doc, n, ord, page, ord AS anchor, ended FROM e WHERE n = 1 UNION ALL SELECT e.doc, e.n, e.ord, e.page, CASE WHEN NOT r.ended AND (e.low OR e.page <> r.page AND e.at_edge) THEN r.anchor ELSE e.ord END, e.ended FROM r JOIN e ON e.doc = r.doc AND e.n = r.n + 1)"


@query("win_14_stitched", with_tables("blocks", more=_STITCH, recursive=True) + "SELECT doc, ord, anchor FROM r")
def win_14(s, d):
    rows = T.blocks(s, d).where("kind <> 'gap'").select(F.col("document_id").alias("doc"), "ord", (F.col("ord") / 5).cast("int").alias("page"), "text", (F.col("ord") % 5 == 0).alias("at_edge"))
    return L.stitched(rows)


@query("sc_64_signatures", with_tables("glyphs") + "SELECT idx, size < 11 AND regexp_full_match(regexp_replace(text, '\\s+', '', 'g'), '[A-Z]\\d{0,3}') AS signature, font LIKE '%Book%' AND NOT regexp_full_match(regexp_replace(text, '\\s+', '', 'g'), '\\d+') AS book_text FROM glyphs")
def sc_64(s, d):
    compact = F.regexp_replace("text", r"\s+", "")
    return T.glyph_lines(s, d).select("idx", ((F.col("size") < 11) & compact.rlike(r"^[A-Z]\d{0,3}$")).alias("signature"), (F.col("font").contains("Book") & ~compact.rlike(r"^\d+$")).alias("book_text"))


@query("sc_65_line_ends", with_tables("blocks") + "SELECT document_id, ord, regexp_matches(rtrim(text), '[.!?…][''\"”’)\\]]*$') AS ends, regexp_matches(text, '^[«“\"''’(\\[ ]*\\p{Ll}') AS lower_start FROM blocks")
def sc_65(s, d):
    return T.blocks(s, d).select("document_id", "ord", F.rtrim("text").rlike("[.!?…]['\"”’)\\]]*$").alias("ends"), F.col("text").rlike(r"^[«“\"'’(\[ ]*\p{Ll}").alias("lower_start"))


# Planning

_DEVICES = [("desk", 8, 32.0, 200.0, True, True, [("GeForce 3060", 12.0, 9.5), ("Intel UHD", 1.0, 0.9)]), ("old", 2, 8.0, 20.0, True, False, []), ("book", 12, 16.0, None, True, True, [("GeForce 1050", 4.0, 3.0)]), ("bare", None, 24.0, 100.0, False, True, [("GeForce 3090", 24.0, 22.0)])]
_DEV_SQL = "v AS (SELECT * FROM (VALUES ('desk', 8, 32.0::DOUBLE, 200.0::DOUBLE, true, true, 9.5::DOUBLE), ('old', 2, 8.0, 20.0, true, false, NULL), ('book', 12, 16.0, NULL, true, true, 3.0), ('bare', NULL, 24.0, 100.0, false, true, 22.0)) t(device, cores, ram_total, disk_free, runtime, offload, free_vram))"


def _devices(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_DEVICES, "device string, cores int, ram_total double, disk_free double, runtime boolean, offload boolean, gpus array<struct<name:string,total:double,free:double>>")


_LAYERS = "CASE WHEN NOT offload OR free_vram IS NULL OR estimated_vram_gb IS NULL OR estimated_vram_gb <= 0 THEN 0 WHEN free_vram >= estimated_vram_gb + 1.4 THEN -1 WHEN free_vram - 1.4 <= 0 OR floor(layer_count * (free_vram - 1.4) / estimated_vram_gb) < 4 THEN 0 ELSE least(layer_count, floor(layer_count * (free_vram - 1.4) / estimated_vram_gb)) END::INTEGER"


@query("sc_80_placements", with_tables("models", more=_DEV_SQL + f", l AS (SELECT *, {_LAYERS} AS layers FROM models, v)") + "SELECT device, model_id, filename, CASE WHEN disk_free IS NULL THEN 'unknown' WHEN disk_free < size_bytes / 1073741824.0::DOUBLE * 1.1::DOUBLE THEN 'no' WHEN NOT runtime THEN 'runtime_missing' WHEN ram_total < estimated_ram_gb + 1 THEN 'no' ELSE 'cpu_unverified' END AS verdict, layers, CASE WHEN coalesce(cores, 2) <= 2 THEN coalesce(cores, 2) ELSE least(8, cores - 1) END::INTEGER AS threads, CASE WHEN layers <> 0 THEN 512 ELSE 256 END AS batch, CASE WHEN layers = 0 OR ram_total < estimated_ram_gb + 2 THEN 4096 ELSE 8192 END AS context FROM l")
def sc_80(s, d):
    return M.placements(T.models(s, d), _devices(s))


_REC = _DEV_SQL + ", f AS (SELECT *, coalesce(ram_total >= estimated_ram_gb + 1, false) AND coalesce(disk_free >= floor(size_bytes * 1.1::DOUBLE) / 1073741824.0::DOUBLE, false) AS fits FROM models, v WHERE status = 'available'), r AS (SELECT device, model_id, filename, fits FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY fits DESC, CASE WHEN fits THEN -estimated_ram_gb ELSE estimated_ram_gb END, filename, model_id) AS n FROM f) WHERE n = 1)"


@query("sc_81_recommended", with_tables("models", more=_REC) + "SELECT * FROM r")
def sc_81(s, d):
    return M.recommended(T.models(s, d), _devices(s))


@query("sc_81_setup", with_tables("models", more=_REC) + "SELECT v.device, CASE WHEN r.fits THEN 'download' ELSE 'skip' END AS action, CASE WHEN r.fits THEN r.model_id END AS model_id FROM v LEFT JOIN r USING (device)")
def sc_81_setup(s, d):
    return M.setup(T.models(s, d), _devices(s), s.createDataFrame([], "model_id string"))


_GPUS = "CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size * 0.25D END"


@query("ag_21_best_vram", f"SELECT p_partkey % 60 AS device, max(CASE WHEN p_size % 6 <> 0 AND p_size * 0.5::DOUBLE >= {M.LEAST_VRAM} THEN p_size * 0.25::DOUBLE END) AS best FROM part GROUP BY 1")
def ag_21(s, d):
    """Devices with many cards each: parts stand for cards, their sizes for memory, which some don't tell."""
    card = F.struct(F.col("p_name").alias("name"), (F.col("p_size") * 0.5).alias("total"), F.expr(_GPUS).alias("free"))
    devices = T.read(s, d, "part").groupBy((F.col("p_partkey") % 60).alias("device")).agg(F.collect_list(card).alias("gpus"))
    return devices.select("device", M.best_free_vram(F.col("gpus")).alias("best"))


# State


@query("dml_02_language_upsert", with_tables("task_events") + "SELECT task_id AS document_id, arg_max(status, (created_at, id)) AS language FROM task_events GROUP BY task_id")
def dml_02(s, d):
    rows = T.task_events(s, d).select(F.col("task_id").alias("document_id"), F.col("status").alias("language"), "created_at", "id")
    return D.latest(rows, ["document_id"], ["created_at", "id"]).select("document_id", "language")


_NEW = "n AS (SELECT document_id, block_ord, target_lang, concat('new ', text) AS text, TIMESTAMP '2026-06-01 00:00:00' AS updated_at FROM translations WHERE (document_id + block_ord) % 5 < 3 UNION ALL SELECT document_id, 9999, 'ru', 'extra', TIMESTAMP '2026-06-01 00:00:00' FROM docs)"


def _new(s: SparkSession, d: str) -> DataFrame:
    at = F.expr("TIMESTAMP '2026-06-01 00:00:00'").alias("updated_at")
    again = T.translations(s, d).where("(document_id + block_ord) % 5 < 3").select("document_id", "block_ord", "target_lang", F.concat(F.lit("new "), "text").alias("text"), at)
    return again.unionByName(T.documents(s, d).select("document_id", F.lit(9999).alias("block_ord"), F.lit("ru").alias("target_lang"), F.lit("extra").alias("text"), at))


@query("dml_03_finish_keeps_edits", with_tables("translations", "docs", more=_NEW) + "SELECT coalesce(o.document_id, n.document_id) AS document_id, coalesce(o.block_ord, n.block_ord) AS block_ord, coalesce(o.target_lang, n.target_lang) AS target_lang, CASE WHEN o.edited OR n.text IS NULL THEN o.text ELSE n.text END AS text, coalesce(o.edited, false) AS edited, CASE WHEN o.edited OR n.text IS NULL THEN o.updated_at ELSE n.updated_at END AS updated_at FROM translations o FULL JOIN n ON o.document_id = n.document_id AND o.block_ord = n.block_ord AND o.target_lang = n.target_lang")
def dml_03(s, d):
    return D.finish(T.translations(s, d), _new(s, d), ["document_id", "block_ord", "target_lang"])


@query("dml_04_human_edit", with_tables("translations", "docs", more=_NEW) + "SELECT document_id, block_ord, target_lang, text, true AS edited FROM n UNION ALL SELECT document_id, block_ord, target_lang, text, edited FROM translations t WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.document_id = t.document_id AND n.block_ord = t.block_ord AND n.target_lang = t.target_lang)")
def dml_04(s, d):
    edits = _new(s, d).drop("updated_at").withColumn("edited", F.lit(True))
    return D.upsert(T.translations(s, d).drop("updated_at"), edits, ["document_id", "block_ord", "target_lang"])


@query("dml_05_interrupt", with_tables("tasks") + "SELECT task_id, CASE WHEN status = 'running' THEN 'interrupted' ELSE status END AS status FROM tasks")
def dml_05(s, d):
    return D.interrupted(T.tasks(s, d)).select("task_id", "status")


@query("dml_05_interrupt_events", with_tables("tasks") + "SELECT task_id, 'interrupted' AS status FROM tasks WHERE status = 'running'")
def dml_05_events(s, d):
    return D.interruption_events(T.tasks(s, d))


@query("dml_06_create_tasks", with_tables("blocks") + "SELECT document_id, l.lang AS target_lang, 'queued' AS status, total FROM (SELECT document_id, count(*) AS total FROM blocks WHERE translatable AND trim(text) <> '' AND length(text) <= 1100 GROUP BY document_id), (VALUES ('ru'), ('de')) l(lang)")
def dml_06(s, d):
    short = T.blocks(s, d).where("length(text) <= 1100")
    return D.planned_tasks(T.documents(s, d), ["ru", "de"], P.segments(short, 1100))


_RESUME = "r AS (SELECT task_id, model_id, CASE WHEN task_id % 2 = 0 THEN 'm1' ELSE model_id END AS new_model FROM tasks WHERE status IN ('paused', 'failed'))"


@query("dml_07_resume", with_tables("tasks", "segments", more=_RESUME) + "SELECT s.task_id, s.block_ord, s.segment_ord, CASE WHEN r.new_model <> r.model_id THEN '' ELSE s.translation END AS translation, CASE WHEN r.new_model <> r.model_id THEN 'pending' ELSE s.status END AS status FROM segments s JOIN r USING (task_id)")
def dml_07(s, d):
    tasks = T.tasks(s, d).where("status IN ('paused', 'failed')")
    model = F.when(F.col("task_id") % 2 == 0, "m1").otherwise(F.col("model_id"))
    return D.resumed(tasks, T.segments(s, d), model)[1].select("task_id", "block_ord", "segment_ord", "translation", "status")


@query("dml_08_status_from_events", with_tables("task_events") + "SELECT task_id, arg_max(status, id) AS status, count(*) AS events FROM task_events GROUP BY task_id")
def dml_08(s, d):
    return T.task_events(s, d).groupBy("task_id").agg(F.max_by("status", "id").alias("status"), F.count("*").alias("events"))


@query("dml_09_save_segment", with_tables("segments", more="n AS (SELECT task_id, block_ord, segment_ord, 'again' AS translation FROM segments WHERE task_id % 4 = 1)") + "SELECT s.task_id, s.block_ord, s.segment_ord, coalesce(n.translation, s.translation) AS translation, CASE WHEN n.task_id IS NOT NULL THEN 'complete' ELSE s.status END AS status FROM segments s LEFT JOIN n USING (task_id, block_ord, segment_ord)")
def dml_09(s, d):
    key = ["task_id", "block_ord", "segment_ord"]
    old = T.segments(s, d).select(*key, "translation", "status")
    new = old.where("task_id % 4 = 1").withColumn("translation", F.lit("again")).withColumn("status", F.lit("complete"))
    return D.upsert(old, new, key)


_BOOK_TERMS = "SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS source, split_part(p_name, ' ', 2) AS target FROM part"


def _part_terms(s: SparkSession, d: str) -> DataFrame:
    """A glossary made of the parts' names."""
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    return T.read(s, d, "part").select(F.col("p_partkey").alias("id"), word(1).alias("source"), word(2).alias("target"))


@query(
    "dml_10_delete_terms",
    f"WITH g AS ({_BOOK_TERMS}), n AS (SELECT id * 3 AS id, upper(target) AS target FROM g WHERE id % 7 = 1), x AS (SELECT id * 2 AS id FROM g WHERE id % 5 = 2) "
    "SELECT g.id, source, coalesce(n.target, g.target) AS target, NULL AS error FROM g LEFT JOIN n ON n.id = g.id WHERE g.id NOT IN (SELECT id FROM x) UNION ALL "
    "SELECT id, NULL, NULL, 'no such term' FROM (SELECT id FROM n UNION SELECT id FROM x) WHERE id NOT IN (SELECT id FROM g)",
)
def dml_10(s, d):
    """Terms with other targets and terms taken out; those that aren't there come back as errors."""
    terms = _part_terms(s, d)
    new = terms.where("id % 7 = 1").select((F.col("id") * 3).alias("id"), F.upper("target").alias("target"))
    gone = terms.where("id % 5 = 2").select((F.col("id") * 2).alias("id"))
    after, errors = G.changed_terms(terms, new, gone)
    return after.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)


@query("ord_01_terms", f"SELECT id, source, row_number() OVER (ORDER BY length(source) DESC, source, id) AS place FROM ({_BOOK_TERMS})")
def ord_01(s, d):
    return G.in_order(_part_terms(s, d)).select("id", "source", "place")


@query("dml_11_added_columns", with_tables("tasks", "projects") + "SELECT t.task_id, CASE WHEN t.task_id % 3 = 0 THEN p.lang_a ELSE t.target_lang END AS target_lang FROM tasks t, (SELECT lang_a FROM projects WHERE project_id = 1) p")
def dml_11(s, d):
    """Rows of an older schema lack a column; the union fills it with null and the project's value."""
    t = T.tasks(s, d)
    rows = t.where("task_id % 3 = 0").select("task_id").unionByName(t.where("task_id % 3 <> 0").select("task_id", "target_lang"), allowMissingColumns=True)
    one = T.projects(s, d).where("project_id = 1").select("lang_a")
    return rows.crossJoin(F.broadcast(one)).select("task_id", F.coalesce("target_lang", "lang_a").alias("target_lang"))


@query("dml_12_settings", with_tables("projects") + "SELECT project_id, CASE WHEN lang_a = lang_b THEN lang_a ELSE concat(lang_a, ',', lang_b) END AS targets, lang_a AS first_target FROM projects")
def dml_12(s, d):
    targets = F.array_distinct(F.array("lang_a", "lang_b"))
    return T.projects(s, d).select("project_id", F.array_join(targets, ",").alias("targets"), targets[0].alias("first_target"))


@query("dml_13_narrative", with_tables("docs") + "SELECT document_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 900) AS narrative FROM docs")
def dml_13(s, d):
    return T.documents(s, d).select("document_id", F.substring(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), 1, 900).alias("narrative"))


# Exports

_TR = "t AS (SELECT b.document_id, b.ord, b.kind, CASE WHEN b.translatable THEN coalesce(t.text, b.text) ELSE b.text END AS final FROM blocks b LEFT JOIN translations t ON t.document_id = b.document_id AND t.block_ord = b.ord AND t.target_lang = 'ru'), p AS (SELECT document_id, ord, CASE WHEN kind = 'heading' THEN 'heading' ELSE 'paragraph' END AS kind, trim(final) AS text FROM t WHERE kind <> 'gap' AND trim(final) <> '')"
_EXP = with_tables("blocks", "translations", more=_TR)
_ESC = "replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _pieces(s: SparkSession, d: str) -> DataFrame:
    return K.pieces(V.translated(T.blocks(s, d), T.translations(s, d), "ru"))


@query("snk_12_pieces", _EXP + "SELECT * FROM p")
def snk_12(s, d):
    return _pieces(s, d)


_BOOK = "concat('Book & ', CAST(document_id AS STRING))"


def _titled(s: SparkSession, d: str) -> DataFrame:
    return _pieces(s, d).withColumn("title", F.expr(_BOOK)).withColumn("format", F.lit("txt"))


#: White space around blocks, which exports have to keep: some blocks are indented, most end their line.
_AROUND = {"prefix": "CASE WHEN kind = 'heading' AND ord % 2 = 0 THEN '### ' WHEN ord % 7 = 3 THEN '  ' ELSE '' END", "suffix": "CASE WHEN ord % 3 = 1 THEN '' ELSE chr(10) END"}


def _whole(s: SparkSession, d: str) -> DataFrame:
    """All blocks with what is exported, their white space and their sections."""
    rows = V.translated(V.sections(T.blocks(s, d)), T.translations(s, d), "ru")
    return rows.withColumns({k: F.expr(v) for k, v in _AROUND.items()}).withColumn("section", F.col("section_no")).withColumn("section_title", F.coalesce("section_title", F.lit("Document")))


_WHOLE = "w AS (SELECT t.document_id, t.ord, t.kind, t.final, " + ", ".join(f"{v.replace('kind', 't.kind').replace('ord ', 't.ord ')} AS {k}" for k, v in _AROUND.items()) + ", sum(CASE WHEN t.kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY t.document_id ORDER BY t.ord) AS section, coalesce(last_value(CASE WHEN t.kind = 'heading' THEN b.text END IGNORE NULLS) OVER (PARTITION BY t.document_id ORDER BY t.ord ROWS UNBOUNDED PRECEDING), 'Document') AS section_title FROM t JOIN blocks b ON b.document_id = t.document_id AND b.ord = t.ord)"
_GAP = "CASE WHEN lag(piece) OVER o <> '' AND piece <> '' AND NOT regexp_matches(right(lag(piece) OVER o, 1), '\\s') AND NOT regexp_matches(left(piece, 1), '\\s') THEN chr(10) || chr(10) ELSE '' END"


@query("snk_01_text", with_tables("blocks", "translations", more=_TR + ", " + _WHOLE + ", x AS (SELECT *, concat(prefix, final, suffix) AS piece FROM w), y AS (SELECT document_id, ord, " + _GAP + " || piece AS item FROM x WINDOW o AS (PARTITION BY document_id ORDER BY ord))") + "SELECT document_id, md5(string_agg(item, '' ORDER BY ord)) AS body_md5 FROM y GROUP BY document_id")
def snk_01(s, d):
    return K.as_text(_whole(s, d)).select("document_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("snk_02_markdown", with_tables("blocks", "translations", more=_TR + ", " + _WHOLE + ", x AS (SELECT *, CASE WHEN kind = 'heading' THEN concat(CASE WHEN starts_with(prefix, '#') THEN prefix ELSE '# ' END, " + "regexp_replace(final, '^\\s+|\\s+$', '', 'g')" + ", CASE WHEN suffix = '' THEN chr(10) ELSE suffix END) ELSE concat(prefix, final, suffix) END AS piece FROM w), y AS (SELECT document_id, ord, CASE WHEN kind = 'heading' THEN piece WHEN lag(section) OVER o IS DISTINCT FROM section THEN concat(CASE WHEN coalesce(lag(piece) OVER o, '') <> '' AND NOT ends_with(lag(piece) OVER o, chr(10) || chr(10)) THEN chr(10) || chr(10) ELSE '' END, '## ', section_title, chr(10), chr(10), piece) ELSE " + _GAP + " || piece END AS item FROM x WINDOW o AS (PARTITION BY document_id ORDER BY ord))") + "SELECT document_id, md5(string_agg(item, '' ORDER BY ord)) AS body_md5 FROM y GROUP BY document_id")
def snk_02(s, d):
    return K.as_markdown(_whole(s, d)).select("document_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("snk_03_html", _EXP + "SELECT document_id, md5(concat('<!DOCTYPE html>', chr(10), '<html lang=\"und\">', chr(10), '<head>', chr(10), '<meta charset=\"utf-8\">', chr(10), '<title>Book &amp; ', document_id, '</title>', chr(10), '</head>', chr(10), '<body>', chr(10), '<article><h1>Book &amp; ', document_id, '</h1>', chr(10), string_agg(concat(CASE WHEN kind = 'heading' THEN '<h2>' ELSE '<p>' END, replace(" + _ESC.format(x="text") + ", chr(10), '<br>' || chr(10)), CASE WHEN kind = 'heading' THEN '</h2>' ELSE '</p>' END), chr(10) ORDER BY ord), chr(10), '</article>', chr(10), '</body>', chr(10), '</html>', chr(10))) AS body_md5 FROM p GROUP BY document_id")
def snk_03(s, d):
    return K.as_html(_titled(s, d)).select("document_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("snk_05_fictionbook", _EXP + ", q AS (SELECT *, sum((kind = 'heading')::INT) OVER (PARTITION BY document_id ORDER BY ord) AS section FROM p), r AS (SELECT document_id, section, concat('<section><title><p>', coalesce(max(" + _ESC.format(x="text") + ") FILTER (WHERE kind = 'heading'), max('Book &amp; ' || document_id)), '</p></title>', coalesce(string_agg(concat('<p>', " + _ESC.format(x="text") + ", '</p>'), '' ORDER BY ord) FILTER (WHERE kind <> 'heading'), '<p></p>'), '</section>') AS x FROM q GROUP BY ALL) SELECT document_id, count(*) AS sections, md5(concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?>', chr(10), '<FictionBook xmlns=\"http://www.gribuser.ru/xml/fictionbook/2.0\">', chr(10), '<description><title-info>', chr(10), '<book-title>Book &amp; ', document_id, '</book-title>', chr(10), '<lang>und</lang>', chr(10), '</title-info></description>', chr(10), '<body>', string_agg(x, '' ORDER BY section), '</body>', chr(10), '</FictionBook>', chr(10))) AS body_md5 FROM r GROUP BY document_id")
def snk_05(s, d):
    return K.as_fictionbook(_titled(s, d)).select("document_id", "sections", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("snk_07_json", _EXP + "SELECT document_id, 'Book & ' || document_id AS title, 'txt' AS format, count(*) AS blocks, md5(string_agg(kind || ':' || text, chr(10) ORDER BY ord)) AS blocks_md5 FROM p GROUP BY document_id")
def snk_07(s, d):
    """The JSON is read back whole."""
    back = K.as_json(_titled(s, d)).select("document_id", F.from_json("body", "title string, sourceFormat string, blocks array<struct<kind:string,text:string>>").alias("j"))
    lines = F.array_join(F.transform("j.blocks", lambda x: F.concat(x["kind"], F.lit(":"), x["text"])), "\n")
    return back.select("document_id", F.col("j.title").alias("title"), F.col("j.sourceFormat").alias("format"), F.size("j.blocks").cast("long").alias("blocks"), F.md5(lines.cast("binary")).alias("blocks_md5"))


@query("snk_04_rtf", _EXP + f"SELECT document_id, {RTF_BODY} AS body FROM (SELECT *, {RTF} AS r FROM p) GROUP BY document_id")
def snk_04(s, d):
    return K.as_rtf(_titled(s, d))


@query("snk_06_odt", _EXP + f", q AS (SELECT document_id, -1 AS ord, 'heading' AS kind, {_BOOK} AS text FROM p GROUP BY document_id UNION ALL SELECT * FROM p) SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY ord) - 1)::INTEGER AS ord, kind, md5(text) AS text_md5 FROM q")
def snk_06(s, d):
    """Text documents, read again: the title, then the pieces."""
    files = K.as_zip(_titled(s, d), "odt").select(F.concat(F.col("document_id").cast("string"), F.lit(".odt")).alias("path"), "content")
    return I.import_archives(files).select(F.regexp_extract("file", r"^(\d+)", 1).cast("long").alias("document_id"), "ord", "kind", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("snk_14_versioned_names", with_tables("exports") + "SELECT id, concat('file-', document_id::STRING, '.', target_lang, '.', strftime(created_at, '%Y%m%d-%H%M%S'), CASE WHEN n > 1 THEN concat('-', n::STRING) ELSE '' END, '.', format) AS name FROM (SELECT *, row_number() OVER (PARTITION BY document_id, target_lang, created_at, format ORDER BY id) AS n FROM exports)")
def snk_14(s, d):
    return K.versioned(T.exports(s, d)).select("id", "name")


@query("snk_15_record_export", with_tables("exports", "tasks") + "SELECT id, document_id, format FROM exports UNION ALL SELECT task_id + 1000000, document_id, 'md' FROM tasks WHERE status = 'complete'")
def snk_15(s, d):
    new = T.tasks(s, d).where("status = 'complete'").select((F.col("task_id") + 1000000).alias("id"), "document_id", F.lit("md").alias("format"))
    return T.exports(s, d).select("id", "document_id", "format").unionByName(new)


@query("snk_16_import_check", with_tables("docs") + "SELECT document_id, sha256(text) AS digest, document_id % 10 <> 0 AS same FROM docs")
def snk_16(s, d):
    """Files against the digests noted when they were imported; every tenth has changed since. A document without text has no digest and no file."""
    folder = f"{shared_dir(s).rstrip('/')}/import-{uuid.uuid4().hex}"
    docs = T.documents(s, d).select("document_id", "text", F.sha2("text", 256).alias("digest"))
    changed = F.when(F.col("document_id") % 10 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    name = S.spread(F.concat(F.lit("file-"), F.col("document_id").cast("string"), F.lit(".txt")))
    S.write(docs.select(name.alias("name"), F.encode(changed, "UTF-8").alias("content")).where("content IS NOT NULL"), folder, together=True)
    found = S.digests(s, folder).select(F.regexp_extract("file", r"file-(\d+)", 1).cast("long").alias("document_id"), F.col("digest").alias("now"))
    return docs.select("document_id", "digest").join(found, "document_id", "left").select("document_id", "digest", F.col("digest").eqNullSafe(F.col("now")).alias("same"))


@query("src_12_parsed_json", with_tables("blocks") + "SELECT document_id, ord, kind, text FROM blocks")
def src_12(s, d):
    """Blocks as a JSON tree for each document and back."""
    tree = K.block_trees(T.blocks(s, d))
    return K.blocks_from_trees(tree)
