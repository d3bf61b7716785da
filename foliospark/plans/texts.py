"""Text queries: blocks, segments, packs, glossary, memory, scripts and output checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import cleaning as C
from foliospark.functions import languages as L
from foliospark.functions import scripts as S
from foliospark.operators import glossary as G
from foliospark.operators import segments as P
from foliospark.operators import views as V
from foliospark.plans.registry import query
from foliospark.sources import tables as T
from foliospark.sources.tables import with_tables

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_SQUEEZE = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"

# Blocks and segments


@query("src_03_plain_blocks", with_tables("docs", more="p AS (SELECT document_id, unnest(l) AS item, generate_subscripts(l, 1) - 1 AS ord FROM (SELECT document_id, list_filter(string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '(\\r?\\n[\\t ]*\\r?\\n+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM docs)), q AS (SELECT *, " + _STRIP.format(x="item") + " AS body FROM p)") + "SELECT document_id, ord::INTEGER AS ord, CASE WHEN body = '' THEN 'gap' ELSE 'paragraph' END AS kind, md5(CASE WHEN body = '' THEN item ELSE body END) AS text_md5, CASE WHEN body = '' THEN 0 ELSE length(regexp_extract(item, '^(\\s*)', 1)) END::INTEGER AS n_prefix, CASE WHEN body = '' THEN 0 ELSE length(regexp_extract(item, '(\\s*)$', 1)) END::INTEGER AS n_suffix FROM q")
def src_03(s, d):
    docs = T.documents(s, d).withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return P.plain_blocks(docs).select("document_id", "ord", "kind", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("prefix").alias("n_prefix"), F.length("suffix").alias("n_suffix"))


_MD = "CASE ord % 11 WHEN 0 THEN concat('## ', text) WHEN 3 THEN concat('- ', text) WHEN 5 THEN '' WHEN 7 THEN CASE document_id % 3 WHEN 0 THEN '```' WHEN 1 THEN '```python' ELSE concat('~~~ ', text) END WHEN 9 THEN '```' WHEN 10 THEN concat('  > ', text) ELSE text END"
_MD_SQL = (
    with_tables(
        "blocks",
        more=f"l AS (SELECT document_id, ord, {_MD} AS line FROM blocks), f AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ord) AS rn, regexp_replace(line, '^\\s+', '') AS t FROM l), "
        "h(document_id, ord, line, t, rn, code, opener, open) AS (SELECT document_id, ord, line, t, rn, regexp_matches(t, '^(```+|~~~+)'), regexp_matches(t, '^(```+|~~~+)'), regexp_matches(t, '^(```+|~~~+)') FROM f WHERE rn = 1 UNION ALL "
        "SELECT f.document_id, f.ord, f.line, f.t, f.rn, h.open OR regexp_matches(f.t, '^(```+|~~~+)'), NOT h.open AND regexp_matches(f.t, '^(```+|~~~+)'), CASE WHEN h.open THEN NOT regexp_matches(f.t, '^(```+|~~~+)\\s*$') ELSE regexp_matches(f.t, '^(```+|~~~+)') END FROM h JOIN f ON f.document_id = h.document_id AND f.rn = h.rn + 1), "
        "k AS (SELECT *, CASE WHEN code THEN 'code' WHEN trim(t) = '' THEN 'gap' WHEN regexp_matches(t, '^#{1,6}\\s+') THEN 'heading' WHEN regexp_matches(t, '^(>\\s+|([-+*]|\\d+[.)])\\s+)') THEN 'item' ELSE 'prose' END AS kind FROM h), "
        "o AS (SELECT *, CASE WHEN kind = 'prose' THEN coalesce(lag(kind) OVER w <> 'prose', true) WHEN kind = 'code' THEN opener ELSE true END AS opens FROM k WINDOW w AS (PARTITION BY document_id ORDER BY ord)), "
        "b AS (SELECT *, sum(opens::INT) OVER w - 1 AS block, sum((kind = 'heading')::INT) OVER w AS section_no FROM o WINDOW w AS (PARTITION BY document_id ORDER BY ord)), "
        "r AS (SELECT document_id, block, min(kind) AS line_kind, min(ord) AS first_ord, count(*) AS n_lines, min(section_no) AS section_no, string_agg(line, chr(10) ORDER BY ord) AS raw FROM b GROUP BY ALL), "
        "x AS (SELECT *, CASE WHEN line_kind IN ('heading', 'item') THEN regexp_extract(raw, '^(\\s*(#{1,6}\\s+|>\\s+|([-+*]|\\d+[.)])\\s+))', 1) WHEN line_kind = 'prose' THEN regexp_extract(raw, '^(\\s*)', 1) ELSE '' END AS prefix FROM r)",
        recursive=True,
    )
    + "SELECT document_id, block::BIGINT AS block, CASE WHEN line_kind IN ('item', 'prose') THEN 'paragraph' ELSE line_kind END AS kind, first_ord, n_lines, CASE WHEN section_no = 0 THEN 'main' ELSE 'section-' || section_no::STRING END AS section, md5(substr(raw, length(prefix) + 1)) AS text_md5 FROM x"
)


@query("src_04_markdown_blocks", _MD_SQL)
def src_04(s, d):
    lines = T.blocks(s, d).select("document_id", "ord", F.expr(_MD).alias("line"))
    return P.markdown_blocks(lines).select("document_id", "block", "kind", "first_ord", "n_lines", "section", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("win_04_fence_parity", with_tables("blocks", more=f"l AS (SELECT document_id, ord, {_MD} AS line FROM blocks)") + "SELECT document_id, ord, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ord) % 2 = 1 AS inside FROM l")
def win_04(s, d):
    lines = T.blocks(s, d).select("document_id", "ord", F.expr(_MD).alias("line"))
    seen = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.select("document_id", "ord", (F.sum(F.col("line").startswith("```").cast("int")).over(seen) % 2 == 1).alias("inside"))


def _split_sql(most: int) -> str:
    half, win = most // 2, f"substr(rest, 1, {most})"
    cut = (
        f"CASE WHEN length(rest) <= {most} THEN length(rest) WHEN length(regexp_extract({win}, '(?s)^(.*[。！？])', 1)) > {half} THEN length(regexp_extract({win}, '(?s)^(.*[。！？])', 1)) "
        f"WHEN length(regexp_extract({win}, '(?s)^(.*[.!?…][\"''»”)]*\\s+)', 1)) > {half} THEN length(regexp_extract({win}, '(?s)^(.*[.!?…][\"''»”)]*\\s+)', 1)) "
        f"WHEN length(regexp_extract({win}, '(?s)^(.*\\s)', 1)) > {half} THEN length(regexp_extract({win}, '(?s)^(.*\\s)', 1)) ELSE {most} END"
    )
    return f"c(document_id, segment_ord, piece, rest) AS (SELECT document_id, -1, '', text FROM docs WHERE {_STRIP.format(x='text')} <> '' UNION ALL SELECT document_id, segment_ord + 1, substr(rest, 1, n), substr(rest, n + 1) FROM (SELECT *, {cut} AS n FROM c WHERE rest <> ''))"


@query("sc_01_split_text", with_tables("docs", more=_split_sql(1100), recursive=True) + "SELECT document_id, segment_ord, length(piece)::INTEGER AS n, md5(piece) AS piece_md5 FROM c WHERE segment_ord >= 0")
def sc_01(s, d):
    docs = T.documents(s, d).select("document_id", F.lit(0).alias("ord"), F.lit(True).alias("translatable"), "text")
    return P.segments(docs, 1100).select("document_id", "segment_ord", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("piece_md5"))


@query("sc_01_lossless", with_tables("docs") + "SELECT document_id, true AS lossless FROM docs WHERE trim(text) <> ''")
def sc_01_lossless(s, d):
    docs = T.documents(s, d).where("trim(text) <> ''")
    return docs.select("document_id", (F.array_join(P.split_text(F.col("text"), 700), "") == F.col("text")).alias("lossless"))


@query("pipeline_a_language_profile", with_tables("docs", more=_split_sql(1100), recursive=True) + "SELECT d.lang, count(DISTINCT c.document_id) AS documents, count(*) AS segments, sum(length(piece))::BIGINT AS chars, max(length(piece))::INTEGER AS longest FROM c JOIN docs d USING (document_id) WHERE segment_ord >= 0 GROUP BY d.lang")
def pipeline_a(s, d):
    docs = T.documents(s, d)
    cut = P.segments(docs.select("document_id", F.lit(0).alias("ord"), F.lit(True).alias("translatable"), "text", "lang").drop("lang"), 1100)
    return cut.join(docs.select("document_id", "lang"), "document_id").groupBy("lang").agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


@query("win_01_renumber", with_tables("blocks") + "SELECT document_id, ord, row_number() OVER (PARTITION BY document_id ORDER BY ord)::INTEGER - 1 AS place FROM blocks WHERE kind <> 'gap'")
def win_01(s, d):
    return T.blocks(s, d).where("kind <> 'gap'").select("document_id", "ord", (F.row_number().over(Window.partitionBy("document_id").orderBy("ord")) - 1).alias("place"))


_SECTIONS = "h AS (SELECT document_id, ord, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ord)::BIGINT AS section_no, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section_title FROM blocks)"


@query("win_02_section_fill", with_tables("blocks", more=_SECTIONS) + "SELECT * FROM h")
def win_02(s, d):
    return V.sections(T.blocks(s, d)).select("document_id", "ord", "section_no", "section_title")


@query("win_03_section_ids", with_tables("blocks", more=_SECTIONS) + "SELECT document_id, ord, CASE WHEN section_no = 0 THEN 'main' ELSE 'section-' || section_no::STRING END AS section FROM h")
def win_03(s, d):
    return V.sections(T.blocks(s, d)).select("document_id", "ord", F.when(F.col("section_no") == 0, "main").otherwise(F.concat(F.lit("section-"), F.col("section_no").cast("string"))).alias("section"))


@query("win_05_prose_merge", with_tables("blocks", more="o AS (SELECT *, kind <> 'paragraph' OR coalesce(lag(kind) OVER w, '') <> 'paragraph' AS opens FROM blocks WINDOW w AS (PARTITION BY document_id ORDER BY ord)), r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY document_id ORDER BY ord) AS run FROM o)") + "SELECT document_id, run::BIGINT AS run, count(*) AS lines, min(ord) AS first_ord FROM r GROUP BY ALL")
def win_05(s, d):
    own = Window.partitionBy("document_id").orderBy("ord")
    opens = (F.col("kind") != "paragraph") | (F.coalesce(F.lag("kind").over(own), F.lit("")) != "paragraph")
    rows = T.blocks(s, d).withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("document_id", "run").agg(F.count("*").alias("lines"), F.min("ord").alias("first_ord"))


@query("win_06_adjacent_turns", with_tables("turns", more="p AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS reply FROM turns WINDOW w AS (PARTITION BY dialog_id ORDER BY turn))") + "SELECT dialog_id, turn, length(text)::INTEGER AS n_source, length(reply)::INTEGER AS n_reply FROM p WHERE role = 'user' AND r = 'model' AND reply <> ''")
def win_06(s, d):
    return _pairs(s, d).select("dialog_id", "turn", F.length("source").alias("n_source"), F.length("translation").alias("n_reply"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("dialog_id").orderBy("turn")
    rows = T.turns(s, d).withColumn("next", F.lead("role").over(own)).withColumn("reply", F.lead("text").over(own))
    return rows.where("role = 'user' AND next = 'model' AND reply <> ''").select("dialog_id", "turn", F.col("text").alias("source"), F.col("reply").alias("translation"))


_DIALOG = "p AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS reply FROM turns WINDOW w AS (PARTITION BY dialog_id ORDER BY turn)), q AS (SELECT dialog_id, turn, text AS source, reply, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'ru' ELSE 'de' END AS target, row_number() OVER (PARTITION BY dialog_id ORDER BY turn DESC) AS n FROM p WHERE role = 'user' AND r = 'model' AND reply <> '')"


@query("flt_17_same_direction", with_tables("turns", more=_DIALOG) + "SELECT dialog_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY dialog_id ORDER BY turn DESC) AS k FROM q WHERE n <= 6 AND (target = '' OR target = 'ru') AND " + _SQUEEZE.format(x="source") + " <> '') WHERE k <= 2")
def flt_17(s, d):
    newest = Window.partitionBy("dialog_id").orderBy(F.desc("turn"))
    target = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "ru").otherwise("de")
    rows = _pairs(s, d).withColumn("target", target).withColumn("n", F.row_number().over(newest)).where("n <= 6")
    rows = rows.where(((F.col("target") == "") | (F.col("target") == "ru")) & (C.squeezed(F.col("source")) != ""))
    return rows.withColumn("k", F.row_number().over(newest)).where("k <= 2").select("dialog_id", "turn")


@query("win_07_context_tail", with_tables("segments") + "SELECT task_id, block_ord, segment_ord, translation, (m - n + 1)::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY block_ord DESC, segment_ord DESC) AS n, least(8, count(*) OVER (PARTITION BY task_id)) AS m FROM segments WHERE status = 'complete') WHERE n <= 8")
def win_07(s, d):
    rows = V.last_context(T.segments(s, d), 8)
    return rows.withColumn("m", F.count("*").over(Window.partitionBy("task_id"))).select("task_id", "block_ord", "segment_ord", "translation", (F.col("m") - F.col("place") + 1).cast("int").alias("place"))


@query("win_08_context_window", with_tables("segments", more="r AS (SELECT *, row_number() OVER w AS place, sum(length(translation)) OVER w AS used FROM segments WHERE status = 'complete' WINDOW w AS (PARTITION BY task_id ORDER BY block_ord DESC, segment_ord DESC))") + "SELECT task_id, block_ord, segment_ord, right(source, 180) AS source, right(translation, 90) AS translation FROM r WHERE place = 1 OR used <= 90")
def win_08(s, d):
    return P.context_window(T.segments(s, d).where("status = 'complete'"), "task_id", ["block_ord", "segment_ord"], 90)


PACK = """o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY block_ord, segment_ord) AS rn, length(source) AS n FROM (SELECT s.*, {whole} AS whole FROM segments s {where})),
k(task_id, rn, block_ord, segment_ord, pack, cnt, size, least, longest, kind, whole) AS (
SELECT task_id, rn, block_ord, segment_ord, 0, 1, n, n, n, kind, whole FROM o WHERE rn = 1 UNION ALL
SELECT o.task_id, o.rn, o.block_ord, o.segment_ord, CASE WHEN x THEN pack + 1 ELSE pack END, CASE WHEN x THEN 1 ELSE cnt + 1 END, CASE WHEN x THEN n ELSE size + n END, CASE WHEN x THEN n ELSE least(k.least, n) END, CASE WHEN x THEN n ELSE greatest(k.longest, n) END, o.kind, o.whole
FROM k JOIN o ON o.task_id = k.task_id AND o.rn = k.rn + 1, LATERAL (SELECT k.cnt >= 4 OR k.size + o.n > {most} OR (least(k.least, o.n) <= 48 AND greatest(k.longest, o.n) >= 160) OR (k.kind <> o.kind AND 'heading' IN (k.kind, o.kind)) OR NOT k.whole OR NOT o.whole AS x))"""


@query("win_09_pack_pending", with_tables("segments", more=PACK.format(whole="true", where="", most=500), recursive=True) + "SELECT task_id, block_ord, segment_ord, pack FROM k")
def win_09(s, d):
    return P.packs(T.segments(s, d), 500, group_blocks=False)


@query("win_10_group_segments", with_tables("segments", more=PACK.format(whole="segment_ord = 0 AND count(*) OVER (PARTITION BY task_id, block_ord) = 1", where="WHERE status <> 'complete'", most=500), recursive=True) + "SELECT task_id, block_ord, segment_ord, pack FROM k")
def win_10(s, d):
    return P.packs(V.whole_blocks(T.segments(s, d).where("status <> 'complete'")), 500)


@query("jn_22_zip_outputs", with_tables("segments", more=PACK.format(whole="true", where="", most=500) + ", z AS (SELECT *, row_number() OVER (PARTITION BY task_id, pack ORDER BY block_ord, segment_ord) - 1 AS pos, count(*) OVER (PARTITION BY task_id, pack) AS n FROM k)", recursive=True) + "SELECT task_id, block_ord, segment_ord, concat('out ', pos::STRING) AS translation FROM z WHERE n = 1 OR (task_id + pack) % 5 <> 0", )
def jn_22(s, d):
    packed = P.packs(T.segments(s, d), 500, group_blocks=False)
    n = F.count("*").cast("int")
    outputs = packed.groupBy("task_id", "pack").agg(n.alias("n")).withColumn("n", F.when(((F.col("task_id") + F.col("pack")) % 5 == 0) & (F.col("n") > 1), F.col("n") + 1).otherwise(F.col("n")))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("out "), i.cast("string"))), "\n\n")
    return P.zip_outputs(packed, outputs.select("task_id", "pack", text.alias("output"))).select("task_id", "block_ord", "segment_ord", "translation")


@query("win_17_next_empty", with_tables("blocks", "translations", more="e AS (SELECT b.document_id, b.ord FROM blocks b LEFT JOIN translations t ON t.document_id = b.document_id AND t.block_ord = b.ord AND t.target_lang = 'ru' WHERE b.translatable AND (t.text IS NULL OR trim(t.text) = ''))") + "SELECT document_id, coalesce(min(ord) FILTER (WHERE ord > 5), min(ord)) AS next FROM e GROUP BY document_id")
def win_17(s, d):
    empty = V.block_states(T.blocks(s, d), T.translations(s, d), ["ru"]).where("state = 'empty'")
    return empty.groupBy("document_id").agg(F.coalesce(F.min(F.when(F.col("ord") > 5, F.col("ord"))), F.min("ord")).alias("next"))


@query("win_18_short_memo", with_tables("blocks", more="b AS (SELECT document_id, ord, " + _SQUEEZE.format(x="text") + " AS key FROM blocks)") + "SELECT document_id, ord, CASE WHEN key = '' OR length(key) > 48 THEN NULL ELSE min(ord) OVER (PARTITION BY document_id, key) END AS reused_from FROM b")
def win_18(s, d):
    key = C.squeezed(F.col("text"))
    rows = T.blocks(s, d).withColumn("key", key)
    first = F.min("ord").over(Window.partitionBy("document_id", "key"))
    return rows.select("document_id", "ord", F.when((F.col("key") != "") & (F.length("key") <= 48), first).alias("reused_from"))


@query("win_20_running_done", with_tables("segments", more="c AS (SELECT * FROM segments WHERE status = 'complete')") + "SELECT task_id, block_ord, segment_ord, count(*) OVER (PARTITION BY task_id ORDER BY block_ord, segment_ord) AS done FROM c")
def win_20(s, d):
    seen = Window.partitionBy("task_id").orderBy("block_ord", "segment_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return T.segments(s, d).where("status = 'complete'").select("task_id", "block_ord", "segment_ord", F.count("*").over(seen).alias("done"))


@query("win_21_latest_events", with_tables("task_events") + "SELECT id, task_id, status FROM task_events ORDER BY created_at DESC, id DESC LIMIT 200")
def win_21(s, d):
    return T.task_events(s, d).orderBy(F.desc("created_at"), F.desc("id")).limit(200).select("id", "task_id", "status")


@query("win_22_live_pairs", with_tables("segments") + "SELECT task_id, substr(source, 1, 160) AS source, substr(translation, 1, 160) AS translation FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY block_ord DESC, segment_ord DESC) AS n FROM segments WHERE status = 'complete') WHERE n <= 2")
def win_22(s, d):
    return V.last_context(T.segments(s, d), 2).select("task_id", F.substring("source", 1, 160).alias("source"), F.substring("translation", 1, 160).alias("translation"))


# Glossary and memory

_WORD = "(?i)(^|[^\\pL\\pN])' || {t} || '($|[^\\pL\\pN])"


def _stands(x: str, term: str) -> str:
    """SQL: the term stands in x as whole words; a pattern for each term is compiled once."""
    return f"regexp_matches({x}, '{_WORD.format(t=term)}')".replace("' || ", "").replace(" || '", "")


_MISSING = " UNION ALL ".join(f"SELECT document_id, ord, {t[0]} AS term_id FROM x WHERE {_stands('source', t[3])} AND NOT {_stands('translation', t[4])}" for t in T.GLOSSARY if t[2] == "ru")


@query("jn_17_missing_terms", with_tables("blocks", "translations", more="x AS (SELECT b.document_id, b.ord, b.text AS source, t.text AS translation FROM blocks b JOIN translations t ON t.document_id = b.document_id AND t.block_ord = b.ord AND t.target_lang = 'ru')") + _MISSING)
def jn_17(s, d):
    pairs = V.translated(T.blocks(s, d), T.translations(s, d), "ru").where("translation IS NOT NULL").select("document_id", "ord", F.col("text").alias("source"), "translation")
    return G.missing_terms(pairs, T.glossary(s).where("target_lang = 'ru'")).select("document_id", "ord", "term_id")


_MATCHES = " UNION ALL ".join(f"SELECT {t[0]} AS term_id, count(*) AS blocks FROM blocks WHERE {_stands('text', t[3])} HAVING count(*) > 0" for t in T.GLOSSARY)


@query("sc_22_term_matches", with_tables("blocks") + _MATCHES)
def sc_22(s, d):
    terms = T.glossary(s).select(F.col("id").alias("term_id"), F.col("source").alias("term"))
    return G.with_terms(T.blocks(s, d).select("text"), "text", terms).groupBy("term_id").agg(F.count("*").alias("blocks"))


_ALTERNATIVES = "|".join(sorted({t[3] for t in T.GLOSSARY}, key=lambda x: (-len(x), x)))


@query("sc_23_highlight", with_tables("blocks") + f"SELECT document_id, ord, regexp_replace(text, '(?i)({_ALTERNATIVES})', '<mark>\\1</mark>', 'g') AS marked FROM blocks")
def sc_23(s, d):
    """All occurrences of the terms marked, longest alternative first, whatever stands around them."""
    return T.blocks(s, d).select("document_id", "ord", G.highlighted(F.col("text"), sorted({t[3] for t in T.GLOSSARY})).alias("marked"))


_EN_RU = [(t[3], t[4]) for t in T.GLOSSARY if t[1] == "en" and t[2] == "ru"]


def _protected() -> str:
    """The longest term first: the text is split where a term stands and joined again with numbered marks; targets in their places give what comes back."""
    steps = ["p0 AS (SELECT document_id, ord, text AS t, text AS back, 0::BIGINT AS n FROM blocks WHERE lang = 'en')"]
    terms = sorted(_EN_RU, key=lambda t: -len(t[0]))
    for k, (source, target) in enumerate(terms):
        split = f"string_split_regex(t, '(?i)\\b{source}\\b')"
        joined = f"array_to_string(list_transform({split}, lambda x, i: CASE WHEN i = 1 THEN x ELSE 'TERMQ' || lpad((n + i - 2)::VARCHAR, 4, '0') || 'QX' || x END), '')"
        steps.append(f"p{k + 1} AS (SELECT document_id, ord, {joined} AS t, regexp_replace(back, '(?i)\\b{source}\\b', '{target}', 'g') AS back, n + len({split}) - 1 AS n FROM p{k})")
    return ", ".join([*steps, f"p AS (SELECT * FROM p{len(terms)})"])


@query("sc_20_protect_terms", with_tables("blocks", more=_protected()) + "SELECT document_id, ord, t AS protected, n::INTEGER AS marks, back AS restored FROM p")
def sc_20(s, d):
    """Terms as numbered marks and back; restored is null where a mark was lost."""
    return G.protected(T.blocks(s, d).where("lang = 'en'").select("document_id", "ord", "text"), _EN_RU).select("document_id", "ord", "protected", F.size("marks").alias("marks"), "restored")


@query("sc_21_restore_terms", with_tables("blocks", more=_protected()) + "SELECT document_id, ord, CASE WHEN document_id % 3 > 0 OR n = 0 THEN back END AS restored FROM p")
def sc_21(s, d):
    """Marks replaced by their terms' translations; a third of the documents have lost their first mark or have it twice, and give nothing."""
    rows = G.protected(T.blocks(s, d).where("lang = 'en'").select("document_id", "ord", "text"), _EN_RU).select("document_id", "ord", "protected", "marks")
    first = F.lit("".join((G.MARK[0], "0000", G.MARK[1])))
    spoiled = F.when(F.col("document_id") % 6 == 0, F.replace("protected", first, F.lit(""))).when(F.col("document_id") % 3 == 0, F.replace("protected", first, F.concat(first, F.lit(" "), first))).otherwise(F.col("protected"))
    return rows.select("document_id", "ord", G.restored(spoiled, F.col("marks")).alias("restored"))


@query("dml_01_add_terms", with_tables("terms", more="n AS (SELECT DISTINCT 'en' AS source_lang, 'ru' AS target_lang, trim(split_part(p_name, ' ', 1)) AS source, trim(split_part(p_name, ' ', 2)) AS target FROM part UNION SELECT source_lang, target_lang, source, target FROM terms WHERE id < 3)") + "SELECT n.* FROM n ANTI JOIN terms t USING (source_lang, target_lang, source, target)")
def dml_01(s, d):
    new = T.read(s, d, "part").select(F.lit("en").alias("source_lang"), F.lit("ru").alias("target_lang"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("source"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("target"))
    again = T.glossary(s).where("id < 3").drop("id")
    return G.add_terms(T.glossary(s), new.unionByName(again)).select("source_lang", "target_lang", "source", "target")


_TOKENS = "list_distinct(list_transform(regexp_extract_all({x}, '(\\pL{{4,}})', 1), lambda v: lower(v)))"
_MEMORY = with_tables(
    "blocks",
    "translations",
    more="m AS (SELECT row_number() OVER (ORDER BY t.updated_at DESC, b.document_id, b.ord) AS doc_id, b.text FROM translations t JOIN blocks b ON b.document_id = t.document_id AND b.ord = t.block_ord WHERE t.edited AND length(trim(t.text)) > 0 AND t.target_lang = 'ru' QUALIFY doc_id <= 200), b AS (SELECT item_id AS query_id, lower(" + _SQUEEZE.format(x="text") + ") AS q, unnest(" + _TOKENS.format(x="text") + ") AS token FROM benchmark), p AS (SELECT doc_id AS pair_id, lower(" + _SQUEEZE.format(x="text") + ") AS p, unnest(" + _TOKENS.format(x="text") + ") AS token FROM m), "
    "o AS (SELECT query_id, pair_id, count(*) AS overlap, arg_max(token, (length(token), token)) AS anchor FROM b JOIN p USING (token) WHERE q <> p GROUP BY ALL)",
)


def _confirmed(s: SparkSession, d: str) -> DataFrame:
    """The memory: the newest pairs that a person has confirmed, numbered from the newest."""
    order = Window.orderBy("n")  # over MEMORY rows
    newest = V.confirmed_pairs(T.blocks(s, d), T.translations(s, d), "ru", G.MEMORY).withColumn("n", F.monotonically_increasing_id())
    return newest.select(F.row_number().over(order).alias("pair_id"), "source")


@query("jn_18_memory_examples", _MEMORY + "SELECT query_id, pair_id, overlap, anchor, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, pair_id) AS place FROM o) WHERE place <= 3")
def jn_18(s, d):
    queries = T.read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return G.memory_examples(queries, _confirmed(s, d))


@query("ord_12_memory_order", _MEMORY + "SELECT query_id, max(overlap) AS best, count(*) AS candidates FROM o GROUP BY query_id")
def ord_12(s, d):
    queries = T.read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return G.overlaps(queries, _confirmed(s, d)).groupBy("query_id").agg(F.max("overlap").alias("best"), F.count("*").alias("candidates"))


# Model output

_OUT = """CASE (document_id + ord) % 12 WHEN 0 THEN text WHEN 1 THEN concat('«', substr(text, 1, 50), '»') WHEN 2 THEN concat(substr(text, 1, 120), chr(10), 'Перевод строки здесь') WHEN 3 THEN concat('[Translation]', chr(10), 'Готовый текст')
WHEN 4 THEN '**Note**' WHEN 5 THEN '<think>abc</think> ответ один' WHEN 6 THEN '<think>open' WHEN 7 THEN 'Привет 漢字漢字 мир' WHEN 8 THEN '' WHEN 9 THEN concat('Слово слово слово ', substr(text, 1, 20)) WHEN 10 THEN '"Текст перевода"' ELSE concat(substr(text, 1, 8), ' перевод текста(абв) . и так') END"""
_CODE = "CASE ord % 4 WHEN 0 THEN 'ru' WHEN 1 THEN 'de' WHEN 2 THEN 'ja' ELSE 'zh' END"
_OUTS = with_tables("blocks", more=f"outs AS (SELECT document_id, ord, text AS source, {_OUT} AS output, {_CODE} AS code FROM blocks)")


def _outs(s: SparkSession, d: str) -> DataFrame:
    """Model outputs of all blocks with their whole sources."""
    return T.blocks(s, d).select("document_id", "ord", F.col("text").alias("source"), F.expr(_OUT).alias("output"), F.expr(_CODE).alias("code"))


def _column(name: str, alias: str, make, sql: str | None, more: str = "") -> None:
    """A query of one derived column over the model outputs."""

    def run(s: SparkSession, d: str) -> DataFrame:
        return _outs(s, d).select("document_id", "ord", make(F.col("output"), F.col("source"), F.col("code")).alias(alias))

    query(name, None if sql is None else _OUTS + more + f"SELECT document_id, ord, {sql} AS {alias} FROM outs")(run)


_o, _s = "output", "source"
_same = lambda a, b: f"({_SQUEEZE.format(x=f'lower({a})')} <> '' AND {_SQUEEZE.format(x=f'lower({a})')} = {_SQUEEZE.format(x=f'lower({b})')})"


def _collapse(x: str) -> str:
    words = f"string_split({_SQUEEZE.format(x=x)}, ' ')"
    return f"array_to_string(list_transform(list_filter(list_zip({words}, list_prepend(NULL, {words})), lambda z: z[1] IS NOT NULL AND (z[2] IS NULL OR lower(z[1]) <> lower(z[2]))), lambda z: z[1]), ' ')"


def _echo(a: str, b: str) -> str:
    return f"({_same(a, b)} OR ({_collapse(b)} <> '' AND lower({_collapse(a)}) = lower({_collapse(b)})))"


_reason = f"CASE WHEN contains({_o}, '</think>') THEN list_last(string_split({_o}, '</think>')) WHEN contains({_o}, '<think>') THEN '' ELSE {_o} END"
_column("sc_30_reasoning", "clean", lambda o, s, c: C.without_reasoning(o), _STRIP.format(x=f"regexp_replace({_reason}, '<\\|[a-z_]+\\|>', '', 'g')"))
_UPTO = "strpos(translate({x}, '］】', ']]'), ']')"
_INNER = _SQUEEZE.format(x="substr({x}, 2, greatest(" + _UPTO + " - 2, 0))")
_LABEL = "(left({x}, 1) IN ('[', '［', '【') AND " + _UPTO + " > 0 AND length(" + _INNER + ") BETWEEN 1 AND 40 AND translate(" + _INNER + ", '.!?…。！？', '') = " + _INNER + ")"
_BODY = "CASE WHEN " + _LABEL + " THEN " + _STRIP.format(x="substr({x}, " + _UPTO + " + 1)") + " ELSE {x} END"
_STRIPPED = f"list_transform(string_split({_o}, chr(10)), lambda y: {_STRIP.format(x='y')})"
_column("sc_31_bare_headers", "has_header", lambda o, s, c: C.has_bare_header(o), f"len(list_filter({_STRIPPED}, lambda x: {_LABEL.format(x='x')} AND {_BODY.format(x='x')} = '')) > 0")
_bodies = f"list_transform({_STRIPPED}, lambda x: {{'label': {_LABEL.format(x='x')}, 'body': {_BODY.format(x='x')}}})"
_column("sc_31_without_headers", "clean", lambda o, s, c: C.without_headers(o), f"CASE WHEN len(list_filter({_bodies}, lambda b: b.body <> '')) > 0 THEN {_STRIP.format(x=f'array_to_string(list_transform(list_filter({_bodies}, lambda b: NOT (b.label AND b.body = ' + chr(39) * 2 + ')), lambda b: b.body), chr(10))')} ELSE {_STRIP.format(x=_o)} END")
_starred = "length(x) - length(ltrim(x, '*')) BETWEEN 1 AND 3 AND length(x) - length(rtrim(x, '*')) BETWEEN 1 AND 3 AND length({i}) BETWEEN 1 AND 80 AND len(string_split({i}, ' ')) <= 8 AND translate(trim(x, '*'), '*.!?…', '') = trim(x, '*')".format(i=_SQUEEZE.format(x="trim(x, '*')"))
_column("sc_37_emphasis_label", "label", lambda o, s, c: C.has_emphasis_label(o), f"len(list_filter({_STRIPPED}, lambda x: {_starred})) > 0")
_column("sc_39_same_text", "same", lambda o, s, c: C.same_text(o, s), _same(_o, _s))
_column("sc_39_collapsed", "collapsed", lambda o, s, c: C.collapsed(o), _collapse(_o))
_column("sc_39_repeats_source", "repeats", lambda o, s, c: C.repeats_source(o, s), f"{_echo(_o, _s)} OR (length({_SQUEEZE.format(x=f'lower({_s})')}) >= 8 AND contains({_SQUEEZE.format(x=f'lower({_o})')}, {_SQUEEZE.format(x=f'lower({_s})')}))")
_quoted = "(length({x}) >= 2 AND (" + " OR ".join(f"(starts_with({{x}}, '{a}') AND ends_with({{x}}, '{b}'))" for a, b in C.QUOTES) + "))"
_column("sc_40_quoted", "quoted", lambda o, s, c: C.is_quoted(o), _quoted.format(x=_STRIP.format(x=_o)))
_inner = _STRIP.format(x=f"substr({_STRIP.format(x=_o)}, 2, greatest(length({_STRIP.format(x=_o)}) - 2, 0))")
_unwrap = (
    f"CASE WHEN length({_STRIP.format(x=_o)}) < 2 THEN {_STRIP.format(x=_o)} "
    + " ".join(
        f"WHEN starts_with({_STRIP.format(x=_o)}, '{a}') AND ends_with({_STRIP.format(x=_o)}, '{b}') THEN CASE WHEN {_inner} = '' OR "
        + (f"length({_STRIP.format(x=_o)}) - length(replace({_STRIP.format(x=_o)}, '{a}', '')) <> 2" if a == b else f"contains({_inner}, '{a}') OR contains({_inner}, '{b}')")
        + f" THEN {_STRIP.format(x=_o)} ELSE {_inner} END"
        for a, b in C.QUOTES
    )
    + f" ELSE {_STRIP.format(x=_o)} END"
)
_column("sc_40_added_quotes", "clean", lambda o, s, c: C.without_added_quotes(o, s), f"CASE WHEN {_quoted.format(x=_STRIP.format(x=_s))} THEN {_o} ELSE {_unwrap} END")
_lines = f"string_split({_STRIP.format(x=_o)}, chr(10))"
_full = f"list_filter({_lines}, lambda x: trim(x) <> '')"
_gone = f"len(list_filter({_full}, lambda x: {_echo('trim(x)', _s)}))"
_column("sc_41_echoed_lines", "clean", lambda o, s, c: C.without_echoed_source(o, s), f"CASE WHEN {_STRIP.format(x=_s)} = '' OR len({_full}) < 2 OR {_gone} = 0 OR {_gone} = len({_full}) THEN {_STRIP.format(x=_o)} ELSE {_STRIP.format(x=f'array_to_string(list_filter({_lines}, lambda x: NOT {_echo(chr(116) + "rim(x)", _s)}), chr(10))')} END")
_column("sc_42_leaks", "leaks", lambda o, s, c: C.leaks(o, F.array(F.substring(s, 1, 30))), f"length({_SQUEEZE.format(x='substr(source, 1, 30)')}) >= 4 AND len(list_filter(string_split({_o}, chr(10)), lambda x: starts_with(lower({_SQUEEZE.format(x='x')}), lower({_SQUEEZE.format(x='substr(source, 1, 30)')})))) > 0")


def _n(script: str, x: str) -> str:
    return f"len(regexp_extract_all({x}, '{S.SCRIPTS[script]}'))"


def _sum(x: str, names=tuple(S.SCRIPTS)) -> str:
    return "(" + (" + ".join(_n(k, x) for k in names) or "0") + ")"


_TARGETS = {"ru": ("cyrillic",), "de": ("latin",), "ja": ("kana", "han"), "zh": ("han",)}
_fits = f"CASE WHEN {_sum(_o)} < 2 THEN true WHEN code = 'zh' AND {_n('kana', _o)} > {_n('han', _o)} THEN false ELSE 2 * (CASE code " + " ".join(f"WHEN '{k}' THEN {_sum(_o, v)}" for k, v in _TARGETS.items()) + f" END) >= {_sum(_o)} END"
_ok = {k: "(" + " OR ".join([f"{_n(k, _s)} > 0", *[f"code = '{c}'" for c, v in _TARGETS.items() if k in v]]) + ")" for k in S.SCRIPTS}
_intr = f"CASE WHEN {_sum(_o)} < 2 THEN false ELSE " + " OR ".join(f"({_n(k, _o)} > 0 AND NOT {_ok[k]}" + ("" if k in ("han", "kana", "hangul") else f" AND 2 * {_n(k, _o)} >= {_sum(_o)}") + ")" for k in S.SCRIPTS) + " END"
_column("sc_52_script_fits", "fits", lambda o, s, c: S.fits(o, c), _fits)
_column("sc_53_intrusion", "intrusion", lambda o, s, c: S.intrusion(o, s, c), _intr)
_leaked = f"(length({_SQUEEZE.format(x='prev')}) >= 4 AND len(list_filter(string_split({_o}, chr(10)), lambda x: starts_with(lower({_SQUEEZE.format(x='x')}), lower({_SQUEEZE.format(x='prev')})))) > 0)"
_header = f"len(list_filter({_STRIPPED}, lambda x: {_LABEL.format(x='x')} AND {_BODY.format(x='x')} = '')) > 0"
_scaffold = "(" + " OR ".join(f"contains(lower({_o}), '{x}')" for x in C.SCAFFOLD) + ")"
_missed = f"{_STRIP.format(x=_o)} = '' OR {_echo(_o, _s)} OR len(list_filter({_STRIPPED}, lambda x: {_starred})) > 0 OR {_header} OR {_scaffold} OR coalesce({_leaked}, false) OR ({_intr}) OR NOT ({_fits})"


_SAYS = _DIALOG.replace("reply, CASE", "reply AS output, CASE")


@query("flt_18_chat_context", with_tables("turns", more=_SAYS) + f"SELECT dialog_id, turn FROM (SELECT dialog_id, turn, row_number() OVER (PARTITION BY dialog_id ORDER BY turn DESC) AS k FROM q WHERE len(regexp_extract_all(source, '\\p{{L}}{{2,}}')) >= 4 AND NOT ({_echo(_o, _s)} OR (length({_SQUEEZE.format(x=f'lower({_s})')}) >= 8 AND contains({_SQUEEZE.format(x=f'lower({_o})')}, {_SQUEEZE.format(x=f'lower({_s})')}))) AND CASE WHEN {_sum(_o)} < 2 THEN true ELSE 2 * {_n('latin', _o)} >= {_sum(_o)} END) WHERE k <= 2")
def flt_18(s, d):
    """Pairs that may stand beside a new text of four words or more."""
    rows = _pairs(s, d).where(F.regexp_count(F.col("source"), F.lit(r"\p{L}{2,}")) >= 4)
    rows = rows.where(~C.repeats_source(F.col("translation"), F.col("source")) & S.fits(F.col("translation"), F.lit("en")))
    newest = Window.partitionBy("dialog_id").orderBy(F.desc("turn"))
    return rows.withColumn("k", F.row_number().over(newest)).where("k <= 2").select("dialog_id", "turn")


@query("sc_44_missed", _OUTS.rstrip() + ", w AS (SELECT *, lag(output) OVER (PARTITION BY document_id ORDER BY ord) AS prev FROM outs) " + f"SELECT document_id, ord, {_missed} AS missed FROM w")
def sc_44(s, d):
    """Answers that say nothing, with the answer before as what they mustn't repeat."""
    before = F.array_compact(F.array(F.lag("output").over(Window.partitionBy("document_id").orderBy("ord"))))
    rows = _outs(s, d).withColumn("previous", before)
    return rows.select("document_id", "ord", C.missed(F.col("output"), F.col("source"), F.col("code"), F.col("previous")).alias("missed"))


_QUOTED = (
    f"list_reduce(list_prepend({{'open': false, 'out': ''}}, list_transform(range(1, length({_o})::BIGINT + 1), lambda i: {{'open': false, 'out': substr({_o}, i, 1)}})), lambda a, x: "
    "{'open': CASE WHEN x.out IN ('«', '„') OR x.out IN ('\"', '“') AND NOT a.open THEN true WHEN x.out IN ('»', '”', '\"', '“') THEN false ELSE a.open END, "
    "'out': a.out || CASE WHEN x.out IN ('«', '„') OR x.out IN ('\"', '“') AND NOT a.open THEN '«' WHEN x.out IN ('»', '”', '\"', '“') THEN '»' ELSE x.out END}).out"
)
_prose = _QUOTED
for _where, _instead in (("«([,.;:!?…»)(—–-]|$)", "»\\1"), ("[ \\t]+([,.;:!?…»])", "\\1"), ("([,.;:!?])\\s*,", "\\1"), ("«[ \\t]+", "«"), ("([.!?…»])\\(", "\\1 (")):
    _prose = f"regexp_replace({_prose}, '{_where}', '{_instead}', 'g')"
_column("sc_38_polished", "clean", lambda o, s, c: C.polished(C.paired_quotes(o), F.lit("ru")), _prose)
_column("sc_50_target_scripts", "scripts", lambda o, s, c: F.array_join(F.array_sort(S.target_scripts(c)), ","), "CASE code " + " ".join(f"WHEN '{k}' THEN '{','.join(sorted(v))}'" for k, v in _TARGETS.items()) + " END")
_column("sc_51_allowed_scripts", "scripts", lambda o, s, c: F.array_join(F.array_sort(S.allowed_scripts(s, c)), ","), "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {_ok[k]} THEN '{k}' END" for k in S.SCRIPTS) + "], lambda x: x IS NOT NULL)), ',')")


_left = _o
for _k, _v in S.SCRIPTS.items():
    _left = f"regexp_replace({_left}, CASE WHEN {_ok[_k]} OR {_n(_k, _o)} = 0 THEN '[^\\x{{0}}-\\x{{10FFFF}}]' ELSE '{_v}' END, '', 'g')"
_foreign = "(" + " + ".join(f"CASE WHEN {_ok[k]} THEN 0 ELSE {_n(k, _o)} END" for k in S.SCRIPTS) + ")"


@query("sc_54_without_foreign", _OUTS + f"SELECT document_id, ord, CASE WHEN ({_intr}) AND 2 * {_foreign} < {_sum(_o)} THEN trim(regexp_replace(regexp_replace({_left}, '[ \\t]{{2,}}', ' ', 'g'), ' +([,.;:!?…])', '\\1', 'g')) ELSE {_o} END AS clean FROM outs")
def sc_54(s, d):
    return S.with_foreign_removed(_outs(s, d), "output", "source", "code", "clean").select("document_id", "ord", "clean")


@query("sc_43_finished")
def sc_43(s, d):
    before = F.array_compact(F.array(F.lag("output").over(Window.partitionBy("document_id").orderBy("ord"))))
    return C.with_finished(_outs(s, d).withColumn("previous", before), "output", "source", "code", "clean", "previous").select("document_id", "ord", "clean")


_GRAMS = "unnest(list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3))) AS g"
_FOLD = _SQUEEZE.format(x="lower(text)")


@query(
    "sc_55_language_profiles",
    f"WITH d AS (SELECT doc_id, lang, {_FOLD} AS c FROM documents), k AS (SELECT lang, g, count(*) AS n FROM (SELECT lang, {_GRAMS} FROM d WHERE doc_id % 5 <> 0) GROUP BY lang, g), "
    "v AS (SELECT count(DISTINCT g) AS v FROM k), t AS (SELECT lang, sum(n) + any_value(v) AS total FROM k, v GROUP BY lang), "
    f"p AS (SELECT g, t.lang, ln((coalesce(n, 0) + 1)::DOUBLE / total) AS p FROM (SELECT DISTINCT g FROM k) u CROSS JOIN t LEFT JOIN k USING (g, lang)), q AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, {_GRAMS} FROM d WHERE doc_id % 5 = 0) GROUP BY doc_id, g), "
    "s AS (SELECT doc_id, p.lang, sum(n * p) AS s FROM q JOIN p USING (g) GROUP BY doc_id, p.lang), b AS (SELECT doc_id, max_by(lang, s) AS language FROM s GROUP BY doc_id) "
    "SELECT d.doc_id, b.language, coalesce(b.language = d.lang, false) AS hit FROM d LEFT JOIN b USING (doc_id) WHERE d.doc_id % 5 = 0",
)
def sc_55_profiles(s, d):
    """Profiles from four fifths of the documents, languages of the rest."""
    docs = T.read(s, d, "documents").select("doc_id", "lang", "text")
    asked = docs.where("doc_id % 5 = 0")
    found = L.detected(asked, "doc_id", "text", L.profiles(docs.where("doc_id % 5 <> 0"), "lang", "text"))
    return found.join(asked.select("doc_id", "lang"), "doc_id").select("doc_id", "language", F.coalesce(F.col("language") == F.col("lang"), F.lit(False)).alias("hit"))


@query("ag_12_script_histogram", with_tables("docs") + "SELECT document_id, " + ", ".join(f"{_n(k, 'text')}::INTEGER AS {k}" for k in S.SCRIPTS) + " FROM docs")
def ag_12(s, d):
    return T.documents(s, d).select("document_id", *[S.count(F.col("text"), k).alias(k) for k in S.SCRIPTS])


@query("ag_13_context_repetition", with_tables("blocks", more="c AS (SELECT document_id, ord, text, lag(text) OVER (PARTITION BY document_id ORDER BY ord) AS before FROM blocks), q AS (SELECT document_id, ord, " + _SQUEEZE.format(x="text") + " AS o, coalesce(" + _SQUEEZE.format(x="before") + ", '') AS h FROM c), p AS (SELECT *, list_filter(list_transform(string_split_regex(o, '[.!?…]+'), lambda x: trim(x)), lambda x: length(x) >= 40) AS l FROM q)") + "SELECT document_id, ord, length(o) >= 80 AND length(h) >= 80 AND (contains(h, substr(o, 1, 120)) OR (len(list_filter(l, lambda x: contains(h, x))) >= 1 AND 2 * len(list_filter(l, lambda x: contains(h, x))) >= len(l))) AS repeats FROM p")
def ag_13(s, d):
    before = F.coalesce(F.lag("text").over(Window.partitionBy("document_id").orderBy("ord")), F.lit(""))
    return T.blocks(s, d).withColumn("before", before).select("document_id", "ord", C.repeats_context(F.col("text"), F.col("before")).alias("repeats"))


@query("sc_45_repeats_context", with_tables("turns", more="c AS (SELECT dialog_id, turn, text, lag(text) OVER (PARTITION BY dialog_id ORDER BY turn) AS before FROM turns), q AS (SELECT dialog_id, turn, " + _SQUEEZE.format(x="text") + " AS o, coalesce(" + _SQUEEZE.format(x="before") + ", '') AS h FROM c)") + "SELECT dialog_id, turn, length(o) >= 80 AND length(h) >= 80 AND contains(h, substr(o, 1, 120)) AS repeats FROM q")
def sc_45(s, d):
    before = F.coalesce(F.lag("text").over(Window.partitionBy("dialog_id").orderBy("turn")), F.lit(""))
    return T.turns(s, d).withColumn("before", before).select("dialog_id", "turn", C.repeats_context(F.col("text"), F.col("before")).alias("repeats"))


@query("sc_55_language_guess", with_tables("docs") + "SELECT document_id, CASE WHEN " + _n("cyrillic", "substr(text, 1, 4000)") + " > 0 THEN 'ru' WHEN " + _n("latin", "substr(text, 1, 4000)") + " > 0 THEN 'latin' END AS guess FROM docs")
def sc_55(s, d):
    """Without a model the script histogram of a sample stands in for language detection."""
    sample = F.substring("text", 1, 4000)
    return T.documents(s, d).select("document_id", F.when(S.count(sample, "cyrillic") > 0, "ru").when(S.count(sample, "latin") > 0, "latin").alias("guess"))
