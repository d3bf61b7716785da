"""The pipeline end to end with the stub in place of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import segments as P
from foliospark.operators import translate as R
from foliospark.operators import views as V
from foliospark.plans.registry import query
from foliospark.plans.texts import PACK
from foliospark.sources import importers as I
from foliospark.sources import sinks as K
from foliospark.sources import tables as T
from foliospark.sources.tables import with_tables


def _calls(s: SparkSession, d: str) -> DataFrame:
    """The answers of all packs, with the places of their segments."""
    return R.call(R.pack_requests(P.whole_packs(V.whole_blocks(T.segments(s, d)), 500)))


@query("udf_01_translate", with_tables("segments") + "SELECT task_id, block_ord, segment_ord, array_to_string(list_reverse(string_split(source, ' ')), ' ') AS translation FROM segments")
def udf_01(s, d):
    return P.zip_parts(_calls(s, d)).select("task_id", "block_ord", "segment_ord", "translation")


_BACK = "concat('*[Background]*', chr(10), 'About an old mill.', chr(10), '*[Source text]*', chr(10), source)"


def _forgetful(text: str) -> str:
    """A model that gives every second prompt with a background back as it is."""
    return text if text.startswith("*[") and len(text) % 2 == 0 else stub_line(text)


def stub_line(text: str) -> str:
    return R.stub(text.rpartition("\n")[2])


@query("udf_03_attempts", with_tables("segments") + f"SELECT task_id, block_ord, segment_ord, array_to_string(list_reverse(string_split(source, ' ')), ' ') AS output, CASE WHEN task_id % 2 = 0 AND length({_BACK}) % 2 = 0 THEN 2 ELSE 1 END AS attempts FROM segments")
def udf_03(s, d):
    """Answers that repeat their prompt are asked for again without background."""
    rows = T.segments(s, d).withColumns({"supplied": F.col("task_id") % 2 == 0, "bare": F.col("source"), "code": F.lit("de"), "previous": F.array().cast("array<string>")})
    rows = rows.withColumn("request", F.when(F.col("supplied"), F.expr(_BACK.replace("chr(10)", "char(10)"))).otherwise(F.col("source")))
    return R.attempted(rows.select("task_id", "block_ord", "segment_ord", "request", "bare", "source", "code", "previous", "supplied"), _forgetful).select("task_id", "block_ord", "segment_ord", "output", "attempts")


@query("pipeline_b_reassembled", with_tables("segments") + "SELECT task_id, block_ord, string_agg(array_to_string(list_reverse(string_split(source, ' ')), ' '), '' ORDER BY segment_ord) AS text FROM segments GROUP BY ALL")
def pipeline_b(s, d):
    return V.assembled(P.zip_parts(_calls(s, d)), "translation")


_PACKED = PACK.format(whole="segment_ord = 0 AND count(*) OVER (PARTITION BY task_id, block_ord) = 1", where="", most=500)
_NARRATIVE = (
    "a AS (SELECT k.task_id, k.pack, count(*) AS count, string_agg(array_to_string(list_reverse(string_split(s.source, ' ')), ' '), chr(10) || chr(10) ORDER BY k.block_ord, k.segment_ord) AS output FROM k JOIN segments s ON s.task_id = k.task_id AND s.block_ord = k.block_ord AND s.segment_ord = k.segment_ord GROUP BY k.task_id, k.pack), "
    "r AS (SELECT task_id, pack, 1 AS n, CASE WHEN count >= 5 THEN 0 ELSE count END AS done, CASE WHEN count >= 5 THEN '' ELSE trim(output) END AS fresh, CASE WHEN count >= 5 THEN left(trim(regexp_replace(' ' || left(trim(output), 40), '\\s+', ' ', 'g')), 900) ELSE '' END AS narrative, count >= 5 AS due FROM a WHERE pack = 0 UNION ALL "
    "SELECT task_id, pack, n, CASE WHEN due THEN 0 ELSE now END, CASE WHEN due THEN '' ELSE text END, CASE WHEN due THEN left(trim(regexp_replace(narrative || ' ' || left(text, 40), '\\s+', ' ', 'g')), 900) ELSE narrative END, due FROM "
    "(SELECT a.task_id, a.pack, r.n + 1 AS n, r.done + a.count AS now, right(CASE WHEN r.fresh = '' THEN trim(a.output) ELSE r.fresh || chr(10) || trim(a.output) END, 1600) AS text, r.narrative, r.done + a.count >= 5 AS due FROM r JOIN a ON a.task_id = r.task_id AND a.pack = r.pack + 1)) "
)


@query("udf_04_narrative_due", with_tables("segments", more=f"{_PACKED}, {_NARRATIVE}", recursive=True) + "SELECT task_id, pack, due, narrative FROM r")
def udf_04(s, d):
    return R.narratives(_calls(s, d).select("task_id", "pack", "count", "output"), every=5)


@query("src_02_decoded", "SELECT doc_id, 'utf-8' AS encoding, text FROM documents")
def src_02(s, d):
    rows = T.read(s, d, "documents").select("doc_id", F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")).alias("content"))
    return I.decoded(rows, "content").select("doc_id", "encoding", "text")


@query("src_01_routes", with_tables("docs") + "SELECT document_id, regexp_extract(lower(name), '(\\.[a-z]+)$', 1) AS suffix, regexp_extract(lower(name), '(\\.[a-z]+)$', 1) IN ('.txt', '.md', '.markdown', '.docx', '.epub', '.pdf') AS supported FROM docs")
def src_01(s, d):
    return I.routes(T.documents(s, d).select("document_id", "name", F.length("text").cast("long").alias("length"))).select("document_id", "suffix", "supported")


def _archived(s: SparkSession, d: str, form: str) -> DataFrame:
    """The exported pieces as files of a kind, read again."""
    pieces = K.pieces(V.translated(T.blocks(s, d), T.translations(s, d), "ru"))
    made = K.as_zip(pieces, form).select(F.concat(F.col("document_id").cast("string"), F.lit(f".{form}")).alias("path"), "content")
    back = I.import_archives(made)
    return back.select(F.regexp_extract("file", r"^(\d+)", 1).cast("long").alias("document_id"), "ord", "kind", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_PIECES = with_tables("blocks", "translations", more="t AS (SELECT b.document_id, b.ord, b.kind, CASE WHEN b.translatable THEN coalesce(t.text, b.text) ELSE b.text END AS final FROM blocks b LEFT JOIN translations t ON t.document_id = b.document_id AND t.block_ord = b.ord AND t.target_lang = 'ru'), p AS (SELECT document_id, ord, CASE WHEN kind = 'heading' THEN 'heading' ELSE 'paragraph' END AS kind, trim(final) AS text FROM t WHERE kind <> 'gap' AND trim(final) <> '')") + "SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY ord) - 1)::INTEGER AS ord, kind, md5(text) AS text_md5 FROM p"


@query("src_05_docx_round_trip", _PIECES)
def src_05(s, d):
    """Word-processor files: written, then imported."""
    return _archived(s, d, "docx")


@query("src_06_epub_round_trip", _PIECES)
def src_06_epub(s, d):
    """E-books: written, then imported."""
    return _archived(s, d, "epub")


@query("src_06_page_blocks")
def src_06(s, d):
    """Blocks of marked-up pages."""
    return I.page_blocks(T.read(s, d, "pages").select("page_id", "html"))
