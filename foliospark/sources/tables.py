"""The document model as DataFrames over the supplied tables.

documents and their lines stand for documents and blocks, orders and lineitem for tasks and segments, events for
the task log, conversations for dialogs, part for the model catalogue, customer for projects. Each
derived column is a pair of expressions, one for Spark and one for DuckDB (one string where both read it), so
queries and their SQL twins start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Pair = str | tuple[str, str]

LANGS = ("en", "ru", "de", "fr", "ja", "zh")
STATUSES = ("queued", "running", "paused", "cancelled", "interrupted", "failed", "complete")


def pick(x: str, values: tuple[str, ...]) -> str:
    """SQL that picks one of the values by x modulo their number."""
    return f"CASE {x} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(base: str, n: str, unit: str = "DAY") -> tuple[str, str]:
    spark = {"DAY": f"make_dt_interval(CAST({n} AS INT))", "HOUR": f"make_dt_interval(0, CAST({n} AS INT))"}[unit]
    duck = {"DAY": f"to_days(CAST({n} AS INTEGER))", "HOUR": f"to_hours(CAST({n} AS INTEGER))"}[unit]
    return f"{base} + {spark}", f"{base} + {duck}"


_NAME = "concat('file-', CAST({d} AS STRING), " + pick("{d}", (".txt", ".md", ".docx", ".epub", ".pdf")) + ")"

TASK: dict[str, Pair] = {
    "task_id": "o_orderkey",
    "document_id": "o_custkey % 200",
    "project_id": "o_custkey % 20",
    "document_name": _NAME.format(d="(o_custkey % 200)"),
    "status": pick("o_orderkey", STATUSES),
    "model_id": "concat('m', CAST(o_orderkey % 5 AS STRING))",
    "source_lang": pick("(o_orderkey + o_custkey)", ("en", "auto", "de")),
    "target_lang": pick("o_orderkey", LANGS),
    "created_at": "o_orderdate",
    "updated_at": (f"CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE {_days('o_orderdate', 'o_orderkey % 5')[0]} END", f"CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE {_days('o_orderdate', 'o_orderkey % 5')[1]} END"),
}
EXPORT: dict[str, Pair] = {
    "id": "o_orderkey",
    "document_id": "o_custkey % 200",
    "path": "concat('/out/', CAST(o_orderkey AS STRING), " + pick("o_orderkey", (".pdf", ".md", ".docx", ".txt")) + ")",
    "format": pick("o_orderkey", ("pdf", "md", "docx", "txt")),
    "target_lang": pick("o_orderkey", LANGS),
    "task_id": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey END",
    "created_at": _days("o_orderdate", "2"),
}
SEGMENT: dict[str, Pair] = {
    "task_id": "l_orderkey",
    "block_ord": "CAST(floor(rn / 2) AS INT)",
    "segment_ord": "CAST(rn % 2 AS INT)",
    "source": "concat('Segment ', l_returnflag, repeat(' word', CAST(l_quantity AS INT)))",
    "translation": "CASE WHEN l_linestatus = 'F' THEN concat('T', CAST(l_partkey AS STRING), repeat(' slovo', CAST(floor(l_quantity / 5) AS INT))) ELSE '' END",
    "status": "CASE WHEN l_linestatus = 'F' THEN 'complete' ELSE 'pending' END",
    "kind": "CASE WHEN l_partkey % 6 = 0 THEN 'heading' ELSE 'paragraph' END",
}
MODEL: dict[str, Pair] = {
    "model_id": "concat('model-', CAST(p_partkey % 1500 AS STRING))",
    "filename": "concat(replace(p_name, ' ', '-'), '-', " + pick("p_size", ("Q4_K_M", "Q5_K_M", "Q6_K", "Q8_0", "F16", "mmproj")) + ", CASE WHEN p_size % 7 = 0 THEN '-1-of-2' ELSE '' END, '.gguf')",
    "registry": pick("p_partkey", ("builtin", "market", "custom")),
    "repo": "concat('org-', CAST(p_partkey % 40 AS STRING))",
    "size_bytes": "CAST(p_size AS BIGINT) * 200000000",
    "estimated_ram_gb": "p_size * 0.5D",
    "estimated_vram_gb": "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size * 0.375D END",
    "layer_count": "p_size + 8",
    "status": "CASE WHEN p_partkey % 5 = 0 THEN 'retired' ELSE 'available' END",
    "digest": "CASE WHEN p_partkey % 9 = 0 THEN 'none' ELSE sha2(p_name, 256) END",
}
MODEL = {k: (v, v.replace("0.5D", "0.5::DOUBLE").replace("0.375D", "0.375::DOUBLE").replace("sha2(p_name, 256)", "sha256(p_name)")) if isinstance(v, str) else v for k, v in MODEL.items()}
PROJECT: dict[str, Pair] = {
    "project_id": "c_custkey",
    "title": "c_name",
    "source_lang": pick("c_custkey", ("en", "auto", "fr")),
    "lang_a": pick("c_custkey", LANGS),
    "lang_b": pick("(c_custkey + 3)", LANGS),
    "updated_at": _days("TIMESTAMP '2026-01-01 00:00:00'", "c_custkey % 90"),
}
OCR: dict[str, Pair] = {
    "page": "CAST(p_partkey % 40 AS INT)",
    "idx": "p_partkey",
    "text": "CASE WHEN p_size % 8 = 0 THEN CAST(p_partkey AS STRING) WHEN p_size % 8 = 1 THEN concat(p_name, '-') ELSE p_name END",
    "x0": "CAST((p_size * 13) % 300 AS INT)",
    "y0": "CAST(floor(p_partkey / 40) * 15 + p_size % 12 AS INT)",
    "x1": "CAST((p_size * 13) % 300 + 90 AS INT)",
    "y1": "CAST(floor(p_partkey / 40) * 15 + p_size % 12 + 12 AS INT)",
}
GLYPH: dict[str, Pair] = {
    "page": "CAST(floor(p_partkey / 2) % 30 AS INT)",
    "idx": "p_partkey",
    "text": "p_name",
    "x0": "CAST((p_partkey % 2) * 300 + 40 + (p_size % 5) * 6 AS DOUBLE)",
    "x1": "CAST((p_partkey % 2) * 300 + 240 AS DOUBLE)",
    "baseline": "CAST(700 - floor(p_partkey / 60) * 16 - (p_size % 3) * 4 AS DOUBLE)",
    "size": "CAST(10 + (p_size % 4) * 0.5 AS DOUBLE)",
    "font": pick("p_size", ("Book", "Chrome", "Book-Italic")),
    "page_width": "CAST(600 AS DOUBLE)",
}
#: Our own terms; fixed values.
GLOSSARY = [(1, "en", "ru", "the", "т"), (2, "en", "ru", "that", "то"), (3, "en", "ru", "of the", "из"), (4, "en", "de", "the", "das"), (5, "de", "ru", "und", "и"), (6, "fr", "ru", "de la", "от"), (7, "en", "ru", "worthless", "пустой"), (8, "en", "ru", "are", "есть")]


def _spark(columns: dict[str, Pair]) -> list:
    return [F.expr(v if isinstance(v, str) else v[0]).alias(k) for k, v in columns.items()]


def _duck(columns: dict[str, Pair]) -> str:
    return ", ".join(f"{v if isinstance(v, str) else v[1]} AS {k}" for k, v in columns.items())


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(*_spark(TASK))


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(*_spark(EXPORT))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return read(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(order) - 1).select(*_spark(SEGMENT))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(*_spark(MODEL))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(*_spark(PROJECT))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(*_spark(OCR))


def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(*_spark(GLYPH))


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GLOSSARY, "id int, source_lang string, target_lang string, source string, target string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 20).alias("project_id"), F.expr(_NAME.format(d="doc_id")).alias("name"), F.expr(_days("TIMESTAMP '2026-01-01 00:00:00'", "doc_id % 300", "HOUR")[0]).alias("created_at"), "lang", "text")


_KIND = "CASE WHEN trim(text) = '' THEN 'gap' WHEN length(text) <= 40 THEN 'heading' WHEN ord % 10 = 9 THEN 'code' ELSE 'paragraph' END"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block for each line: short lines are headings, every tenth is code, blank ones are gaps."""
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return lines.withColumn("kind", F.expr(_KIND)).withColumn("translatable", F.col("kind").isin("heading", "paragraph"))


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations of two thirds of the blocks into two languages; some are blank, some edited."""
    langs = F.explode(F.array(F.lit("ru"), F.lit("de"))).alias("target_lang")
    rows = blocks(spark, sf_dir).select("document_id", "ord", langs, "text").withColumn("n", F.col("document_id") + F.col("ord") + F.when(F.col("target_lang") == "ru", 0).otherwise(1))
    return rows.where("n % 3 <> 0").select(
        "document_id",
        F.col("ord").alias("block_ord"),
        "target_lang",
        F.when(F.expr("n % 7 = 0"), "  ").otherwise(F.concat(F.lit(">"), F.substring("text", 1, 60))).alias("text"),
        F.expr("(document_id + ord * 2) % 4 = 1").alias("edited"),
        F.expr(_days("TIMESTAMP '2026-01-01 00:00:00'", "(document_id * 7 + ord) % 500", "HOUR")[0]).alias("updated_at"),
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr(pick("event_id", STATUSES))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), status.alias("status"), F.col("props").alias("message"), F.col("ts").alias("created_at"), F.col("value"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialog turns; the assistant's role is called model."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("dialog_id"), "turn", F.when(F.col("role") == "assistant", "model").otherwise(F.col("role")).alias("role"), "text")


_TS = "TIMESTAMP '2026-01-01 00:00:00'"
#: DuckDB's version of the tables above.
CTE = {
    "tasks": f"SELECT {_duck(TASK)} FROM orders",
    "exports": f"SELECT {_duck(EXPORT)} FROM orders WHERE o_orderkey % 3 = 0",
    "segments": f"SELECT {_duck(SEGMENT)} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS rn FROM lineitem)",
    "models": f"SELECT {_duck(MODEL)} FROM part",
    "projects": f"SELECT {_duck(PROJECT)} FROM customer",
    "ocr": f"SELECT {_duck(OCR)} FROM part",
    "glyphs": f"SELECT {_duck(GLYPH)} FROM part",
    "terms": "SELECT * FROM (VALUES " + ", ".join(map(str, GLOSSARY)) + ") t(id, source_lang, target_lang, source, target)",
    "docs": f"SELECT doc_id AS document_id, doc_id % 20 AS project_id, {_NAME.format(d='doc_id')} AS name, {_days(_TS, 'doc_id % 300', 'HOUR')[1]} AS created_at, lang, text FROM documents",
    "blocks": f"SELECT *, kind IN ('heading', 'paragraph') AS translatable FROM (SELECT *, {_KIND} AS kind FROM (SELECT doc_id AS document_id, lang, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS ord, unnest(l) AS text FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)))",
    "translations": f"SELECT document_id, ord AS block_ord, target_lang, CASE WHEN n % 7 = 0 THEN '  ' ELSE concat('>', substr(text, 1, 60)) END AS text, (document_id + ord * 2) % 4 = 1 AS edited, {_days(_TS, '(document_id * 7 + ord) % 500', 'HOUR')[1]} AS updated_at FROM (SELECT *, document_id + ord + CASE WHEN target_lang = 'ru' THEN 0 ELSE 1 END AS n FROM blocks, (VALUES ('ru'), ('de')) l(target_lang)) WHERE n % 3 <> 0",
    "task_events": f"SELECT event_id AS id, user_id AS task_id, {pick('event_id', STATUSES)} AS status, props AS message, ts AS created_at, value FROM events",
    "turns": "SELECT conv_id AS dialog_id, turn, CASE WHEN role = 'assistant' THEN 'model' ELSE role END AS role, text FROM conversations",
}
_NEEDS = {"translations": ("blocks",)}


def with_tables(*names: str, more: str = "", recursive: bool = False) -> str:
    """WITH clause that defines the named tables for DuckDB, and more after them."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in (*_NEEDS.get(n, ()), n) if x not in wanted]
    parts = [f"{n} AS ({CTE[n]})" for n in wanted] + ([more] if more else [])
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) + " "
