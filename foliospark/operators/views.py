"""Relational views over documents, blocks, translations, tasks, segments, exports and catalogues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESUMABLE = ("paused", "interrupted", "failed", "cancelled")
ACTIVE = ("queued", "running", "paused")
DONE = ("complete", "failed", "cancelled", "interrupted")


def strip(col: str | Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"(?U)^\s+|\s+$", "")


def filled(col: str) -> Column:
    return F.coalesce(strip(col) != "", F.lit(False))


def has(col: Column, part: str) -> Column:
    return F.contains(F.lower(col), F.lit(part.lower()))


def newest(rows: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The n newest rows with their place; the sort is a top-n, so only n rows meet in one task."""
    top = rows.orderBy(F.desc(at), key).limit(n)
    return top.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc(at), key)))


def valid_models(models: DataFrame) -> DataFrame:
    return models.where(F.col("filename").rlike("^[A-Za-z0-9._-]{1,80}$") & F.col("registry").isin("builtin", "market", "custom") & (F.col("size_bytes") > 0) & F.col("estimated_ram_gb").between(1, 24))


def attachment(blocks: DataFrame, limit: int) -> DataFrame:
    """A document's filled blocks joined by blank lines, clipped."""
    whole = blocks.where(F.trim("text") != "").groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("whole"))
    return whole.select("document_id", F.substring("whole", 1, limit).alias("text"), (F.length("whole") > limit).alias("truncated"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the value, which is computed once however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def preferences(file: Column, defaults: dict[str, str]) -> Column:
    """A map: the defaults and what a JSON object says instead; the defaults alone if the file isn't one."""
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    given = F.when(F.trim(file).startswith("{"), F.from_json(file, "map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.coalesce(F.map_contains_key(given, k), F.lit(False)))
    return F.when(given.isNull(), base).otherwise(F.map_concat(kept, given))


def market_cache(file: Column) -> Column:
    """struct(fetched_at, offers, errors, stale) of a cache file; offers and errors that aren't whole are left out."""
    kind = "fetched_at string, offers array<struct<id:string,repo:string,size:bigint>>, errors array<struct<repo:string,error:string>>, stale boolean"
    raw = F.from_json(file, kind)
    offers = F.filter(raw["offers"], lambda x: x["id"].isNotNull() & x["repo"].isNotNull() & (x["size"] > 0))
    errors = F.filter(raw["errors"], lambda x: x["repo"].isNotNull() & x["error"].isNotNull())
    empty = lambda c, name: F.coalesce(c, F.array().cast(name))
    return F.struct(raw["fetched_at"].alias("fetched_at"), empty(offers, "array<struct<id:string,repo:string,size:bigint>>").alias("offers"), empty(errors, "array<struct<repo:string,error:string>>").alias("errors"), F.coalesce(raw["stale"], F.lit(False)).alias("stale"))


def resolved_path(name: Column) -> Column:
    """A path with / for \\, and without empty and . parts and parts that a .. takes back."""
    clean = F.replace(name, F.lit("\\"), F.lit("/"))
    absolute = F.startswith(clean, F.lit("/"))
    parts = F.filter(F.split(clean, "/"), lambda x: ~x.isin("", "."))

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return F.when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((part == "..") & absolute, done).otherwise(F.array_append(done, part))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def archive_guard(members: DataFrame, most: int, largest: int) -> DataFrame:
    """Totals of each archive and whether it must be rejected: too many or too large members, paths that leave it, or the
    same path twice. Paths are compared as they are once resolved; dots inside a name are fine."""
    path = resolved_path(F.col("name"))
    bad = path.startswith("../") | path.startswith("/") | (path == "..") | F.col("name").contains("\0")
    return members.groupBy("archive").agg(
        F.count("*").alias("members"),
        F.sum("size").alias("total"),
        ((F.count("*") > most) | (F.sum("size") > largest) | (F.count("*") > F.count_distinct(path)) | F.bool_or(bad)).alias("rejected"),
    )


def block_states(blocks: DataFrame, translations: DataFrame, langs: list[str]) -> DataFrame:
    """Every block in every language with its translation and state; the first rule that holds wins."""
    grid = blocks.withColumn("target_lang", F.explode(F.array(*[F.lit(x) for x in langs])))
    made = translations.select("document_id", F.col("block_ord").alias("ord"), "target_lang", F.col("text").alias("translation"), "edited")
    state = F.when(~F.col("translatable"), "skip").when(~filled("translation"), "empty").when(F.col("edited"), "edited").otherwise("machine")
    return grid.join(made, ["document_id", "ord", "target_lang"], "left").withColumn("edited", F.coalesce("edited", F.lit(False))).withColumn("state", state)


def visible(states: DataFrame, state: str, needle: str) -> DataFrame:
    found = has(F.col("text"), needle) | has(F.coalesce("translation", F.lit("")), needle)
    return states.where(F.col("state") == state if state != "all" else F.lit(True)).where(found if needle else F.lit(True))


def queue_rows(tasks: DataFrame, which: str, needle: str) -> DataFrame:
    return tasks.where(F.col("status").isin(*(ACTIVE if which == "active" else DONE))).where(has(F.col("document_name"), needle))


def results(tasks: DataFrame, status: str, language: str, name: str, first: str, last: str) -> DataFrame:
    """Tasks by status, language, name and inclusive days; a row without a day fails a date filter."""
    day = F.date_format(F.coalesce("updated_at", "created_at"), "yyyy-MM-dd")
    return tasks.withColumn("day", day).where((F.col("status") == status) & (F.col("target_lang") == language) & has(F.col("document_name"), name) & F.col("day").between(first, last))


def plain_model_file() -> Column:
    low = F.lower("filename")
    return low.rlike(r"^[^/\\:]+\.gguf$") & ~low.contains("mmproj") & ~low.rlike(r"-\d+-of-\d+") & F.col("digest").rlike("^[0-9a-f]{64}$") & (F.col("size_bytes") >= 1048576)


def trusted(url: str, host: str) -> Column:
    own = F.coalesce(F.expr(f"try_parse_url({url}, 'HOST')"), F.lit(""))
    return F.col(url).startswith("https://") & ((own == host) | own.endswith(f".{host}"))


def confirmed_pairs(blocks: DataFrame, translations: DataFrame, lang: str, n: int) -> DataFrame:
    """The newest edited, filled pairs."""
    mine = translations.where(F.col("edited") & (F.length(F.trim("text")) > 0) & (F.col("target_lang") == lang)).select("document_id", F.col("block_ord").alias("ord"), F.col("text").alias("translation"), "updated_at")
    return blocks.select("document_id", "ord", F.col("text").alias("source")).join(mine, ["document_id", "ord"]).orderBy(F.desc("updated_at"), "document_id", "ord").limit(n).select("document_id", "ord", "source", "translation")


def listing(documents: DataFrame, own: DataFrame, translations: DataFrame) -> DataFrame:
    """Blocks and finished ones of each document; a document without rows falls back to one block."""
    missing = documents.select("document_id").join(own, "document_id", "left_anti").withColumn("ord", F.lit(0))
    done = translations.where("length(trim(text)) > 0").select("document_id", F.col("block_ord").alias("ord"), F.lit(1).alias("done"))
    return own.unionByName(missing).join(done, ["document_id", "ord"], "left").groupBy("document_id").agg(F.count_distinct("ord").alias("blocks"), F.count("done").alias("done"))


def progress(blocks: DataFrame, translations: DataFrame, langs: list[str]) -> DataFrame:
    """done and total of every document in every language, also where nothing is translated."""
    filled_rows = translations.where("length(trim(text)) > 0").select("document_id", F.col("block_ord").alias("ord"), "target_lang", F.lit(True).alias("has"))
    grid = blocks.select("document_id", "ord", "translatable", F.explode(F.array(*[F.lit(x) for x in langs])).alias("target_lang"))
    return grid.join(filled_rows, ["document_id", "ord", "target_lang"], "left").groupBy("document_id", "target_lang").agg(F.count_if(F.col("translatable") & F.col("has").isNotNull()).alias("done"), F.count_if("translatable").alias("total"))


def language_maps(states: DataFrame) -> DataFrame:
    """Maps by language of each block's translations and flags."""
    pairs = lambda v: F.map_from_entries(F.collect_list(F.when(F.col("translation").isNotNull(), F.struct("target_lang", v))))
    return states.groupBy("document_id", "ord").agg(pairs("translation").alias("translations"), F.map_from_entries(F.collect_list(F.struct("target_lang", "edited"))).alias("edited"))


def tasks_with_files(tasks: DataFrame, documents: DataFrame, exports: DataFrame) -> DataFrame:
    """Each task with its document's name and its files, newest first."""
    files = exports.where("task_id IS NOT NULL").groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "id", "path")), asc=False).alias("files"))
    return tasks.join(documents.select("document_id", "name"), "document_id", "left").join(files, "task_id", "left").withColumn("files", F.coalesce("files", F.array().cast("array<struct<created_at:timestamp,id:bigint,path:string>>")))


def rows_and_loose_files(tasks: DataFrame, exports: DataFrame) -> DataFrame:
    """Tasks, and exports that belong to none, as rows of one list."""
    rows = tasks.select(F.lit("task").alias("kind"), F.col("task_id").cast("string").alias("row_id"), "document_id", "status", "target_lang")
    loose = exports.where("task_id IS NULL").select(F.lit("file").alias("kind"), F.concat(F.lit("export:"), F.col("id").cast("string")).alias("row_id"), "document_id", F.lit("saved").alias("status"), "target_lang")
    return rows.unionByName(loose)


def jobs(documents: DataFrame, tasks: DataFrame) -> DataFrame:
    """A row for each document and language; documents without a task are imported. Of several tasks the oldest counts."""
    first = tasks.withColumn("n", F.row_number().over(Window.partitionBy("document_id", "target_lang").orderBy("created_at", "task_id"))).where("n = 1")
    return documents.select("document_id").join(first.select("document_id", "target_lang", "status", "task_id"), "document_id", "left").select("document_id", F.coalesce("target_lang", F.lit("")).alias("target_lang"), F.coalesce("status", F.lit("imported")).alias("status"), "task_id")


def with_flag(rows: DataFrame, known: DataFrame, key: str, flag: str) -> DataFrame:
    """Whether each row's key is among the known ones."""
    return rows.join(known.select(key, F.lit(True).alias(flag)).distinct(), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def translated(blocks: DataFrame, translations: DataFrame, lang: str) -> DataFrame:
    """Blocks with the text that is exported: the translation if there is one, else the source."""
    mine = translations.where(F.col("target_lang") == lang).select("document_id", F.col("block_ord").alias("ord"), F.col("text").alias("translation"))
    return blocks.join(mine, ["document_id", "ord"], "left").withColumn("final", F.when(F.col("translatable"), F.coalesce("translation", "text")).otherwise(F.col("text")))


def exact_sum(value: Column) -> Column:
    """A sum of doubles that doesn't depend on their order: decimals add exactly; those too large for that, and what is no number, add as they are."""
    exact = value.try_cast("decimal(28,12)")
    return F.coalesce(F.sum(exact).cast("double") + F.coalesce(F.sum(F.when(exact.isNull(), value)), F.lit(0.0)), F.sum(F.when(exact.isNull(), value)))


def throughput(events: DataFrame) -> DataFrame:
    """Characters a second of each task, to one decimal; of a tie the greater."""
    speed = F.sum(F.length("message")) / F.greatest(exact_sum(F.col("value")) / 100, F.lit(0.05))
    return events.groupBy("task_id").agg((F.round(speed * 10) / 10).alias("chars_per_s"))


def assembled(segments: DataFrame, column: str) -> DataFrame:
    """Each block's segments in order, joined without a separator."""
    return segments.groupBy("task_id", "block_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_ord", column))), lambda x: x[column]), "").alias("text"))


def machine_drafts(tasks: DataFrame, segments: DataFrame) -> DataFrame:
    """Texts of the newest complete task of each document and language."""
    order = Window.partitionBy("document_id", "target_lang").orderBy(F.desc_nulls_last("updated_at"), F.desc("task_id"))
    last = tasks.where("status = 'complete'").withColumn("r", F.row_number().over(order)).where("r = 1")
    texts = assembled(segments.where("status = 'complete'").join(last, "task_id", "left_semi"), "translation")
    return texts.join(last.select("task_id", "document_id", "target_lang"), "task_id").select("document_id", "target_lang", "block_ord", "text")


def first_registry(models: DataFrame) -> DataFrame:
    rank = F.when(F.col("registry") == "builtin", 0).when(F.col("registry") == "market", 1).otherwise(2)
    return models.withColumn("n", F.row_number().over(Window.partitionBy("model_id").orderBy(rank, "filename"))).where("n = 1")


def unpublished(tasks: DataFrame, exports: DataFrame) -> DataFrame:
    return tasks.where("status = 'complete'").join(exports.where("task_id IS NOT NULL"), "task_id", "left_anti")


def overlay(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Tasks with the fields of their latest event where there is one."""
    last = events.groupBy("task_id").agg(F.max_by(F.struct("status", "created_at"), F.struct("created_at", "id")).alias("e"))
    return tasks.join(last, "task_id", "left").select("task_id", F.coalesce("e.status", "status").alias("status"), F.coalesce("e.created_at", "updated_at").alias("updated_at"))


def completion(tasks: DataFrame, segments: DataFrame) -> DataFrame:
    per = segments.groupBy("task_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "complete").alias("done"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return tasks.select("task_id").join(per, "task_id", "left").select("task_id", zero("total"), zero("done")).withColumn("can_finish", F.col("total") == F.col("done"))


def spectrum(states: DataFrame, ticks: int) -> DataFrame:
    """Share of translated blocks in up to ``ticks`` stretches of each document; -1 where none is translatable. Ratios are rounded half to even on whole numbers."""
    own = Window.partitionBy("document_id")
    rows = states.select("document_id", F.when(F.col("state") == "skip", -1).when(F.col("state") == "empty", 0).otherwise(1).alias("v"), (F.row_number().over(own.orderBy("ord")) - 1).alias("rn"), F.count("*").over(own).alias("n"))
    per = rows.groupBy("document_id", F.expr(f"CAST(rn DIV CAST(ceil(n / {ticks}.0D) AS BIGINT) AS INT)").alias("bucket")).agg(F.count_if(F.col("v") >= 0).alias("m"), F.count_if(F.col("v") == 1).alias("o"))
    rounded = F.expr("CASE WHEN 2 * ((100 * o) % m) > m OR (2 * ((100 * o) % m) = m AND ((100 * o) DIV m) % 2 = 1) THEN (100 * o) DIV m + 1 ELSE (100 * o) DIV m END / 100D")
    return per.select("document_id", "bucket", F.when(F.col("m") == 0, F.lit(-1.0)).otherwise(rounded).alias("value"))


def vertical_map(blocks: DataFrame, translations: DataFrame, most: int) -> DataFrame:
    own = Window.partitionBy("document_id")
    made = translations.select("document_id", F.col("block_ord").alias("ord"), filled("text").alias("done"))
    rows = blocks.join(made, ["document_id", "ord"], "left").select("*", (F.row_number().over(own.orderBy("ord")) - 1).alias("rn"), F.count("*").over(own).alias("n"))
    return rows.groupBy("document_id", F.expr(f"rn DIV CAST(ceil(n / {most}.0D) AS BIGINT)").alias("bucket")).agg(
        F.min("ord").alias("first_ord"),
        (F.sum(F.length("text")) + F.count("*") - 1).alias("chars"),
        F.bool_or("translatable").alias("translatable"),
        (F.count_if("done") / F.greatest(F.lit(1), F.count_if("translatable"))).alias("ratio"),
    )


def status_map(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("project_id", "status").count().groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("status", "count"))).alias("summary"))


def whole_blocks(pending: DataFrame) -> DataFrame:
    """Pending segments with the number of their block's pieces and whether the block is one whole piece."""
    out = pending.withColumn("pieces", F.count("*").over(Window.partitionBy("task_id", "block_ord")))
    return out.withColumn("whole", (F.col("segment_ord") == 0) & (F.col("pieces") == 1))


def sections(blocks: DataFrame) -> DataFrame:
    """Number and title of the section that each block stands in."""
    seen = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.col("kind") == "heading"
    return blocks.withColumn("section_no", F.sum(heading.cast("long")).over(seen)).withColumn("section_title", F.last(F.when(heading, F.col("text")), ignorenulls=True).over(seen))


def section_tree(rows: DataFrame) -> DataFrame:
    return rows.groupBy("document_id", F.coalesce("section_title", F.lit("main")).alias("title")).agg(F.count("*").alias("blocks"), F.min("ord").alias("first_ord"))


def islands(rows: DataFrame, column: str) -> DataFrame:
    """Consecutive blocks with one value of the column."""
    order = Window.partitionBy("document_id").orderBy("ord")
    start = (~F.col(column).eqNullSafe(F.lag(column).over(order))).cast("long")
    runs = rows.withColumn("start", F.when(F.row_number().over(order) == 1, F.col(column)).otherwise(start)).withColumn("island", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy("document_id", "island").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


def context_meter(turns: DataFrame, window: int) -> DataFrame:
    used = F.expr("sum(length(text)) DIV 4")
    return turns.groupBy("dialog_id").agg(F.sum(F.length("text")).alias("chars"), used.alias("used"), F.least(F.lit(100), F.round(used * 100 / F.lit(float(window)))).cast("int").alias("percent"))


def ordered_distinct(rows: DataFrame, key: str, value: str, order: list[str], name: str) -> DataFrame:
    """Values of each key in order of their first appearance."""
    first = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("first"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", value))), lambda x: x[value]), ",").alias(name))


def in_all_groups(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Values that every group has."""
    total = rows.agg(F.count_distinct(group).alias("total"))
    return rows.groupBy(value).agg(F.count_distinct(group).alias("n")).crossJoin(F.broadcast(total)).where("n = total").select(value)


#: Quantisations of each role, best first.
ROLE_QUANTS = {"light": ("Q4_K_M", "Q5_K_M"), "full": ("Q8_0", "F16", "Q6_K")}


def first_by_preference(models: DataFrame) -> DataFrame:
    """The file of each repository's role: the first quantisation there is in the role's order."""
    quant = F.regexp_extract("filename", "(Q4_K_M|Q5_K_M|Q6_K|Q8_0|F16)", 1)
    prefs = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(q).alias("quant"), F.lit(i).alias("pref")) for role, qs in ROLE_QUANTS.items() for i, q in enumerate(qs)])
    rows = models.select("repo", "filename", quant.alias("quant"), F.explode(prefs).alias("p")).where("quant = p.quant")
    return rows.groupBy("repo", F.col("p.role").alias("role")).agg(F.min_by("filename", F.struct("p.pref", "filename")).alias("filename"))


def suggested(projects: DataFrame, allowed: list[str]) -> DataFrame:
    """Targets of the newest project of each source language that are allowed and aren't the source."""
    codes = F.array(*[F.lit(x) for x in allowed])
    targets = F.array_join(F.array_except(F.array_intersect(F.array("lang_a", "lang_b"), codes), F.array("source_lang")), ",")
    return projects.groupBy("source_lang").agg(F.max_by(targets, F.struct("updated_at", "project_id")).alias("targets"))


def last_context(segments: DataFrame, n: int) -> DataFrame:
    """The last n complete segments of each task."""
    order = Window.partitionBy("task_id").orderBy(F.desc("block_ord"), F.desc("segment_ord"))
    return segments.where("status = 'complete'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.unionByName(old.join(new, key, "left_anti"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both have the same rows, with their numbers."""
    odd = a.exceptAll(b).unionAll(b.exceptAll(a)).limit(1)
    return odd.agg((F.count("*") == 0).alias("same"))
