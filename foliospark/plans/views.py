"""Listings and views: progress, states, tasks, exports, dialogs and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators import views as V
from foliospark.plans.registry import query
from foliospark.sources import tables as T
from foliospark.sources.tables import with_tables

_STATE = "CASE WHEN NOT b.translatable THEN 'skip' WHEN t.text IS NULL OR regexp_replace(t.text, '^\\s+|\\s+$', '', 'g') = '' THEN 'empty' WHEN t.edited THEN 'edited' ELSE 'machine' END"
_STATES = with_tables("blocks", "translations", more=f"states AS (SELECT b.document_id, b.ord, l.lang AS target_lang, b.kind, b.text, t.text AS translation, coalesce(t.edited, false) AS edited, {_STATE} AS state FROM blocks b CROSS JOIN (VALUES ('ru'), ('de')) l(lang) LEFT JOIN translations t ON t.document_id = b.document_id AND t.block_ord = b.ord AND t.target_lang = l.lang)")


def _states(s: SparkSession, d: str) -> DataFrame:
    return V.block_states(T.blocks(s, d), T.translations(s, d), ["ru", "de"])


@query("src_13_task_scan", with_tables("tasks") + "SELECT task_id, document_id, status, model_id FROM tasks WHERE status = 'failed'")
def src_13(s, d):
    return T.tasks(s, d).where("status = 'failed'").select("task_id", "document_id", "status", "model_id")


@query("src_14_projects", with_tables("projects") + "SELECT project_id, title, updated_at, row_number() OVER (ORDER BY updated_at DESC, project_id)::INTEGER AS place FROM projects ORDER BY updated_at DESC, project_id LIMIT 100")
def src_14(s, d):
    return V.newest(T.projects(s, d).select("project_id", "title", "updated_at"), "updated_at", "project_id", 100)


@query("src_15_dialogs", with_tables("turns") + "SELECT dialog_id, count(*) AS messages, max(turn) AS last_turn FROM turns GROUP BY dialog_id ORDER BY last_turn DESC, dialog_id LIMIT 40")
def src_15(s, d):
    per = T.turns(s, d).groupBy("dialog_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))
    return per.orderBy(F.desc("last_turn"), "dialog_id").limit(40)


@query("src_16_catalogue", with_tables("models") + "SELECT model_id, filename, registry FROM models WHERE regexp_full_match(filename, '[A-Za-z0-9._-]{1,80}') AND registry IN ('builtin', 'market', 'custom') AND size_bytes > 0 AND estimated_ram_gb BETWEEN 1 AND 24")
def src_16(s, d):
    return V.valid_models(T.models(s, d)).select("model_id", "filename", "registry")


@query("src_18_attachment", with_tables("blocks") + "SELECT document_id, substr(whole, 1, 8000) AS text, length(whole) > 8000 AS truncated FROM (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS whole FROM blocks WHERE trim(text) <> '' GROUP BY document_id)")
def src_18(s, d):
    return V.attachment(T.blocks(s, d), 8000)


@query("src_10_archive_guard", "WITH m AS (SELECT l_orderkey AS archive, CASE WHEN l_partkey % 97 = 0 THEN '../up' WHEN l_partkey % 89 = 0 THEN 'a/../../up' WHEN l_partkey % 83 = 0 THEN 'vol..1.txt' WHEN l_partkey % 79 = 0 THEN 'part/x/../1' ELSE concat(CASE WHEN l_linenumber % 2 = 0 THEN 'part/' ELSE 'Part/' END, CAST(l_partkey AS STRING)) END AS name, CAST(l_quantity AS BIGINT) * 1000 AS size FROM lineitem) SELECT archive, count(*) AS members, sum(size)::BIGINT AS total, count(*) > 20000 OR sum(size) > 100000 OR count(*) > count(DISTINCT CASE name WHEN 'part/x/../1' THEN 'part/1' WHEN 'a/../../up' THEN '../up' ELSE name END) OR bool_or(name IN ('../up', 'a/../../up')) AS rejected FROM m GROUP BY archive")
def src_10(s, d):
    members = T.read(s, d, "lineitem").select(F.col("l_orderkey").alias("archive"), F.expr("CASE WHEN l_partkey % 97 = 0 THEN '../up' WHEN l_partkey % 89 = 0 THEN 'a/../../up' WHEN l_partkey % 83 = 0 THEN 'vol..1.txt' WHEN l_partkey % 79 = 0 THEN 'part/x/../1' ELSE concat(CASE WHEN l_linenumber % 2 = 0 THEN 'part/' ELSE 'Part/' END, CAST(l_partkey AS STRING)) END").alias("name"), (F.col("l_quantity").cast("long") * 1000).alias("size"))
    return V.archive_guard(members, 20000, 100000)


@query("ag_16_archive_totals", "SELECT l_orderkey AS archive, count(*) AS members, sum(CAST(l_quantity AS BIGINT))::BIGINT AS total FROM lineitem GROUP BY l_orderkey")
def ag_16(s, d):
    return T.read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("archive")).agg(F.count("*").alias("members"), F.sum(F.col("l_quantity").cast("long")).alias("total"))


@query("flt_01_translatable", with_tables("blocks") + "SELECT document_id, ord, length(text) AS n FROM blocks WHERE translatable AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")
def flt_01(s, d):
    return T.blocks(s, d).where(F.col("translatable") & V.filled("text")).select("document_id", "ord", F.length("text").cast("long").alias("n"))


@query("flt_02_pending", with_tables("segments") + "SELECT task_id, block_ord, segment_ord, source FROM segments WHERE status <> 'complete'")
def flt_02(s, d):
    return T.segments(s, d).where("status <> 'complete'").orderBy("task_id", "block_ord", "segment_ord").select("task_id", "block_ord", "segment_ord", "source")


@query("flt_03_done_rows", with_tables("translations") + "SELECT document_id, target_lang, block_ord FROM translations WHERE length(trim(text)) > 0")
def flt_03(s, d):
    return T.translations(s, d).where("length(trim(text)) > 0").select("document_id", "target_lang", "block_ord")


@query("flt_04_state", _STATES + "SELECT document_id, ord, target_lang, state FROM states")
def flt_04(s, d):
    return _states(s, d).select("document_id", "ord", "target_lang", "state")


@query("flt_05_visible", _STATES + "SELECT document_id, ord, target_lang FROM states WHERE state = 'machine' AND (contains(lower(text), 'the') OR contains(lower(coalesce(translation, '')), 'the'))")
def flt_05(s, d):
    return V.visible(_states(s, d), "machine", "the").select("document_id", "ord", "target_lang")


@query("flt_06_queue", with_tables("tasks") + "SELECT task_id, document_name, status FROM tasks WHERE status IN ('queued', 'running', 'paused') AND contains(lower(document_name), '1')")
def flt_06(s, d):
    return V.queue_rows(T.tasks(s, d), "active", "1").select("task_id", "document_name", "status")


@query("flt_07_results", with_tables("tasks") + "SELECT task_id, status, strftime(coalesce(updated_at, created_at), '%Y-%m-%d') AS day FROM tasks WHERE status = 'complete' AND target_lang = 'en' AND contains(lower(document_name), 'file') AND coalesce(updated_at, created_at)::DATE BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def flt_07(s, d):
    return V.results(T.tasks(s, d), status="complete", language="en", name="file", first="1996-01-01", last="1999-12-31").select("task_id", "status", "day")


@query("flt_08_task_search", with_tables("tasks", "projects") + "SELECT t.task_id FROM tasks t JOIN projects p USING (project_id) WHERE contains(lower(concat_ws(' ', t.document_name, p.title)), '6.md customer#')")
def flt_08(s, d):
    both = T.tasks(s, d).join(T.projects(s, d).select("project_id", "title"), "project_id")
    return both.where(V.has(F.concat_ws(" ", "document_name", "title"), "6.md customer#")).select("task_id")


@query("flt_09_dialog_search", with_tables("turns") + "SELECT dialog_id FROM turns WHERE turn = 0 AND contains(lower(substr(text, 1, 48)), 'the')")
def flt_09(s, d):
    return T.turns(s, d).where(F.col("turn") == 0).where(V.has(F.substring("text", 1, 48), "the")).select("dialog_id")


@query("flt_10_project_search", with_tables("projects") + "SELECT project_id, title FROM projects WHERE contains(lower(title), '00012')")
def flt_10(s, d):
    return T.projects(s, d).where(V.has(F.col("title"), "00012")).select("project_id", "title")


@query("flt_11_language_search", "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), '_1') OR contains(CAST(n_nationkey AS STRING), '2')")
def flt_11(s, d):
    return T.read(s, d, "nation").where(V.has(F.col("n_name"), "_1") | F.col("n_nationkey").cast("string").contains("2")).select("n_nationkey", "n_name")


@query("flt_12_untranslated", _STATES + "SELECT document_id, target_lang, count(*) FILTER (WHERE state = 'empty') AS missing, bool_or(state = 'empty') AS warn FROM states GROUP BY document_id, target_lang")
def flt_12(s, d):
    return _states(s, d).groupBy("document_id", "target_lang").agg(F.count_if(F.col("state") == "empty").alias("missing"), F.bool_or(F.col("state") == "empty").alias("warn"))


_CODES = "['en', 'ru', 'de', 'fr']"


@query("flt_13_supported", with_tables("projects") + f"SELECT project_id, array_to_string(list_sort(list_distinct(list_filter([lang_a, lang_b], lambda x: list_contains({_CODES}, x)))), ',') AS supported FROM projects")
def flt_13(s, d):
    known = F.array(*[F.lit(x) for x in ("en", "ru", "de", "fr")])
    return T.projects(s, d).select("project_id", F.array_join(F.array_sort(F.array_intersect(F.array("lang_a", "lang_b"), known)), ",").alias("supported"))


@query("flt_14_unsupported", with_tables("projects") + f"SELECT project_id, array_to_string(list_filter(CASE WHEN lang_a = lang_b THEN [lang_a] ELSE [lang_a, lang_b] END, lambda x: NOT list_contains({_CODES}, x)), ',') AS unsupported FROM projects")
def flt_14(s, d):
    known = F.array(*[F.lit(x) for x in ("en", "ru", "de", "fr")])
    return T.projects(s, d).select("project_id", F.array_join(F.array_except(F.array("lang_a", "lang_b"), known), ",").alias("unsupported"))


_GGUF = "regexp_full_match(lower(filename), '[^/\\\\:]+\\.gguf') AND NOT contains(lower(filename), 'mmproj') AND NOT regexp_matches(lower(filename), '-[0-9]+-of-[0-9]+') AND regexp_full_match(digest, '[0-9a-f]{64}') AND size_bytes >= 1048576"


@query("flt_15_market_files", with_tables("models") + f"SELECT model_id, filename FROM models WHERE {_GGUF}")
def flt_15(s, d):
    return T.models(s, d).where(V.plain_model_file()).select("model_id", "filename")


@query("flt_16_validators", with_tables("models") + "SELECT registry, count(*) FILTER (WHERE NOT (regexp_full_match(model_id, 'model-[0-9]{1,3}') AND status IN ('available', 'installed'))) AS invalid, count(*) AS n FROM models GROUP BY registry")
def flt_16(s, d):
    ok = F.col("model_id").rlike("^model-[0-9]{1,3}$") & F.col("status").isin("available", "installed")
    return T.models(s, d).groupBy("registry").agg(F.count_if(~ok).alias("invalid"), F.count("*").alias("n"))


@query("flt_19_trusted_hosts", "SELECT page_id, regexp_extract(url, '^(?:[a-z]+:)?//([^/?#:]+)', 1) AS host, regexp_matches(url, '^https://') AND (regexp_extract(url, '^(?:[a-z]+:)?//([^/?#:]+)', 1) = 'example.net' OR regexp_extract(url, '^(?:[a-z]+:)?//([^/?#:]+)', 1) LIKE '%.example.net') AS trusted FROM pages")
def flt_19(s, d):
    return T.read(s, d, "pages").select("page_id", F.coalesce(F.expr("try_parse_url(url, 'HOST')"), F.lit("")).alias("host"), V.trusted("url", "example.net").alias("trusted"))


@query("flt_21_installable", with_tables("models") + "SELECT registry, bool_or(status IN ('available', 'installed')) AS any_ready, count(*) FILTER (WHERE status IN ('available', 'installed')) AS ready FROM models GROUP BY registry")
def flt_21(s, d):
    ready = F.col("status").isin("available", "installed")
    return T.models(s, d).groupBy("registry").agg(F.bool_or(ready).alias("any_ready"), F.count_if(ready).alias("ready"))


@query("flt_22_resumable", with_tables("tasks") + "SELECT task_id, status FROM tasks WHERE status IN ('paused', 'interrupted', 'failed', 'cancelled')")
def flt_22(s, d):
    return T.tasks(s, d).where(F.col("status").isin(*V.RESUMABLE)).select("task_id", "status")


@query("flt_23_busy", with_tables("tasks") + "SELECT project_id, bool_or(status = 'queued') AS queued, bool_or(status IN ('queued', 'running')) AS busy FROM tasks GROUP BY project_id")
def flt_23(s, d):
    return T.tasks(s, d).groupBy("project_id").agg(F.bool_or(F.col("status") == "queued").alias("queued"), F.bool_or(F.col("status").isin("queued", "running")).alias("busy"))


# Joins


@query("jn_01_confirmed_pairs", with_tables("blocks", "translations") + "SELECT b.document_id, b.ord, b.text AS source, t.text AS translation FROM translations t JOIN blocks b ON b.document_id = t.document_id AND b.ord = t.block_ord WHERE t.edited AND length(trim(t.text)) > 0 AND t.target_lang = 'ru' ORDER BY t.updated_at DESC, b.document_id, b.ord LIMIT 200")
def jn_01(s, d):
    return V.confirmed_pairs(T.blocks(s, d), T.translations(s, d), "ru", 200)


@query("jn_02_backfill", with_tables("projects") + "SELECT n.n_nationkey, p.lang_a AS target_lang FROM nation n CROSS JOIN (SELECT lang_a FROM projects WHERE project_id = 1) p")
def jn_02(s, d):
    one = T.projects(s, d).where("project_id = 1").select(F.col("lang_a").alias("target_lang"))
    return T.read(s, d, "nation").select("n_nationkey").crossJoin(F.broadcast(one))  # the project's single row


@query("jn_03_scalar_counts", with_tables("docs", "exports") + "SELECT document_id, name, (SELECT count(*) FROM exports e WHERE e.document_id = d.document_id) AS export_count, (SELECT max(e.target_lang) FROM exports e WHERE e.document_id = d.document_id) AS last_lang FROM docs d")
def jn_03(s, d):
    per = T.exports(s, d).groupBy("document_id").agg(F.count("*").alias("export_count"), F.max("target_lang").alias("last_lang"))
    return T.documents(s, d).select("document_id", "name").join(per, "document_id", "left").select("document_id", "name", F.coalesce("export_count", F.lit(0)).alias("export_count"), "last_lang")


@query("jn_04_copy_project", with_tables("tasks", "projects") + "SELECT task_id, (SELECT source_lang FROM projects WHERE project_id = 3) AS source_lang, (SELECT title FROM projects WHERE project_id = 3) AS title FROM tasks")
def jn_04(s, d):
    one = T.projects(s, d).where("project_id = 3").select("source_lang", "title")
    return T.tasks(s, d).select("task_id").crossJoin(F.broadcast(one))


@query("jn_05_listing", with_tables("docs", "blocks", "translations", more="b AS (SELECT document_id, ord FROM blocks WHERE translatable AND document_id % 7 <> 0), f AS (SELECT document_id, 0 AS ord FROM docs WHERE document_id NOT IN (SELECT document_id FROM b)), u AS (SELECT * FROM b UNION ALL SELECT * FROM f)") + "SELECT u.document_id, count(DISTINCT u.ord) AS blocks, count(t.block_ord) AS done FROM u LEFT JOIN translations t ON t.document_id = u.document_id AND t.block_ord = u.ord AND t.target_lang = 'ru' AND length(trim(t.text)) > 0 GROUP BY u.document_id")
def jn_05(s, d):
    own = T.blocks(s, d).where("translatable AND document_id % 7 <> 0").select("document_id", "ord")
    return V.listing(T.documents(s, d), own, T.translations(s, d).where("target_lang = 'ru'"))


@query("jn_06_progress_grid", with_tables("blocks", "translations") + "SELECT b.document_id, l.lang AS target_lang, count(*) FILTER (WHERE b.translatable AND t.block_ord IS NOT NULL) AS done, count(*) FILTER (WHERE b.translatable) AS total FROM blocks b CROSS JOIN (VALUES ('ru'), ('de'), ('ja')) l(lang) LEFT JOIN translations t ON t.document_id = b.document_id AND t.block_ord = b.ord AND t.target_lang = l.lang AND length(trim(t.text)) > 0 GROUP BY ALL")
def jn_06(s, d):
    return V.progress(T.blocks(s, d), T.translations(s, d), ["ru", "de", "ja"])


@query("jn_07_document_maps", _STATES + "SELECT document_id, ord, max(translation) FILTER (WHERE target_lang = 'ru') AS ru, max(translation) FILTER (WHERE target_lang = 'de') AS de, bool_or(edited) FILTER (WHERE target_lang = 'ru') AS ru_edited, count(translation) AS languages FROM states GROUP BY document_id, ord")
def jn_07(s, d):
    maps = V.language_maps(_states(s, d))
    return maps.select("document_id", "ord", F.col("translations")["ru"].alias("ru"), F.col("translations")["de"].alias("de"), F.col("edited")["ru"].alias("ru_edited"), F.size("translations").cast("long").alias("languages"))


@query("jn_08_task_files", with_tables("tasks", "docs", "exports", more="f AS (SELECT task_id, string_agg(path, ',' ORDER BY created_at DESC, id DESC) AS files FROM exports WHERE task_id IS NOT NULL GROUP BY task_id)") + "SELECT t.task_id, d.name, t.status, coalesce(f.files, '') AS files FROM tasks t LEFT JOIN docs d USING (document_id) LEFT JOIN f USING (task_id)")
def jn_08(s, d):
    rows = V.tasks_with_files(T.tasks(s, d), T.documents(s, d), T.exports(s, d))
    return rows.select("task_id", "name", "status", F.array_join(F.transform("files", lambda x: x["path"]), ",").alias("files"))


@query("jn_09_loose_files", with_tables("tasks", "exports") + "SELECT 'task' AS kind, CAST(task_id AS STRING) AS row_id, document_id, status, target_lang FROM tasks UNION ALL SELECT 'file', concat('export:', CAST(id AS STRING)), document_id, 'saved', target_lang FROM exports WHERE task_id IS NULL")
def jn_09(s, d):
    return V.rows_and_loose_files(T.tasks(s, d), T.exports(s, d))


@query("jn_10_placeholders", with_tables("docs", "tasks", more="k AS (SELECT *, row_number() OVER (PARTITION BY document_id, target_lang ORDER BY created_at, task_id) AS n FROM tasks WHERE project_id = 5)") + "SELECT d.document_id, coalesce(k.target_lang, '') AS target_lang, coalesce(k.status, 'imported') AS status, k.task_id FROM docs d LEFT JOIN k ON k.document_id = d.document_id AND k.n = 1")
def jn_10(s, d):
    return V.jobs(T.documents(s, d), T.tasks(s, d).where("project_id = 5"))


@query("jn_11_project_jobs", with_tables("tasks", "docs") + "SELECT task_id FROM tasks WHERE document_id IN (SELECT document_id FROM docs WHERE project_id = 4)")
def jn_11(s, d):
    return T.tasks(s, d).join(T.documents(s, d).where("project_id = 4"), "document_id", "left_semi").select("task_id")


@query("jn_12_previous_runs", with_tables("tasks", "docs") + "SELECT task_id, document_name FROM tasks WHERE lower(document_name) IN (SELECT lower(upper(name)) FROM docs) ORDER BY created_at DESC, task_id LIMIT 6")
def jn_12(s, d):
    wanted = T.documents(s, d).select(F.lower(F.upper("name")).alias("low"))
    return T.tasks(s, d).withColumn("low", F.lower("document_name")).join(wanted, "low", "left_semi").orderBy(F.desc("created_at"), "task_id").limit(6).select("task_id", "document_name")


@query("jn_13_selection", with_tables("docs") + "SELECT c_custkey AS document_id FROM customer WHERE c_custkey IN (SELECT document_id FROM docs WHERE project_id IN (1, 2))")
def jn_13(s, d):
    return T.read(s, d, "customer").select(F.col("c_custkey").alias("document_id")).join(T.documents(s, d).where("project_id IN (1, 2)"), "document_id", "left_semi")


@query("jn_14_new_paths", with_tables("exports") + "SELECT DISTINCT concat('/out/', CAST(o_orderkey AS STRING), '.pdf') AS path FROM orders WHERE concat('/out/', CAST(o_orderkey AS STRING), '.pdf') NOT IN (SELECT path FROM exports)")
def jn_14(s, d):
    paths = T.read(s, d, "orders").select(F.concat(F.lit("/out/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("path")).distinct()
    return paths.join(T.exports(s, d), "path", "left_anti")


@query("jn_15_installed_flag", with_tables("models") + "SELECT DISTINCT m.model_id, m.filename, m.digest IN (SELECT digest FROM models WHERE registry = 'builtin' AND digest <> 'none') AS installed FROM models m WHERE registry = 'market'")
def jn_15(s, d):
    m = T.models(s, d)
    return V.with_flag(m.where("registry = 'market'").select("model_id", "filename", "digest"), m.where("registry = 'builtin' AND digest <> 'none'"), "digest", "installed").drop("digest").distinct()


@query("jn_16_linked_offers", with_tables("models") + "SELECT model_id, repo FROM models WHERE registry = 'market' AND repo IN (SELECT 'org-' || CAST(n_nationkey AS STRING) FROM nation WHERE n_regionkey = 1)")
def jn_16(s, d):
    repos = T.read(s, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("org-"), F.col("n_nationkey").cast("string")).alias("repo"))
    return T.models(s, d).where("registry = 'market'").join(repos, "repo", "left_semi").select("model_id", "repo")


@query("jn_21_source_fallback", with_tables("blocks", "translations") + "SELECT b.document_id, b.ord, CASE WHEN b.translatable THEN coalesce(t.text, b.text) ELSE b.text END AS text FROM blocks b LEFT JOIN translations t ON t.document_id = b.document_id AND t.block_ord = b.ord AND t.target_lang = 'ru'")
def jn_21(s, d):
    return V.translated(T.blocks(s, d), T.translations(s, d), "ru").select("document_id", "ord", F.col("final").alias("text"))


@query("jn_23_machine_draft", with_tables("tasks", "segments", more="n AS (SELECT task_id, document_id, target_lang, row_number() OVER (PARTITION BY document_id, target_lang ORDER BY updated_at DESC NULLS LAST, task_id DESC) AS r FROM tasks WHERE status = 'complete')") + "SELECT n.document_id, n.target_lang, s.block_ord, string_agg(s.translation, '' ORDER BY s.segment_ord) AS text FROM n JOIN segments s USING (task_id) WHERE n.r = 1 AND s.status = 'complete' GROUP BY ALL")
def jn_23(s, d):
    return V.machine_drafts(T.tasks(s, d), T.segments(s, d))


@query("jn_24_precedence", with_tables("models") + "SELECT model_id, registry, filename FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY CASE registry WHEN 'builtin' THEN 0 WHEN 'market' THEN 1 ELSE 2 END, filename) AS n FROM models) WHERE n = 1")
def jn_24(s, d):
    return V.first_registry(T.models(s, d)).select("model_id", "registry", "filename")


@query("jn_26_unpublished", with_tables("tasks", "exports") + "SELECT task_id FROM tasks WHERE status = 'complete' AND task_id NOT IN (SELECT task_id FROM exports WHERE task_id IS NOT NULL)")
def jn_26(s, d):
    return V.unpublished(T.tasks(s, d), T.exports(s, d)).select("task_id")


@query("jn_27_event_overlay", with_tables("tasks", "task_events", more="e AS (SELECT task_id, arg_max(status, (created_at, id)) AS s, arg_max(created_at, (created_at, id)) AS at FROM task_events GROUP BY task_id)") + "SELECT t.task_id, coalesce(e.s, t.status) AS status, coalesce(e.at, t.updated_at) AS updated_at FROM tasks t LEFT JOIN e USING (task_id)")
def jn_27(s, d):
    return V.overlay(T.tasks(s, d), T.task_events(s, d))


@query("jn_28_carry_over", with_tables("tasks", "task_events", more="e AS (SELECT task_id, arg_max(message, (created_at, id)) AS live FROM task_events GROUP BY task_id)") + "SELECT t.task_id, e.live FROM tasks t LEFT JOIN e USING (task_id) WHERE t.status IN ('queued', 'running', 'paused')")
def jn_28(s, d):
    live = T.task_events(s, d).groupBy("task_id").agg(F.max_by("message", F.struct("created_at", "id")).alias("live"))
    return V.queue_rows(T.tasks(s, d), "active", "").select("task_id").join(live, "task_id", "left")


# Aggregates


@query("ag_01_completion", with_tables("tasks", "segments") + "SELECT t.task_id, count(s.task_id) AS total, count(*) FILTER (WHERE s.status = 'complete') AS done, count(s.task_id) = count(*) FILTER (WHERE s.status = 'complete') AS can_finish FROM tasks t LEFT JOIN segments s USING (task_id) GROUP BY t.task_id")
def ag_01(s, d):
    return V.completion(T.tasks(s, d), T.segments(s, d))


@query("ag_02_ordered_concat", with_tables("segments") + "SELECT task_id, block_ord, string_agg(source, '' ORDER BY segment_ord) AS text FROM segments GROUP BY ALL")
def ag_02(s, d):
    return V.assembled(T.segments(s, d), "source")


@query("ag_03_progress", _STATES + "SELECT document_id, target_lang, count(*) FILTER (WHERE state IN ('machine', 'edited')) AS done, count(*) FILTER (WHERE state <> 'skip') AS total FROM states GROUP BY ALL")
def ag_03(s, d):
    return _states(s, d).groupBy("document_id", "target_lang").agg(F.count_if(F.col("state").isin("machine", "edited")).alias("done"), F.count_if(F.col("state") != "skip").alias("total"))


_SPECTRUM = _STATES + """, v AS (SELECT document_id, ord, CASE state WHEN 'skip' THEN -1 WHEN 'empty' THEN 0 ELSE 1 END AS v,
row_number() OVER (PARTITION BY document_id ORDER BY ord) - 1 AS rn, count(*) OVER (PARTITION BY document_id) AS n FROM states WHERE target_lang = 'ru'),
k AS (SELECT document_id, CAST(floor(rn / ceil(n / {ticks}.0)) AS INTEGER) AS bucket, v FROM v)
SELECT document_id, bucket, coalesce(round(sum(v) FILTER (WHERE v >= 0) * 100 / count(*) FILTER (WHERE v >= 0)) / 100, -1)::DOUBLE AS value FROM (SELECT document_id, bucket, v FROM k) GROUP BY ALL"""


@query("ag_04_spectrum", _STATES + """, v AS (SELECT document_id, CASE state WHEN 'skip' THEN -1 WHEN 'empty' THEN 0 ELSE 1 END AS v,
row_number() OVER (PARTITION BY document_id ORDER BY ord) - 1 AS rn, count(*) OVER (PARTITION BY document_id) AS n FROM states WHERE target_lang = 'ru')
SELECT document_id, bucket, CASE WHEN m = 0 THEN -1.0 ELSE (CASE WHEN 2 * ((100 * o) % m) > m OR (2 * ((100 * o) % m) = m AND ((100 * o) // m) % 2 = 1) THEN (100 * o) // m + 1 ELSE (100 * o) // m END) / 100.0 END::DOUBLE AS value
FROM (SELECT document_id, CAST(rn // CAST(ceil(n / 20.0) AS BIGINT) AS INTEGER) AS bucket, count(*) FILTER (WHERE v >= 0) AS m, count(*) FILTER (WHERE v = 1) AS o FROM v GROUP BY ALL)""")
def ag_04(s, d):
    return V.spectrum(_states(s, d).where("target_lang = 'ru'"), 20)


@query("ag_05_vertical_map", with_tables("blocks", "translations", more="r AS (SELECT b.*, t.text IS NOT NULL AND regexp_replace(t.text, '^\\s+|\\s+$', '', 'g') <> '' AS done, row_number() OVER (PARTITION BY b.document_id ORDER BY b.ord) - 1 AS rn, count(*) OVER (PARTITION BY b.document_id) AS n FROM blocks b LEFT JOIN translations t ON t.document_id = b.document_id AND t.block_ord = b.ord AND t.target_lang = 'de')") + "SELECT document_id, rn // CAST(ceil(n / 10.0) AS BIGINT) AS bucket, min(ord) AS first_ord, length(string_agg(text, ' ' ORDER BY ord)) AS chars, bool_or(translatable) AS translatable, count(*) FILTER (WHERE done) / greatest(1, count(*) FILTER (WHERE translatable))::DOUBLE AS ratio FROM r GROUP BY ALL")
def ag_05(s, d):
    return V.vertical_map(T.blocks(s, d), T.translations(s, d).where("target_lang = 'de'"), 10)


@query("ag_06_status_histogram", with_tables("tasks") + "SELECT project_id, status, count(*) AS n FROM tasks GROUP BY ALL")
def ag_06(s, d):
    return V.status_map(T.tasks(s, d)).select("project_id", F.explode("summary").alias("status", "n"))


@query("ag_07_review_counters", _STATES + "SELECT document_id, target_lang, count(*) FILTER (WHERE state = 'empty') AS empty, count(*) FILTER (WHERE state = 'machine') AS machine, count(*) FILTER (WHERE state = 'edited') AS edited FROM states GROUP BY ALL")
def ag_07(s, d):
    return _states(s, d).groupBy("document_id", "target_lang").pivot("state", ["empty", "machine", "edited"]).count().na.fill(0)


@query("ag_08_segments_per_block", with_tables("segments") + "SELECT task_id, block_ord, segment_ord, count(*) OVER w AS pieces, segment_ord = 0 AND count(*) OVER w = 1 AS whole FROM segments WHERE status <> 'complete' WINDOW w AS (PARTITION BY task_id, block_ord)")
def ag_08(s, d):
    return V.whole_blocks(T.segments(s, d).where("status <> 'complete'")).select("task_id", "block_ord", "segment_ord", "pieces", "whole")


_SECTIONS = "h AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ord) AS section_no, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS title FROM blocks)"


@query("ag_09_section_tree", with_tables("blocks", more=_SECTIONS) + "SELECT document_id, coalesce(title, 'main') AS title, count(*) AS blocks, min(ord) AS first_ord FROM h GROUP BY ALL")
def ag_09(s, d):
    return V.section_tree(V.sections(T.blocks(s, d)))


@query("ag_10_tasks_by_project", with_tables("tasks", "projects") + "SELECT p.title, count(*) AS tasks, string_agg(CAST(t.task_id AS STRING), ',' ORDER BY t.task_id) AS ids FROM tasks t JOIN projects p USING (project_id) WHERE t.status = 'queued' GROUP BY p.title")
def ag_10(s, d):
    both = T.tasks(s, d).where("status = 'queued'").join(T.projects(s, d).select("project_id", "title"), "project_id")
    return both.groupBy("title").agg(F.count("*").alias("tasks"), F.array_join(F.transform(F.array_sort(F.collect_list("task_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("ag_11_section_islands", with_tables("blocks", more=_SECTIONS) + "SELECT document_id, section_no::BIGINT AS island, min(ord) AS first_ord, max(ord) AS last_ord FROM h GROUP BY ALL")
def ag_11(s, d):
    return V.islands(V.sections(T.blocks(s, d)), "section_no")


@query("ag_14_context_meter", with_tables("turns") + "SELECT dialog_id, sum(length(text))::BIGINT AS chars, (sum(length(text)) // 4)::BIGINT AS used, least(100, round((sum(length(text)) // 4) * 100 / 2048.0))::INTEGER AS percent FROM turns GROUP BY dialog_id")
def ag_14(s, d):
    return V.context_meter(T.turns(s, d), 2048)


@query("ag_15_translatable_count", with_tables("blocks") + "SELECT document_id, count(*) FILTER (WHERE kind <> 'gap' AND trim(text) <> '') AS n FROM blocks GROUP BY document_id")
def ag_15(s, d):
    return T.blocks(s, d).groupBy("document_id").agg(F.count_if((F.col("kind") != "gap") & (F.trim("text") != "")).alias("n"))


@query("ag_22_throughput", with_tables("task_events") + "SELECT task_id, round(sum(length(message)) / greatest(sum(value) / 100, 0.05), 1)::DOUBLE AS chars_per_s FROM task_events GROUP BY task_id")
def ag_22(s, d):
    return V.throughput(T.task_events(s, d))


@query("ag_23_ordered_distinct", with_tables("tasks") + "SELECT project_id, string_agg(target_lang, ',' ORDER BY first) AS langs FROM (SELECT project_id, target_lang, min((created_at, task_id)) AS first FROM tasks GROUP BY ALL) GROUP BY project_id")
def ag_23(s, d):
    return V.ordered_distinct(T.tasks(s, d), "project_id", "target_lang", ["created_at", "task_id"], "langs")


@query("ag_24_languages_present", with_tables("tasks") + "SELECT DISTINCT target_lang FROM tasks")
def ag_24(s, d):
    return T.tasks(s, d).agg(F.sort_array(F.collect_set("target_lang")).alias("l")).select(F.explode("l").alias("target_lang"))


@query("ag_25_shared_suffixes", "WITH o AS (SELECT DISTINCT n_regionkey AS file, CASE WHEN n_nationkey % 4 = 0 THEN '.txt' WHEN n_nationkey % 4 = 1 THEN '.md' WHEN n_nationkey % 4 = 2 THEN '.docx' ELSE '.html' END AS suffix FROM nation) SELECT suffix FROM o GROUP BY suffix HAVING count(DISTINCT file) = (SELECT count(DISTINCT file) FROM o)")
def ag_25(s, d):
    n = F.col("n_nationkey") % 4
    offers = T.read(s, d, "nation").select(F.col("n_regionkey").alias("file"), F.when(n == 0, ".txt").when(n == 1, ".md").when(n == 2, ".docx").otherwise(".html").alias("suffix"))
    return V.in_all_groups(offers, "file", "suffix")


@query("ag_26_role_quant", with_tables("models", more="r AS (SELECT repo, filename, split_part(regexp_extract(filename, '(Q4_K_M|Q5_K_M|Q6_K|Q8_0|F16)', 1), '.', 1) AS quant FROM models WHERE registry = 'market')") + "SELECT repo, role, arg_min(filename, (pref, filename)) AS filename FROM (SELECT r.*, p.role, p.pref FROM r JOIN (VALUES ('light', 'Q4_K_M', 0), ('light', 'Q5_K_M', 1), ('full', 'Q8_0', 0), ('full', 'F16', 1), ('full', 'Q6_K', 2)) p(role, quant, pref) USING (quant)) GROUP BY ALL")
def ag_26(s, d):
    return V.first_by_preference(T.models(s, d).where("registry = 'market'"))


@query("ag_27_frequent_codes", with_tables("tasks", "projects") + "SELECT code, count(*) AS uses FROM (SELECT target_lang AS code FROM tasks UNION ALL SELECT lang_a FROM projects UNION ALL SELECT lang_b FROM projects) GROUP BY code ORDER BY uses DESC, code LIMIT 8")
def ag_27(s, d):
    p = T.projects(s, d)
    codes = T.tasks(s, d).select(F.col("target_lang").alias("code")).unionByName(p.select(F.col("lang_a").alias("code"))).unionByName(p.select(F.col("lang_b").alias("code")))
    return codes.groupBy("code").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "code").limit(8)


@query("ag_28_documents_per_project", with_tables("docs") + "SELECT project_id, count(*) AS documents FROM docs GROUP BY project_id")
def ag_28(s, d):
    return T.documents(s, d).groupBy("project_id").agg(F.count("*").alias("documents"))


@query("ag_29_completed_counter", with_tables("segments") + "SELECT task_id, count(DISTINCT (block_ord, segment_ord)) FILTER (WHERE status = 'complete') AS completed FROM segments GROUP BY task_id")
def ag_29(s, d):
    return T.segments(s, d).groupBy("task_id").agg(F.count_distinct(F.when(F.col("status") == "complete", F.struct("block_ord", "segment_ord"))).alias("completed"))


@query("ag_30_preferred_file", with_tables("exports") + "SELECT task_id, arg_min(path, (format <> 'pdf', id)) AS path FROM exports WHERE task_id IS NOT NULL GROUP BY task_id")
def ag_30(s, d):
    return T.exports(s, d).where("task_id IS NOT NULL").groupBy("task_id").agg(F.min_by("path", F.struct(F.col("format") != "pdf", "id")).alias("path"))


@query("ag_31_suggested_targets", with_tables("projects") + f"SELECT source_lang, arg_max(array_to_string(list_filter(CASE WHEN lang_a = lang_b THEN [lang_a] ELSE [lang_a, lang_b] END, lambda x: list_contains({_CODES}, x) AND x <> source_lang), ','), (updated_at, project_id)) AS targets FROM projects GROUP BY source_lang")
def ag_31(s, d):
    return V.suggested(T.projects(s, d), ["en", "ru", "de", "fr"])


# Orders


@query("ord_03_last_segments", with_tables("segments") + "SELECT task_id, block_ord, segment_ord FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY block_ord DESC, segment_ord DESC) AS n FROM segments WHERE status = 'complete') WHERE n <= 2")
def ord_03(s, d):
    return V.last_context(T.segments(s, d), 2).select("task_id", "block_ord", "segment_ord")


@query("ord_04_newest_complete", with_tables("tasks") + "SELECT document_id, target_lang, arg_max(task_id, (coalesce(updated_at, TIMESTAMP '1900-01-01'), task_id)) AS task_id FROM tasks WHERE status = 'complete' GROUP BY ALL")
def ord_04(s, d):
    return T.tasks(s, d).where("status = 'complete'").groupBy("document_id", "target_lang").agg(F.max_by("task_id", F.struct(F.coalesce("updated_at", F.expr("TIMESTAMP '1900-01-01'")), "task_id")).alias("task_id"))


@query("ord_06_newest_tasks", with_tables("tasks") + "SELECT task_id, created_at FROM tasks ORDER BY created_at DESC, task_id DESC LIMIT 50")
def ord_06(s, d):
    return T.tasks(s, d).select("task_id", "created_at").orderBy(F.desc("created_at"), F.desc("task_id")).limit(50)


@query("ord_08_last_messages", with_tables("turns") + "SELECT dialog_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY dialog_id ORDER BY turn DESC) AS n FROM turns) WHERE n <= 4")
def ord_08(s, d):
    ordered = T.turns(s, d).groupBy("dialog_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("m"))
    return ordered.select("dialog_id", F.explode(F.slice("m", F.greatest(F.size("m") - 3, F.lit(1)), F.lit(4))).alias("x")).select("dialog_id", "x.turn", "x.role")


@query("ord_09_results_order", with_tables("tasks") + "SELECT task_id, coalesce(updated_at, created_at) AS moment FROM tasks ORDER BY moment DESC, task_id LIMIT 100")
def ord_09(s, d):
    return T.tasks(s, d).select("task_id", F.coalesce("updated_at", "created_at").alias("moment")).orderBy(F.desc("moment"), "task_id").limit(100)


@query("ord_11_by_ram", with_tables("models") + "SELECT model_id, filename, estimated_ram_gb FROM models WHERE status = 'available' ORDER BY estimated_ram_gb DESC, filename, model_id LIMIT 20")
def ord_11(s, d):
    return T.models(s, d).where("status = 'available'").select("model_id", "filename", "estimated_ram_gb").orderBy(F.desc("estimated_ram_gb"), "filename", "model_id").limit(20)


@query("ord_16_same_settings", with_tables("projects") + "SELECT project_id, least(lang_a, lang_b) || ',' || greatest(lang_a, lang_b) = 'en,fr' AS same FROM projects")
def ord_16(s, d):
    return T.projects(s, d).select("project_id", (F.array_join(F.array_sort(F.array("lang_a", "lang_b")), ",") == F.lit("en,fr")).alias("same"))


# Sets


@query("set_01_union_catalogue", with_tables("models") + "SELECT registry, model_id FROM models WHERE registry = 'builtin' UNION ALL SELECT registry, model_id FROM models WHERE registry = 'market' UNION ALL SELECT registry, model_id FROM models WHERE registry = 'custom'")
def set_01(s, d):
    m = T.models(s, d).select("registry", "model_id")
    return m.where("registry = 'builtin'").unionByName(m.where("registry = 'market'")).unionByName(m.where("registry = 'custom'"))


@query("set_03_replace_by_key", with_tables("models") + "SELECT model_id, filename FROM models WHERE registry = 'custom' UNION ALL SELECT model_id, filename FROM models WHERE registry = 'builtin' AND model_id NOT IN (SELECT model_id FROM models WHERE registry = 'custom')")
def set_03(s, d):
    m = T.models(s, d)
    return V.replaced(m.where("registry = 'builtin'").select("model_id", "filename"), m.where("registry = 'custom'").select("model_id", "filename"), "model_id")


@query("set_04_same_rows", with_tables("exports") + "SELECT NOT EXISTS (SELECT id FROM exports EXCEPT SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) AND NOT EXISTS (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 EXCEPT SELECT id FROM exports) AS same")
def set_04(s, d):
    return V.same_rows(T.exports(s, d).select("id"), T.read(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id")))


@query("set_05_intersect", with_tables("tasks") + "SELECT target_lang FROM tasks WHERE status = 'complete' INTERSECT SELECT target_lang FROM tasks WHERE status = 'failed'")
def set_05(s, d):
    t = T.tasks(s, d)
    return t.where("status = 'complete'").select("target_lang").intersect(t.where("status = 'failed'").select("target_lang"))


@query("set_06_difference", with_tables("projects") + "SELECT project_id, array_to_string(list_filter(CASE WHEN lang_a = lang_b THEN [lang_a] ELSE [lang_a, lang_b] END, lambda x: x <> source_lang), ',') AS targets FROM projects")
def set_06(s, d):
    return T.projects(s, d).select("project_id", F.array_join(F.array_except(F.array("lang_a", "lang_b"), F.array("source_lang")), ",").alias("targets"))
