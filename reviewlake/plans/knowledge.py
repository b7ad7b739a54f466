"""Queries of vectors, rules, ingest, tasks, second pass, chunking and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text, vectors
from ..operators import chunking, dedupe, ingest, ranking, reports, search, secondpass, store, tasks
from ..sources import tables
from ..sources.scratch import scratch
from ..sources.tables import ISSUES_SQL, PATTERNS_SQL
from ..streaming import runs, sessions
from .registry import query

_DIST = "round(1 - list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6)"
_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("t06_knn", f"WITH {_E} SELECT query_id, sqlite_id, distance FROM (SELECT q.vec_id AS query_id, e.vec_id AS sqlite_id, {_DIST} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS rn FROM e q JOIN e ON q.vec_id <> e.vec_id) WHERE rn <= 10")
def t06(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.vectors(spark, sf)
    return search.nearest(rows.withColumnRenamed("sqlite_id", "query_id"), rows, 10, exclude_self=True)


@query("j02_similar_patterns", f"WITH {_E} SELECT query_id, sqlite_id, 1 - distance / 2 AS similarity FROM (SELECT q.vec_id AS query_id, e.vec_id AS sqlite_id, {_DIST} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS rn FROM e q JOIN e ON e.label = 0 WHERE q.vec_id % 20 = 0 AND q.label <> 0) WHERE rn <= 5")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.vectors(spark, sf)
    queries = rows.filter("sqlite_id % 20 = 0 and vector_layer != 'layer0'").withColumnRenamed("sqlite_id", "query_id")
    return search.nearest(queries, rows.filter("vector_layer = 'layer0'"), 5).select("query_id", "sqlite_id", vectors.similarity(F.col("distance")).alias("similarity"))


@query("j03_hit_rows", f"WITH {PATTERNS_SQL} SELECT vec_id AS sqlite_id, title, solution FROM embeddings JOIN patterns ON vec_id = id")
def j03(spark: SparkSession, sf: str) -> DataFrame:
    return tables.vectors(spark, sf).select("sqlite_id").join(tables.patterns(spark, sf), F.col("sqlite_id") == F.col("id")).select("sqlite_id", "title", "solution")


def _layer_sql(layer: str) -> str:
    known = {"error_type", "severity", "language", "framework", "error_description", "solution"}
    return " || chr(10) || ".join(f"'[{tag}] ' || {f if f in known else repr('')}" for tag, f in text.LAYERS[layer])


_EMBED = "[greatest(length(t), 1)::DOUBLE, (s % {0})::DOUBLE / {0}, (s % {1})::DOUBLE / {1}]"
_SUM = "CASE WHEN t = '' THEN 0 ELSE list_sum(list_transform(string_split(t, ''), lambda c: unicode(c)))::BIGINT END"


@query("x21_x22_layer_texts", f"WITH {PATTERNS_SQL} " + " UNION ALL ".join(f"SELECT id AS sqlite_id, '{layer}' AS vector_layer, {_layer_sql(layer)} AS text FROM patterns" for layer in text.LAYERS))
def x21(spark: SparkSession, sf: str) -> DataFrame:
    return store.vector_rows(tables.patterns(spark, sf)).select("sqlite_id", "vector_layer", "text")


@query("x23_x24_embeddings", f"SELECT doc_id, round(a[1], 6) AS a_length, round(a[2], 6) AS a_one, round(a[3], 6) AS a_two, round(b[2], 6) AS b_one, round(b[3], 6) AS b_two FROM (SELECT doc_id, {_EMBED.format(997, 389)} AS a, {_EMBED.format(991, 313)} AS b FROM (SELECT doc_id, t, {_SUM} AS s FROM (SELECT doc_id, text AS t FROM documents)))")
def x23(spark: SparkSession, sf: str) -> DataFrame:
    both = tables.table(spark, sf, "documents").select("doc_id", vectors.embed(F.col("text"), "A").alias("a"), vectors.embed(F.col("text"), "B").alias("b"))
    at = lambda c, k: F.round(F.get(c, F.lit(k)), 6)
    return both.select("doc_id", at("a", 0).alias("a_length"), at("a", 1).alias("a_one"), at("a", 2).alias("a_two"), at("b", 1).alias("b_one"), at("b", 2).alias("b_two"))


@query("x25_cosine", f"WITH {_E} SELECT e.vec_id, {_DIST} AS distance FROM e q JOIN e ON e.vec_id = q.vec_id + 1")
def x25(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.vectors(spark, sf)
    one, other = rows.select("sqlite_id", "vector"), rows.select((F.col("sqlite_id") + 1).alias("sqlite_id"), "vector")
    return ranking.exact_distance(one, other, "sqlite_id").withColumnRenamed("sqlite_id", "vec_id")


@query("k13_k17_vector_sync", f"WITH {PATTERNS_SQL} SELECT vector_layer, count(*) AS n FROM (SELECT unnest(['semantic', 'code_pattern', 'solution', 'full']) AS vector_layer, id FROM patterns WHERE status = 'active' OR id % 2 = 0) GROUP BY vector_layer")
def k13(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.patterns(spark, sf)
    held = store.vector_rows(rows.filter("id % 2 = 0"))
    return store.sync_vectors(held, rows, status="active").groupBy("vector_layer").agg(F.count("*").alias("n"))


@query("k15_delete_vectors", "SELECT count(*) AS n FROM embeddings WHERE vec_id % 5 <> 0")
def k15(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.vectors(spark, sf)
    return store.delete(rows, rows.filter("sqlite_id % 5 = 0").select("sqlite_id"), "sqlite_id").agg(F.count("*").alias("n"))


@query("s13_vector_fetch", "SELECT vec_id AS sqlite_id, 'layer' || label AS vector_layer FROM embeddings WHERE label = 3")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    return store.where(tables.vectors(spark, sf), vector_layer="layer3").select("sqlite_id", "vector_layer")


@query("d10_near_upsert", f"WITH {_E} SELECT q.vec_id, CASE WHEN 1 - min({_DIST}) / 2 >= 0.85 THEN 'update' ELSE 'insert' END AS action FROM e q JOIN e ON e.vec_id <> q.vec_id AND e.label <> q.label WHERE q.vec_id % 20 = 0 AND e.label = 1 AND q.label <> 1 GROUP BY q.vec_id")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.vectors(spark, sf)
    queries = rows.filter("sqlite_id % 20 = 0 and vector_layer != 'layer1'").withColumnRenamed("sqlite_id", "query_id")
    top = search.nearest(queries, rows.filter("vector_layer = 'layer1'"), 1)
    return top.select(F.col("query_id").alias("vec_id"), F.when(vectors.similarity(F.col("distance")) >= 0.85, "update").otherwise("insert").alias("action"))


# text rules over parts and documents

_SCORES = ("9.1", "7", "4.0", "3.9", "", "bad", "nan")


@query("x03_cvss_severity", f"SELECT p_partkey AS id, ['critical', 'high', 'medium', 'low', 'medium', 'medium', 'low'][p_partkey % {len(_SCORES)} + 1] AS severity FROM part")
def x03(spark: SparkSession, sf: str) -> DataFrame:
    score = F.element_at(F.array(*map(F.lit, _SCORES)), (F.col("p_partkey") % len(_SCORES) + 1).cast("int"))
    return tables.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), rules.score_severity(score).alias("severity"))


_CWES = ("CWE-119", "CWE-20", "CWE-362", "CWE-264", "CWE-399", "CWE-79", "")
_KINDS = ("", "DoS", "Overflow", "bypass something", " Race ")
_SUMMARIES = ("plain words", "a denial  of service", "memory leak found", "bad input here", "race condition. And then.", "out of bounds read", "privilege raised")
_PICK = lambda values, by: "[" + ", ".join(f"'{v}'" for v in values) + f"][p_partkey // {by} % {len(values)} + 1]"
_CVES_SQL = f"cves AS (SELECT p_partkey AS id, {_PICK(_CWES, 1)} AS cwe, lower(trim({_PICK(_KINDS, 7)})) AS kind, regexp_replace({_PICK(_SUMMARIES, 35)}, ' +', ' ', 'g') AS s FROM part), typed AS (SELECT *, CASE WHEN contains(kind, 'race') OR contains(s, 'race condition') OR cwe = 'CWE-362' THEN 'race_condition' WHEN contains(kind, 'overflow') OR contains(s, 'out of bounds') OR cwe IN ('CWE-119', 'CWE-189') THEN 'memory_overflow' WHEN contains(kind, 'bypass') OR contains(s, 'privilege') OR cwe = 'CWE-264' THEN 'authorization_bypass' WHEN contains(kind, 'dos') OR contains(s, 'denial of service') THEN 'dos' WHEN cwe = 'CWE-20' OR contains(s, 'validate') OR contains(s, 'input') THEN 'input_validation' WHEN cwe = 'CWE-399' OR contains(s, 'memory leak') THEN 'resource_exhaustion' ELSE 'general' END AS error_type FROM cves)"


def cves(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("p_partkey") / by) % len(values) + 1).cast("int"))
    return tables.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("cve_id"), pick(_CWES, 1).alias("cwe_id"), pick(_KINDS, 7).alias("vulnerability_classification"),
        pick(_SUMMARIES, 35).alias("summary"), F.lit("7.5").alias("score"), F.lit(" C ").alias("lang"), F.col("p_brand").alias("project"),
    )


def _texts_sql(table: dict[str, str]) -> str:
    return "CASE error_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@query("x04_x09_pattern_tasks", f"WITH {_CVES_SQL} SELECT 'CVE-' || id AS title, error_type, 'high' AS severity, 'C' AS language, s AS error_description, {_texts_sql(rules.PATTERN_TEXT)} || ' Evidence: ' || s AS problematic_pattern, {_texts_sql(rules.SOLUTION_TEXT)} AS solution FROM typed")
def x04(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.pattern_tasks(cves(spark, sf)).select("title", "error_type", "severity", "language", "error_description", "problematic_pattern", "solution")


@query("x07_split_summary", f"WITH {_CVES_SQL} SELECT id, CASE WHEN s LIKE 'race condition.%' THEN 'race condition.' ELSE s END AS phenomenon, CASE WHEN s LIKE 'race condition.%' THEN 'And then.' ELSE s END AS root_cause FROM cves")
def x07(spark: SparkSession, sf: str) -> DataFrame:
    return cves(spark, sf).select("id", text.split_summary(F.col("summary")).alias("p")).select("id", "p.phenomenon", "p.root_cause")


@query("x10_x13_dataset_records", f"SELECT {_PICK(_CWES, 1)} AS cwe, CASE {_PICK(_CWES, 1)} WHEN 'CWE-119' THEN 'buffer_error' WHEN 'CWE-20' THEN 'input_validation' WHEN 'CWE-79' THEN 'xss' ELSE 'security_vulnerability' END AS error_type, CASE {_PICK(_CWES, 1)} WHEN 'CWE-119' THEN 'high' ELSE 'medium' END AS severity, count(*) AS n FROM part GROUP BY cwe")
def x10(spark: SparkSession, sf: str) -> DataFrame:
    rows = cves(spark, sf).select(F.col("id").alias("idx"), F.col("cwe_id").alias("vulnerability"), F.lit("public class A").alias("func_before"), F.lit("x").alias("func_after"))
    return ingest.cwe_records(rows).groupBy(F.substring("tags", 8, 20).alias("cwe"), "error_type", "severity").agg(F.count("*").alias("n"))


@query("x01_x02_normalize", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normal, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS key FROM documents")
def x01(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("normal"), F.md5(text.norm_key(F.col("text"))).alias("key"))


@query("x19_sanitize_path", "SELECT page_id, CASE WHEN p = '' THEN 'unknown_file' ELSE p END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[^\\p{L}\\p{N}_.]', '_', 'g'), '_{2,}', '_', 'g'), '^_+|_+$', '', 'g') AS p FROM pages)")
def x19(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "pages").select("page_id", text.sanitize_path(F.col("url")).alias("name"))


@query("x45_cells", "SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS cell FROM (SELECT doc_id, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS t FROM documents)")
def x45(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select("doc_id", text.cell(F.col("text"), 80).alias("cell"))


@query("x49_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def x49(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("x43_history", "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE 'AI' END || ': ' || substr(text, 1, 100), chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 5 GROUP BY conv_id")
def x43(spark: SparkSession, sf: str) -> DataFrame:
    return reports.history(tables.table(spark, sf, "conversations"))


@query("w07_session_memory", "SELECT conv_id AS session_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) <= 20")
def w07(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "assistant", "ai").otherwise("user").alias("type"))
    return sessions.session_memory(rows).groupBy("session_id").agg(F.count("*").alias("n")).filter("n <= 20")


@query(
    "w07_long_sessions",
    f"WITH {ISSUES_SQL}, m AS (SELECT requirement_id, ord, row_number() OVER (PARTITION BY requirement_id ORDER BY ord) AS n, CASE WHEN source IN ('view', 'error') THEN 1 ELSE 0 END AS ai FROM issues), "
    "s AS (SELECT requirement_id, list_reduce(list(n * 2 + ai ORDER BY n), lambda a, x: CASE WHEN x % 2 = 1 AND x // 2 - a + 1 > 20 THEN x // 2 - 14 ELSE a END, 1::BIGINT) AS start FROM m GROUP BY requirement_id) "
    "SELECT m.requirement_id AS session_id, m.ord FROM m JOIN s ON s.requirement_id = m.requirement_id AND m.n >= s.start",
)
def w07_long(spark: SparkSession, sf: str) -> DataFrame:
    """Events as messages of their user's session, views and errors as answers."""
    rows = tables.issues(spark, sf).select(F.col("requirement_id").alias("session_id"), "ord", F.when(F.col("source").isin("view", "error"), "ai").otherwise("user").alias("type"))
    return sessions.session_memory(rows).select("session_id", "ord")


# tasks

_ACTIONS = ("INSERT", "please show", "delete all", "truncate it", "delete", "modify", "fetch", "sync", "remove", "unknown", "update")
_TARGETS = ("review_sessions", "pattern", "issue", "other")


def raw_tasks(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    where = F.concat(F.lit("id IN ("), (F.col("p_partkey") % 3).cast("string"), F.lit(", 4) or ID = 9"))
    data = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("where"), where, F.lit("severity"), F.lit("low"), F.lit("odd"), F.lit("x"))).otherwise(F.create_map(F.lit("title"), F.col("p_name"), F.lit("junk"), F.lit("y")))
    return tables.table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), pick(_TARGETS).alias("target"), pick(_ACTIONS).alias("action"), data.alias("data"))


_NORMAL = "['create', 'query', 'delete_all', 'delete_all', CASE WHEN p_size % 2 = 0 THEN 'delete_by_ids' ELSE 'delete' END, 'upsert', 'query', 'sync', CASE WHEN p_size % 2 = 0 THEN 'delete_by_ids' ELSE 'delete' END, 'upsert', 'upsert']"
_TASKS_SQL = f"SELECT p_partkey AS ord, ['review_session', 'issue_pattern', 'curated_issue', 'other'][p_partkey % 4 + 1] AS target, CASE WHEN p_partkey % 11 = 5 OR p_partkey % 11 = 10 THEN 'upsert' ELSE {_NORMAL}[p_partkey % 11 + 1] END AS action FROM part"


@query("x39_normalize_tasks", _TASKS_SQL)
def x39(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.normalize(raw_tasks(spark, sf), "s").select("ord", "target", "action")


@query("x40_delete_ids", "SELECT p_partkey AS ord, CASE WHEN p_size % 2 = 0 THEN '9,' || (p_partkey % 3) || ',4' ELSE '' END AS ids FROM part")
def x40(spark: SparkSession, sf: str) -> DataFrame:
    return raw_tasks(spark, sf).select("ord", F.concat_ws(",", tasks.delete_ids().cast("array<string>")).alias("ids"))


@query("a11_task_counts", f"SELECT target, action, count(*) AS count FROM ({_TASKS_SQL}) GROUP BY target, action")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.counts(tasks.normalize(raw_tasks(spark, sf), "s"))


@query("a30_mode", "SELECT 'delete' AS mode")
def a30(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.mode(tasks.normalize(raw_tasks(spark, sf), "s"))


@query("f07_task_filter", f"SELECT count(*) AS n FROM ({_TASKS_SQL}) WHERE target IN ('issue_pattern', 'curated_issue') AND action IN ('upsert', 'create')")
def f07(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.normalize(raw_tasks(spark, sf), "s").filter(F.col("target").isin("issue_pattern", "curated_issue") & F.col("action").isin("upsert", "create")).agg(F.count("*").alias("n"))


@query("f08_field_whitelist")
def f08(spark: SparkSession, sf: str) -> DataFrame:
    """Kept fields of every task; deletes keep their list of ids too."""
    rows = tasks.normalize(raw_tasks(spark, sf), "s")
    return rows.select("ord", "target", "action", F.array_join(F.array_sort(F.map_keys("data")), ",").alias("keys"))


@query("f09_confirm_by_batch", f"SELECT ord % 150 AS batch, bool_or(action IN ('delete', 'delete_all')) AS need_confirm FROM ({_TASKS_SQL}) GROUP BY batch")
def f09_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = tasks.normalize(raw_tasks(spark, sf), "s").withColumn("batch", F.col("ord") % 150)
    return tasks.needs_confirm(rows, "batch")


@query("f09_needs_confirm", "SELECT true AS need_confirm")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.needs_confirm(tasks.normalize(raw_tasks(spark, sf), "s"))


@query("u06_fan_out", "SELECT unnest(CASE WHEN n_regionkey = 0 THEN ['issue_pattern', 'review_session', 'curated_issue'] ELSE ['pattern'] END) AS target, n_nationkey::BIGINT AS nation FROM nation")
def u06(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.when(F.col("n_regionkey") == 0, "ALL").otherwise("pattern").alias("target"), F.lit("delete_all").alias("action"), F.create_map().cast("map<string,string>").alias("data"))
    return tasks.fan_out(rows).select("target", F.floor(F.col("ord") / 3).cast("long").alias("nation"))


@query("t09_execution_order", f"SELECT ord, CASE target WHEN 'issue_pattern' THEN 0 WHEN 'review_session' THEN 1 WHEN 'curated_issue' THEN 2 ELSE 50 END AS priority FROM ({_TASKS_SQL})")
def t09(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.execution_order(raw_tasks(spark, sf)).select("ord", "priority")


@query("u05_complete_tasks", "SELECT 'issue_pattern' AS target, count(*) AS n FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT 'review_session', 1 UNION ALL SELECT 'curated_issue', 1")
def u05(spark: SparkSession, sf: str) -> DataFrame:
    """The tasks that name patterns, with a default task for each table that none of them names."""
    done = tasks.complete(raw_tasks(spark, sf).filter("target = 'pattern'"), "words", "s")
    return done.groupBy(tasks.lookup(F.col("target"), tasks.TARGET_ALIASES, "").alias("target")).agg(F.count("*").alias("n"))


@query("f12_validation")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    """Errors and warnings of all tasks, as they come out of normalising."""
    return ingest.validate(tasks.normalize(raw_tasks(spark, sf), "s"))


@query("a10_ingest_summary", f"SELECT 'target' AS kind, target AS name, count(*) AS n FROM ({_TASKS_SQL}) GROUP BY target UNION ALL SELECT 'severity', 'low', count(*) FROM part WHERE p_size % 2 = 0 AND p_partkey % 4 IN (1, 2, 3)")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.summary(tasks.normalize(raw_tasks(spark, sf), "s"))


@query("a12_result_fields", "SELECT field, count(*) AS n FROM (SELECT unnest(CASE WHEN p_size % 2 = 0 THEN ['where', 'severity', 'odd'] ELSE ['title', 'junk'] END) AS field FROM part) GROUP BY field")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_tasks(spark, sf).select("target", "action", F.lit("success").alias("status"), "data", F.col("ord").cast("string").alias("row_id"))
    return tasks.fields_of(rows).groupBy("field").agg(F.count("*").alias("n"))


# second pass

@query("j01_text_evidence", "SELECT doc_id AS issue_ord, item_id AS id FROM (SELECT doc_id, item_id, row_number() OVER (PARTITION BY doc_id ORDER BY item_id) AS rn FROM documents JOIN (SELECT * FROM benchmark ORDER BY item_id LIMIT 200) b ON contains(lower(trim(documents.text)), lower(substr(trim(b.text), 1, 32)))) WHERE rn <= 5")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    known = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), none.alias("error_type"), F.col("text").alias("error_description"), F.lit("high").alias("severity"), none.alias("solution"), F.lit("active").alias("status"))
    issues = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("description"), F.lit("").alias("source"))
    return secondpass.text_evidence(issues, known).select("issue_ord", "id")


_TYPES = ("click", "error 7", "signup", "purchase", "view 9")
_EV = f"{_E}, {ISSUES_SQL}, ev AS (SELECT ord AS issue_ord, h AS hit_ord, ord % 100 + h AS sqlite_id, {list(_TYPES)}[(ord + h) % 5 + 1] AS error_type, ['critical', 'high', 'medium', 'low'][(ord + h) % 4 + 1] AS severity, 0.7 + ((ord * 7 + h) % 30)::DOUBLE / 100 AS similarity FROM issues, range(3) t(h))"


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    rows = tables.issues(spark, sf).select(F.col("ord").alias("issue_ord"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("hit_ord"))
    o, h = F.col("issue_ord"), F.col("hit_ord")
    return rows.select("issue_ord", "hit_ord", (o % 100 + h).alias("sqlite_id"), pick(_TYPES, o + h).alias("error_type"), pick(("critical", "high", "medium", "low"), o + h).alias("severity"), (0.7 + ((o * 7 + h) % 30).cast("double") / 100).alias("similarity"))


@query("t14_best_hit", f"WITH {_EV} SELECT issue_ord, hit_ord FROM (SELECT *, row_number() OVER (PARTITION BY issue_ord ORDER BY similarity DESC, hit_ord) AS rn FROM ev) WHERE rn = 1")
def t14(spark: SparkSession, sf: str) -> DataFrame:
    return secondpass.best_hits(evidence(spark, sf)).select("issue_ord", F.col("hit_ord").cast("long").alias("hit_ord"))


@query("r02_corrections", f"WITH {_EV}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issue_ord ORDER BY similarity DESC, hit_ord) AS rn FROM ev) WHERE rn = 1) SELECT ord, CASE WHEN b.similarity >= 0.78 THEN b.severity ELSE i.severity END AS severity, CASE WHEN b.similarity >= 0.78 AND b.severity <> i.severity THEN source || '_db_corrected' ELSE source END AS source, CASE WHEN b.similarity >= 0.78 AND b.severity <> i.severity THEN i.severity END AS old_severity FROM issues i JOIN best b ON i.ord = b.issue_ord")
def r02(spark: SparkSession, sf: str) -> DataFrame:
    return secondpass.corrections(tables.issues(spark, sf), evidence(spark, sf)).select("ord", "severity", "source", "old_severity")


@query("r03_t15_findings", f"WITH {_EV} SELECT run_id, ord, hit_ord, '历史知识命中，可能漏报: ' || error_type AS description, severity FROM (SELECT i.run_id, i.ord, e.hit_ord, e.error_type, e.severity, row_number() OVER (PARTITION BY i.run_id ORDER BY i.ord, e.hit_ord) AS rn FROM issues i JOIN ev e ON e.issue_ord = i.ord WHERE e.similarity >= 0.78::DOUBLE + 0.06::DOUBLE AND NOT contains(lower(i.description), lower(e.error_type))) WHERE rn <= 5")
def r03(spark: SparkSession, sf: str) -> DataFrame:
    rows = secondpass.findings(tables.issues(spark, sf), evidence(spark, sf), secondpass.THRESHOLD, 5, "run_id")
    return rows.select("run_id", "ord", F.col("hit_ord").cast("long").alias("hit_ord"), "description", "severity")


@query("r04_second_pass")
def r04(spark: SparkSession, sf: str) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("id") % len(_TYPES) + 1).cast("int"))
    known = tables.patterns(spark, sf).withColumn("text", F.concat(F.lit("["), pick, F.lit("] "), "title"))
    vectors_ = known.select(F.col("id").alias("sqlite_id"), vectors.embed(F.col("text")).alias("vector"), "error_type", "severity")
    return secondpass.second_pass(tables.issues(spark, sf).drop("score"), vectors_, "run_id")


# chunking

@query("p01_looks_like_code", f"WITH {tables.files_sql()}, l AS (SELECT file_id, content, unnest(string_split(content, chr(10))) AS t FROM files) SELECT file_id, sum(m) >= 2 OR (any_value(length(content) - length(replace(content, chr(10), ''))) + CASE WHEN any_value(content) LIKE '%' || chr(10) THEN 0 ELSE 1 END >= 4 AND sum(m) >= 1) AS code FROM (SELECT *, (" + " OR ".join(f"starts_with(ltrim(t), '{s}')" for s in chunking.CODE_STARTS) + " OR " + " OR ".join(f"ends_with(rtrim(t), '{s}')" for s in chunking.CODE_ENDS) + ")::INT AS m FROM l) GROUP BY file_id")
def p01(spark: SparkSession, sf: str) -> DataFrame:
    return tables.files(spark, sf).select("file_id", chunking.looks_like_code(F.col("content")).alias("code"))


@query("p02_sentences", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(coalesce(text, '')), '([。！？!?.])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''))::INTEGER AS n FROM documents")
def p02(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select("doc_id", F.size(chunking.sentences(F.col("text"))).alias("n"))


@query("p04_units")
def p04(spark: SparkSession, sf: str) -> DataFrame:
    return tables.files(spark, sf).select("file_id", F.size(chunking.unit_list(F.col("content"))).alias("n"))


@query("p03_code_blocks")
def p03(spark: SparkSession, sf: str) -> DataFrame:
    return tables.files(spark, sf).select("file_id", F.size(chunking.code_blocks(F.col("content"))).alias("n"))


@query("p05_token_estimate", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS n FROM documents")
def p05(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select("doc_id", chunking.token_estimate(F.col("text")).cast("long").alias("n"))


@query("p06_truncate")
def p06(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select("doc_id", F.length(chunking.truncated(F.col("text"), F.lit(100))).alias("n"))


@query("p07_prompt_budget", "SELECT p_partkey AS id, greatest(0, 1024 - least(greatest(16, p_size), 992) - 32) AS input_budget, least(greatest(16, p_size), 992) AS new_tokens FROM part")
def p07(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), chunking.prompt_budget(F.lit(1024), F.col("p_size")).alias("b")).select("id", "b.input_budget", "b.new_tokens")


@query("p08_segments")
def p08(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select("doc_id", F.size(chunking.packed(F.split("text", "\n"), F.lit(200))).alias("n"))


@query(
    "p09_semantic_chunks",
    f"WITH {ISSUES_SQL}, u AS (SELECT lower('f|' || source || '|' || severity || '|' || tool || '|' || CASE requirement_id % 3 WHEN 0 THEN '' ELSE (requirement_id % 3)::VARCHAR END) AS signature, ord, "
    """length('{"ord":' || ord || ',"requirement_id":' || (requirement_id % 3) || ',"file":"f","source":"' || source || '","severity":"' || severity || '","line":' || line || ',"description":"' || description || '","tool":"' || tool || '","run_id":"' || run_id || '","score":' || score::DOUBLE || '}') AS size FROM issues), """
    "g AS (SELECT signature, list(size ORDER BY ord) AS sizes FROM u GROUP BY signature), "
    "r AS (SELECT signature, ord, row_number() OVER (PARTITION BY signature ORDER BY ord) AS rn FROM u) "
    "SELECT signature, list_reduce(list_slice(sizes, 1, rn), lambda a, x: CASE WHEN a % 1000000000 + x > 9000 THEN (a // 1000000000 + 1) * 1000000000 + x ELSE a + x END, 0::BIGINT) // 1000000000 AS chunk, ord FROM r JOIN g USING (signature)",
)
def p09(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.semantic_chunks(tables.issues(spark, sf).withColumn("requirement_id", F.col("requirement_id") % 3).withColumn("file", F.lit("f")))


@query("c07_line_chunks", f"WITH {tables.files_sql()} SELECT file_id, CAST(list_reduce(list_transform(string_split(content, chr(10)), lambda x: length(x)::BIGINT), lambda a, x: CASE WHEN a > 0 AND a % 1000000000 + x <= 800 THEN a + x ELSE (a // 1000000000 + 1) * 1000000000 + x END, 0::BIGINT) // 1000000000 AS INTEGER) AS n FROM files")
def c07(spark: SparkSession, sf: str) -> DataFrame:
    return tables.files(spark, sf).select("file_id", F.size(chunking.line_chunks(F.col("content"))).alias("n"))


@query("c08_token_chunks")
def c08(spark: SparkSession, sf: str) -> DataFrame:
    return tables.files(spark, sf).select("file_id", F.size(chunking.token_chunks(F.col("content"))).alias("n"))


# reports and streams

@query("k20_consolidated_reports", f"WITH {ISSUES_SQL} SELECT requirement_id, count(*) AS issue_count, min(ord) AS first_ord, max(ord) AS last_ord FROM issues GROUP BY requirement_id")
def k20(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.consolidated(tables.issues(spark, sf), "requirement_id")
    return rows.select("requirement_id", "issue_count", F.get("issues", F.lit(0))["ord"].alias("first_ord"), F.element_at("issues", -1)["ord"].alias("last_ord"))


@query("x47_markdown", f"WITH {ISSUES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY severity, source ORDER BY ord) AS rn, count(*) OVER (PARTITION BY severity, source) AS n FROM issues) SELECT severity, source, '### ' || CASE severity WHEN 'critical' THEN '🚨 严重' WHEN 'high' THEN '🔴 高' WHEN 'medium' THEN '🟡 中' ELSE '🟢 低' END || ' / ' || source || chr(10) || string_agg('- ' || description || ' (line ' || line || ')', chr(10) ORDER BY ord) || CASE WHEN max(n) > 5 THEN chr(10) || '- ... ' || (max(n) - 5) || ' more' ELSE '' END AS markdown FROM r WHERE rn <= 5 GROUP BY severity, source")
def x47(spark: SparkSession, sf: str) -> DataFrame:
    return reports.markdown_summary(tables.issues(spark, sf))


@query("k24_export_lines", "SELECT page_id, '- **url**: ' || substr(url, 1, 500) AS markdown, '<h2>url</h2><pre>' || replace(replace(replace(replace(replace(substr(url, 1, 1000), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || '</pre>' AS html FROM pages")
def k24(spark: SparkSession, sf: str) -> DataFrame:
    line = lambda form: reports.export_line(F.lit("url"), F.col("url"), form)
    return tables.table(spark, sf, "pages").select("page_id", line("markdown").alias("markdown"), line("html").alias("html"))


@query("k19_grouped_union", "SELECT 'nation' AS target, n_name AS name, n_regionkey AS key, CAST(NULL AS VARCHAR) AS extra FROM nation UNION ALL SELECT 'region', r_name, NULL, r_name FROM region")
def k19(spark: SparkSession, sf: str) -> DataFrame:
    nation = tables.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("key"))
    region = tables.table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_name").alias("extra"))
    return reports.grouped_union({"nation": nation, "region": region})


def run_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Announcements and results from events: a run a user, requirements by value, types by event type."""
    e = tables.issues(spark, sf)
    kind = tables.lookup_types(F.col("source"))
    results = e.select(F.concat(F.lit("r"), F.col("requirement_id").cast("string")).alias("run_id"), F.col("ord"), F.lit("analysis_result").alias("message_type"), (F.col("line") % 4).alias("requirement_id"), F.lit(None).cast("array<long>").alias("requirement_ids"), kind.alias("analysis_type"), (F.col("line") % 13).alias("issue_count"))
    first = e.groupBy(F.concat(F.lit("r"), F.col("requirement_id").cast("string")).alias("run_id")).agg((F.min("ord") - 1).alias("ord"))
    told = first.select("run_id", "ord", F.lit("run_init").alias("message_type"), F.lit(None).cast("long").alias("requirement_id"), F.array(*[F.lit(k).cast("long") for k in range(4)]).alias("requirement_ids"), F.lit(None).cast("string").alias("analysis_type"), F.lit(None).cast("long").alias("issue_count"))
    return results.unionByName(told)


@query(
    "w03_run_events",
    f"WITH {ISSUES_SQL}, m AS (SELECT 'r' || requirement_id AS run_id, ord, line % 4 AS req, line % 13 AS n, CASE WHEN source IN ('click', 'view') THEN 'static_analysis' WHEN source = 'error' THEN 'security_analysis' WHEN source = 'purchase' THEN 'performance_analysis' ELSE 'ai_analysis' END AS kind FROM issues), "
    "f AS (SELECT run_id, req, kind, min(ord) AS o FROM m GROUP BY run_id, req, kind), "
    "t AS (SELECT f.run_id, f.req, f.o, string_agg(g.kind, ',' ORDER BY g.kind) AS types FROM f JOIN f g ON g.run_id = f.run_id AND g.req = f.req AND g.o <= f.o GROUP BY f.run_id, f.req, f.o), "
    "r AS (SELECT t.run_id, t.req, t.o, t.types, arg_max(m.n, m.ord) AS n FROM t JOIN m ON m.run_id = t.run_id AND m.req = t.req AND m.kind = 'static_analysis' AND m.ord <= t.o GROUP BY t.run_id, t.req, t.o, t.types), "
    "c AS (SELECT run_id, req, arg_min(n, o) AS n FROM r WHERE types LIKE '%ai_analysis%' GROUP BY run_id, req) "
    "SELECT run_id, 'report' AS event, CAST(req AS BIGINT) AS requirement_id, types, CAST(n AS BIGINT) AS issue_count, CAST(NULL AS BIGINT) AS expected, CAST(NULL AS BIGINT) AS completed FROM r "
    "UNION ALL SELECT run_id, 'run_completed', NULL, NULL, CAST(sum(n) AS BIGINT), 4, 4 FROM c GROUP BY run_id HAVING count(*) = 4",
)
def w03(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_events_batch(run_messages(spark, sf)).drop("ord")


@query(
    "w04_late_results",
    f"WITH {ISSUES_SQL}, m AS (SELECT 'r' || requirement_id AS run_id, ord, line % 4 AS req, CASE WHEN source IN ('click', 'view') THEN 'static_analysis' WHEN source = 'error' THEN 'security_analysis' WHEN source = 'purchase' THEN 'performance_analysis' ELSE 'ai_analysis' END AS kind FROM issues), "
    "f AS (SELECT run_id, req, kind, min(ord) AS o FROM m GROUP BY run_id, req, kind), "
    "s AS (SELECT run_id, req, o AS static FROM f WHERE kind = 'static_analysis'), "
    # a report for the static result, with the types that were there before, and one for each type after it
    "r AS (SELECT f.run_id, f.req, f.o, (SELECT string_agg(g.kind, ',' ORDER BY g.kind) FROM f g WHERE g.run_id = f.run_id AND g.req = f.req AND g.o <= f.o) AS types FROM f JOIN s ON s.run_id = f.run_id AND s.req = f.req AND f.o >= s.static), "
    "c AS (SELECT run_id, req, min(o) AS o FROM r WHERE types LIKE '%ai_analysis%' GROUP BY run_id, req), "
    "closed AS (SELECT run_id, max(o) AS o FROM c GROUP BY run_id HAVING count(*) = 4) "
    "SELECT r.run_id, CAST(r.req AS BIGINT) AS requirement_id, r.types, r.o AS ord FROM r JOIN closed ON closed.run_id = r.run_id AND r.o > closed.o",
)
def w04(spark: SparkSession, sf: str) -> DataFrame:
    """The stream itself, in four micro-batches with state between them; what it reports after a run's summary."""
    source, out = scratch(spark, "messages"), scratch(spark, "events")
    messages = run_messages(spark, sf)
    least, most = messages.agg(F.min("ord"), F.max("ord")).first()
    part = F.least(F.lit(3), F.floor((F.col("ord") - (least or 0)) * 4 / ((most or 0) - (least or 0) + 1)))
    state = scratch(spark, "events-state")
    for k in range(4):  # what all tasks have written since is one micro-batch; the stream goes on from its state
        messages.filter(part == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(messages.schema).parquet(source)
        if not runs.run_available(runs.run_events(stream), out, state):
            raise TimeoutError("the stream did not end in time")
    return runs.late_reports(spark.read.schema(runs.EVENTS).parquet(out)).select("run_id", "requirement_id", "types", "ord")


@query("w06_progress_changes", f"WITH {ISSUES_SQL} SELECT run_id, ord FROM (SELECT run_id, ord, line // 10 AS c, lag(line // 10) OVER (PARTITION BY run_id ORDER BY ord) AS b FROM issues) WHERE b IS NULL OR b <> c")
def w06(spark: SparkSession, sf: str) -> DataFrame:
    return runs.progress_changes(tables.issues(spark, sf).select("run_id", "ord", F.floor(F.col("line") / 10).alias("completed"))).select("run_id", "ord")


@query("w08_pending_state", f"WITH {ISSUES_SQL} SELECT requirement_id AS session_id, CASE WHEN arg_max(line, ord) % 2 = 0 THEN arg_max(description, ord) END AS pending FROM issues GROUP BY requirement_id")
def w08(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("line") % 2 == 0, "set").otherwise("clear")
    return sessions.pending_state(tables.issues(spark, sf).select(F.col("requirement_id").alias("session_id"), "ord", op.alias("op"), F.col("description").alias("pending")))


@query("w01_routing", "SELECT event_type AS receiver, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def w01(spark: SparkSession, sf: str) -> DataFrame:
    agents = spark.createDataFrame([("click",), ("view",)], "agent_id string")
    return runs.route(tables.table(spark, sf, "events").withColumnRenamed("event_type", "receiver"), agents).groupBy("receiver").agg(F.count("*").alias("n"))


@query(
    "w09_cache_replay",
    "WITH a AS (SELECT user_id, event_id, event_type, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS before FROM events), "
    "d AS (SELECT a.user_id, a.event_id, count(DISTINCT b.event_type) AS others FROM a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.before AND b.event_id < a.event_id AND b.event_type <> a.event_type GROUP BY a.user_id, a.event_id) "
    "SELECT a.user_id, count(*) AS requests, count_if(a.before IS NOT NULL AND coalesce(d.others, 0) < 3) AS hits FROM a LEFT JOIN d ON a.user_id = d.user_id AND a.event_id = d.event_id GROUP BY a.user_id",
)
def w09(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of a cache of three event types for each user."""
    accesses = tables.table(spark, sf, "events").select(F.col("user_id").alias("cache"), F.col("event_id").alias("ord"), F.col("event_type").alias("key"))
    return runs.cache_replay(accesses, 3).groupBy(F.col("cache").alias("user_id")).agg(F.count("*").alias("requests"), F.sum(F.col("hit").cast("long")).alias("hits"))


@query("w11_dispatch", "SELECT unnest(['static_scan_request', 'quality_analysis_request', 'security_analysis_request', 'performance_analysis_request']) AS message_type, c_custkey AS requirement_id FROM customer")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    return runs.dispatch(tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("requirement_id")))


@query("d03_merge_plans")
def d03(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.issues(spark, sf)
    category = F.element_at(F.array(*map(F.lit, dedupe.PLAN_CATEGORIES)), (F.col("line") % 3 + 1).cast("int"))
    items = e.select(F.col("requirement_id").alias("plan_id"), category.alias("category"), F.col("ord").alias("pos"), F.col("source").alias("type"), F.concat(F.lit("d"), (F.col("line") % 9).cast("string")).alias("description"), F.lit("r").alias("recommendation"), F.col("severity").alias("priority"), F.when(F.col("line") % 2 == 0, "effect").alias("expected_effect"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("reason"))
    return dedupe.merge_plans(items)


@query("d04_j11_remediation", f"WITH {ISSUES_SQL}, f AS (SELECT requirement_id AS plan_id, ord, CASE WHEN severity IN ('critical', 'high') THEN 1 WHEN severity = 'medium' THEN 2 ELSE 3 END AS b, lower(description) AS t FROM issues), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, t ORDER BY b, ord) AS rn FROM f) WHERE rn = 1) SELECT plan_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, b ORDER BY ord) AS p FROM once) WHERE p <= 10")
def d04(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.issues(spark, sf)
    fixes = e.select(F.col("requirement_id").alias("plan_id"), "ord", ranking.remediation_bucket(F.col("severity")).alias("bucket"), F.initcap("description").alias("fix"))
    advice = e.select(F.col("requirement_id").alias("plan_id"), "ord", F.col("source").alias("category"), F.col("description").alias("recommendation"))
    return dedupe.dedupe_remediation(fixes, advice)[0].select("plan_id", "ord")
