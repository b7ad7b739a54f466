"""Queries of sources and sinks, answers, envelopes, the model registry and the remaining joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers, repair, rules, text, vectors
from ..operators import aggregate, chunking, dedupe, idsets, ingest, lines, models, ranking, reports, secondpass, store, tasks, toolparse
from ..schema import lookup
from ..sources import files as file_sources
from ..sources import tables
from ..sources.scratch import scratch
from ..sources.tables import ISSUES_SQL
from ..streaming import runs
from .code import tool_outputs
from .issues import with_issues
from .registry import SQL, query

FILES = f"WITH {tables.files_sql()} "


# sources and sinks


#: Folders and endings that the file readers tell apart, dealt to the files by their ids.
_FOLDERS = ("src", "env", ".svn", "target", "node_modules", "lib")
_ENDINGS = (".py", ".rb", ".cs", ".hxx", ".ts", ".go", ".RS", ".md", "_login.txt", ".php", ".h", "")
_PATHS = f"paths AS (SELECT file_id, content, 'dir' || (file_id % 41) || '/' || {list(_FOLDERS)}[file_id % 6 + 1] || '/f' || file_id || {list(_ENDINGS)}[file_id % 12 + 1] AS path FROM files)"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("file_id") % len(names) + 1).cast("int"))
    path = F.concat(F.lit("dir"), (F.col("file_id") % 41).cast("string"), F.lit("/"), pick(_FOLDERS), F.lit("/f"), F.col("file_id").cast("string"), pick(_ENDINGS))
    return tables.files(spark, sf).select("file_id", "content", path.alias("path"))


@query("s02_source_filter", FILES + f", {_PATHS} SELECT path FROM paths WHERE regexp_matches(path, '[.](py|c|h|cpp|hpp|cc|cxx|js|ts|java|go|rs|rb|php)$') AND NOT regexp_matches(path, '/([.]git|[.]svn|node_modules|__pycache__|venv|env|[.]venv|dist|build|[.]idea|[.]vscode)/')")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).filter(file_sources.is_source(F.col("path"))).select("path")


@query("s03_s07_safe_texts", FILES + "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 0 ELSE length(content) END AS n FROM files")
def s03(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.files(spark, sf)
    return file_sources.safe_texts(rows.select("file_id", "path"), rows.filter("file_id % 3 != 0").select("path", "content")).select("file_id", F.length("content").alias("n"))


_LOOKED_AT = r"r AS (SELECT * FROM (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '[^./][^/]*?([.][^./]*)$', 1)) AS ext, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY path) AS rn FROM paths) WHERE rn <= 15)"
_HEADER_LANGUAGE = "CASE WHEN l LIKE '%namespace%' OR l LIKE '%std::%' OR l LIKE '%template%' THEN 'cpp' WHEN l LIKE '%#include%' OR l LIKE '%printf%' THEN 'c' ELSE 'c_cpp_header' END"
_MARK_SCORES = "(content LIKE '%def %')::INT + (content LIKE '%import %')::INT + (content LIKE '%class %')::INT + (content LIKE '%\\_\\_init\\_\\_%' ESCAPE '\\')::INT + (content LIKE '%self.%')::INT AS py, (l LIKE '%#include%')::INT + (l LIKE '%namespace%')::INT + (l LIKE '%std::%')::INT + (l LIKE '%cout%')::INT + (l LIKE '%cin%')::INT AS cpp, (l LIKE '%#include%')::INT + (l LIKE '%printf%')::INT + (l LIKE '%scanf%')::INT + (l LIKE '%malloc%')::INT + (l LIKE '%free%')::INT AS c"
_READ_LANGUAGE = f"CASE WHEN ext = '.py' THEN 'python' WHEN ext IN ('.h', '.hxx') THEN {_HEADER_LANGUAGE} WHEN greatest(py, cpp, c) = 0 THEN 'unknown' WHEN py >= greatest(cpp, c) THEN 'python' WHEN cpp >= c THEN 'cpp' ELSE 'c' END"


@query(
    "s04_quality_files",
    FILES
    + f", {_PATHS}, {_LOOKED_AT}, m AS (SELECT *, {_MARK_SCORES} FROM (SELECT *, lower(content) AS l FROM r WHERE ext IN ('.py', '.cpp', '.cxx', '.cc', '.c', '.h', '.hpp', '.hxx', '.js', '.java', '.cs', '.go', '.rs'))), "
    f"k AS (SELECT folder, path, length(chr(10) || '# File: ' || name || ' (' || ext || ')' || chr(10) || '# Path: ' || path || chr(10) || '# Language: ' || {_READ_LANGUAGE} || chr(10) || content || chr(10)) AS n FROM m), "
    "b AS (SELECT folder, coalesce(sum(n) OVER (ORDER BY folder ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT folder, sum(n) AS n FROM k GROUP BY folder)) SELECT k.folder, k.path, k.n::INTEGER AS n FROM k JOIN b USING (folder) WHERE before <= 15000",
)
def s04(spark: SparkSession, sf: str) -> DataFrame:
    return file_sources.quality_files(_paths(spark, sf)).select("folder", "path", F.length("content").alias("n"))


@query(
    "s05_security_files",
    FILES
    + f", {_PATHS}, {_LOOKED_AT}, k AS (SELECT * FROM r WHERE ext IN ('.py', '.cpp', '.cxx', '.cc', '.c', '.h', '.hpp', '.js', '.java', '.php') OR regexp_matches(lower(name), 'auth|login|password|security|crypto|hash')), "
    "b AS (SELECT folder, coalesce(sum(n) OVER (ORDER BY folder ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT folder, count(*) AS n FROM k GROUP BY folder)) SELECT path, length('// File: ' || name || ' (' || ext || ')' || chr(10) || '// Path: ' || path || chr(10) || content)::INTEGER AS n FROM k JOIN b USING (folder) WHERE before < 10",
)
def s05(spark: SparkSession, sf: str) -> DataFrame:
    return file_sources.security_files(_paths(spark, sf)).select("path", F.length("content").alias("n"))


@query("s06_k18_json_round_trip", "SELECT r_regionkey, r_name FROM region")
def s06(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "json")
    reports.export_json(tables.table(spark, sf, "region"), path)
    return spark.read.schema("r_regionkey int, r_name string").json(path)


@query("s08_name_slice", "SELECT c_name FROM customer WHERE c_name LIKE 'Customer%' ORDER BY c_name LIMIT 20 OFFSET 5")
def s08(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.name_slice(tables.table(spark, sf, "customer"), "c_name", "Customer", 5, 20).select("c_name")


@query("s10_s11_csv_round_trip", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_size % 2 = 0")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "csv")
    tables.table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("p_brand")).write.option("header", True).option("escape", '"').csv(path)
    return file_sources.csv(spark, path, ("p_brand",), "p_partkey long, p_name string, p_brand string")


@query("s12_structured_ingest", "SELECT r_name AS title, n_name AS file_path FROM region JOIN nation ON n_regionkey = r_regionkey")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "ingest")
    instances = tables.table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct(F.struct(F.col("n_name").alias("file_path")).alias("issue"))).alias("instances"))
    entries = tables.table(spark, sf, "region").join(instances, "r_regionkey").select(F.struct(F.col("r_name").alias("title")).alias("pattern"), "instances")
    entries.agg(F.lit("1").alias("version"), F.collect_list(F.struct("pattern", "instances")).alias("data")).coalesce(1).write.json(path)
    return ingest.structured(spark, path).select("pattern.title", "i.issue.file_path")


@query("s14_vector_ids", "SELECT vec_id AS sqlite_id FROM embeddings WHERE label = 1 ORDER BY vec_id LIMIT 100")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    return store.where(tables.vectors(spark, sf), vector_layer="layer1").select("sqlite_id").orderBy("sqlite_id").limit(100)


@query("s15_vector_lookup", "SELECT vec_id AS sqlite_id, len(embedding) AS n FROM embeddings WHERE vec_id = 7")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    return store.by_ids(tables.vectors(spark, sf), [7], "sqlite_id").select("sqlite_id", F.size("vector").alias("n"))


@query("s16_k20_report_listing", with_issues("SELECT run_id AS run, count(*) AS n FROM issues WHERE severity = 'critical' GROUP BY run_id"))
def s16(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "reports")
    rows = tables.issues(spark, sf).filter("severity = 'critical'").select("run_id", "ord", "description")
    reports.write_run_reports(rows, path)
    listed = file_sources.reports(spark, path).select(F.regexp_extract("kind", "run_id=(.*)", 1).alias("run")).distinct()
    return spark.read.schema("run_id string, ord long, description string").json(path).groupBy(F.col("run_id").alias("run")).agg(F.count("*").alias("n")).join(listed, "run", "left_semi")


@query("s17_report_names", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'run' || user_id WHEN 1 THEN 'r' || user_id END AS run_id FROM events WHERE event_id % 3 < 2")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    user, k = F.col("user_id").cast("string"), F.col("event_id") % 3
    path = F.when(k == 0, F.concat(F.lit("/a/run"), user, F.lit("/consolidated/consolidated_x.json"))).when(k == 1, F.concat(F.lit("/a/consolidated_req_3_r"), user, F.lit(".json"))).otherwise("/a/other.json")
    return file_sources.consolidated(tables.table(spark, sf, "events").select("event_id", path.alias("path"))).select("event_id", "run_id")


@query("k19_csv_export", "SELECT n_regionkey::VARCHAR AS target, n_name AS name FROM nation")
def k19_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "groups")
    reports.export_csv(tables.table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("target"), F.col("n_name").alias("name")), path)
    return spark.read.schema("name string, target string").option("header", True).csv(path).select("target", "name")


@query("k23_expired", "SELECT count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY")
def k23(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "orders").withColumnRenamed("o_orderdate", "modificationTime")
    return file_sources.expired(rows, 30, F.lit("1998-01-01").cast("timestamp")).agg(F.count("*").alias("n"))


@query("k27_conversation_report", "SELECT conv_id AS session_id, count(*) AS total_messages, count_if(role = 'user') AS user_requests, count_if(role = 'assistant') AS ai_responses FROM conversations GROUP BY conv_id")
def k27(spark: SparkSession, sf: str) -> DataFrame:
    return reports.conversation_report(tables.table(spark, sf, "conversations"))


@query("k12_k14_vector_update", "SELECT vec_id AS sqlite_id, 'layer' || CASE WHEN vec_id % 9 = 0 THEN 99 ELSE label END AS vector_layer FROM embeddings")
def k12(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.vectors(spark, sf)
    return store.update(rows, rows.filter("sqlite_id % 9 = 0").select("sqlite_id", F.lit("layer99").alias("vector_layer")), ["vector_layer"], "sqlite_id").select("sqlite_id", "vector_layer")


@query("k16_delete_all_vectors", "SELECT p AS page, least(100, n - (p - 1) * 100)::BIGINT AS n FROM (SELECT count(*) AS n FROM embeddings) , range(1, 1000000) t(p) WHERE (p - 1) * 100 < n")
def k16(spark: SparkSession, sf: str) -> DataFrame:
    return store.delete_pages(tables.vectors(spark, sf))


# predicates and joins


@query("f10_pattern_match", "SELECT item_id, count(*) AS n FROM documents d JOIN (SELECT item_id, lower(substr(trim(text), 1, 32)) AS start FROM benchmark) b ON (b.start <> '' AND contains(lower(d.text), b.start)) OR contains(lower(d.text), 'the and') GROUP BY item_id")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that match, for every benchmark row; a row without any is left out."""
    known = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.when(F.col("text").isNotNull(), "The AND").alias("error_type"), F.col("text").alias("error_description"))
    issues = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("description"), F.lit("source").alias("source"))
    return secondpass.match_counts(known, issues).withColumnRenamed("id", "item_id")


_REPORTS = ('{"run_id": "r", "requirement_id": 1, "issues": [], "analysis_types": []}', '{"run_id": "r", "issues": {}}', "no json", "[1]")


@query("f11_report_validity", "SELECT c_custkey AS id, ['', 'missing requirement_id; missing analysis_types; issues no list', 'no JSON object', 'no JSON object'][c_custkey % 4 + 1] AS errors FROM customer")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    body = F.element_at(F.array(*map(F.lit, _REPORTS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), reports.report_errors(body).alias("errors"))


def example_models(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return tables.table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.when(k % 2 == 0, "chat").otherwise("code").alias("type"), F.concat(F.lit("4."), (k % 30).cast("string"), F.lit(".1")).alias("min_version"),
        F.when(k % 3 != 0, F.concat(F.lit("4."), (k % 30 + 10).cast("string"))).alias("max_version"), F.array_repeat(F.lit("x"), (k % 3).cast("int")).alias("known_issues"),
    )


@query("f13_compatible_models", "SELECT c_name AS name FROM customer WHERE 420 >= 400 + c_custkey % 30 AND (c_custkey % 3 = 0 OR 420 <= 410 + c_custkey % 30)")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    return models.compatible(example_models(spark, sf), "4.20.3").select("name")


@query("f14_u04_problematic_models", "SELECT c_name AS name FROM customer WHERE NOT (420 >= 400 + c_custkey % 30 AND (c_custkey % 3 = 0 OR 420 <= 410 + c_custkey % 30))")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    return models.problematic(example_models(spark, sf), "4.20.3").select("name")


@query("f15_models_by_type", "SELECT c_name AS name FROM customer WHERE c_custkey % 2 = 0")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    return models.by_type(example_models(spark, sf), "chat").select("name")


@query("f16_model_summary", "SELECT c_name AS name, '4.' || (c_custkey % 30) || '.1 - ' || CASE WHEN c_custkey % 3 <> 0 THEN '4.' || (c_custkey % 30 + 10) ELSE 'latest' END AS transformers_range, c_custkey % 3 AS known_issues_count FROM customer")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    return models.summary(example_models(spark, sf)).drop("type")


def write_tasks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    target = F.element_at(F.array(*map(F.lit, ("session", "issue", "pattern"))), (k % 3 + 1).cast("int"))
    return tables.table(spark, sf, "customer").select(k.cast("long").alias("ord"), target.alias("target"), F.when(k % 4 == 0, "query").otherwise("create").alias("action"), F.create_map(F.lit("id"), k.cast("string"), F.lit("status"), F.lit("kept")).alias("data"))


@query("f20_filled_tasks", "SELECT c_custkey::BIGINT AS ord, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE [6, 12, 12][c_custkey % 3 + 1] END AS n, CASE WHEN c_custkey % 4 = 0 THEN c_custkey::VARCHAR END AS id FROM customer")
def f20(spark: SparkSession, sf: str) -> DataFrame:
    done = tasks.fill(write_tasks(spark, sf), "words", "cli")
    return done.select("ord", F.size("data").alias("n"), F.try_element_at("data", F.lit("id")).alias("id"))


@query("x41_confirmed_tasks", "SELECT c_custkey::BIGINT AS ord, 'true' AS confirm, CASE WHEN c_custkey % 4 = 0 THEN 'query' ELSE 'create' END AS action FROM customer")
def x41(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.confirmed(write_tasks(spark, sf)).select("ord", F.try_element_at("data", F.lit("confirm")).alias("confirm"), "action")


@query("j12_bound_ids", "SELECT c_custkey::BIGINT AS ord, CASE WHEN c_custkey % 3 = 1 THEN '11' END AS pattern_id, CASE WHEN c_custkey % 3 = 1 THEN '12' END AS session_id FROM customer")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    rows = write_tasks(spark, sf).withColumn("target", F.when(F.col("target") == "issue", "curated_issue").otherwise(F.col("target")))
    one = lambda n: spark.range(n, n + 1)
    get = lambda k: F.try_element_at("data", F.lit(k)).alias(k)
    return tasks.with_ids(rows, one(11), one(12)).select("ord", get("pattern_id"), get("session_id"))


@query("f21_column_order", """SELECT o_orderkey AS id, '{"id":' || o_orderkey || ',"session_id":' || o_custkey || ',"user_message":"' || o_orderpriority || '","status":"' || o_orderstatus || '","a_extra":' || (o_orderkey % 7) || ',"z_extra":"z"}' AS line FROM orders""")
def f21(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written with their columns in the model's order, unknown ones by name behind them."""
    rows = tables.sessions(spark, sf).select(F.lit("z").alias("z_extra"), "status", (F.col("id") % 7).alias("a_extra"), "user_message", "session_id", "id")
    return store.in_order(rows, "review_session").select("id", F.to_json(F.struct("*")).alias("line"))


@query("j08_before_after", "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 5 ELSE 0 END AS before, CASE WHEN file_id % 3 = 0 THEN 7 ELSE 0 END AS after FROM (SELECT doc_id AS file_id FROM documents)")
def j08(spark: SparkSession, sf: str) -> DataFrame:
    keys = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"))
    return ingest.both_sides(keys, keys.filter("file_id % 2 = 0").withColumn("text", F.lit("12345")), keys.filter("file_id % 3 = 0").withColumn("text", F.lit("1234567")), ["file_id"]).select("file_id", F.length("before").alias("before"), F.length("after").alias("after"))


@query("j09_placeholder_issues", "SELECT r_regionkey, coalesce(n_name, '') AS file_path FROM region LEFT JOIN (SELECT * FROM nation WHERE n_regionkey > 1) ON n_regionkey = r_regionkey")
def j09(spark: SparkSession, sf: str) -> DataFrame:
    listed = tables.table(spark, sf, "nation").filter("n_regionkey > 1").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("n_name").alias("files"))
    return tables.table(spark, sf, "region").join(listed, "r_regionkey", "left").select("r_regionkey", F.explode_outer("files").alias("f")).select("r_regionkey", F.coalesce("f", F.lit("")).alias("file_path"))


@query("j10_issue_evidence", with_issues("SELECT ord, score, line FROM issues WHERE ord % 2 = 0"))
def j10(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.issues(spark, sf)
    return rows.select("ord", "score").join(rows.filter("ord % 2 = 0").select("ord", "line"), "ord")


@query("j13_run_completion", with_issues("SELECT run_id, count(DISTINCT requirement_id % 5) FILTER (line > 30) = count(DISTINCT requirement_id % 5) AS complete FROM issues GROUP BY run_id"))
def j13(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.issues(spark, sf).select("run_id", (F.col("requirement_id") % 5).alias("requirement_id"), "line")
    return runs.completed_runs(rows, rows.filter("line > 30"))


@query("j14_x10_lookup_maps", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'xss' WHEN 1 THEN 'sql_injection' ELSE 'security_vulnerability' END AS type, CASE p_size % 3 WHEN 1 THEN 'critical' ELSE 'medium' END AS severity FROM part")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    cwe = F.element_at(F.array(*map(F.lit, ("CWE-79", "CWE-89", "CWE-0"))), (F.col("p_size") % 3 + 1).cast("int"))
    return tables.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), rules.cwe_type(cwe).alias("type"), rules.cwe_severity(cwe).alias("severity"))


@query("r01_evidence", with_issues("SELECT ord AS issue_ord, 2::BIGINT AS n FROM issues WHERE source IN ('click', 'view')"))
def r01(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([(1, "click", None), (2, "VIEW", None), (3, None, " Click"), (4, None, "view "), (5, "absent", "absent")], "id long, error_type string, error_description string").withColumns({"severity": F.lit("high"), "solution": F.lit("s"), "status": F.lit("active")})
    return secondpass.text_evidence(tables.issues(spark, sf), known).groupBy("issue_ord").agg(F.count("*").alias("n"))


# ranking and grouping


@query("t04_bottleneck_order", SQL["c15_bottlenecks"])
def t04(spark: SparkSession, sf: str) -> DataFrame:
    """Every position of every file, worst first."""
    return lines.bottlenecks(tables.files(spark, sf))


@query("t08_optimisation_buckets", with_issues("SELECT requirement_id, CASE WHEN severity IN ('critical', 'high') THEN 'immediate_optimizations' ELSE 'algorithmic_improvements' END AS bucket, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY score DESC, ord) AS rn FROM issues) WHERE rn <= 5 GROUP BY ALL"))
def t08(spark: SparkSession, sf: str) -> DataFrame:
    first = ranking.first_per(tables.issues(spark, sf), ["requirement_id"], [F.desc("score"), F.col("ord")], 5)
    return first.groupBy("requirement_id", ranking.optimisation_bucket(F.col("severity")).alias("bucket")).agg(F.count("*").alias("n"))


@query("t10_group_cap", with_issues("SELECT file AS grp FROM issues GROUP BY file ORDER BY file LIMIT 20"))
def t10(spark: SparkSession, sf: str) -> DataFrame:
    return tables.issues(spark, sf).select(F.col("file").alias("grp")).distinct().orderBy("grp").limit(20)


@query("t12_suggestions", "SELECT c_custkey::BIGINT AS file_id, CASE WHEN c_custkey % 4 = 0 THEN 5 ELSE 0 END + CASE WHEN c_custkey % 4 < 2 THEN 5 ELSE 0 END + CASE WHEN c_custkey % 4 = 2 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 0 END AS n FROM customer")
def t12(spark: SparkSession, sf: str) -> DataFrame:
    base = tables.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("file_id"))
    many = lambda df: df.select("file_id", F.posexplode(F.array_repeat(F.lit("d"), 7)).alias("pos", "description"))
    risk = base.withColumn("risk_level", F.when(F.col("file_id") % 4 == 2, "high").otherwise("low"))
    found = reports.suggestions(many(base.filter("file_id % 4 = 0")).withColumn("priority", F.lit(None).cast("string")), many(base.filter("file_id % 4 < 2")), risk)
    return found.groupBy("file_id").agg(F.count("*").cast("int").alias("n"))


@query("a13_union_header", "SELECT 'customer' AS target, c_custkey AS id, to_json({'balance': c_acctbal > 0, 'name': c_name}) AS line FROM customer UNION ALL SELECT 'order', o_orderkey, to_json({'owner': o_custkey, 'status': o_orderstatus}) FROM orders")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and orders under the union of their columns; each row as it was."""
    customers = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("balance"))
    orders = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))
    rows = reports.grouped_union({"customer": customers, "order": orders})
    return rows.select("target", "id", F.to_json(F.struct(*(c for c in rows.columns if c not in ("target", "id")))).alias("line"))


@query("u02_merged_sets", with_issues("SELECT run_id, len(list(DISTINCT requirement_id)) AS n FROM issues GROUP BY run_id"))
def u02(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of two announcements of each run, merged."""
    told = lambda k: idsets.bitmaps(tables.issues(spark, sf).filter(F.col("ord") % 2 == k), ["run_id"], "requirement_id", told=F.lit(True))
    return idsets.sizes(idsets.merged(told(0).unionByName(told(1)), ["run_id"], "told"), ["run_id"], "told").withColumnRenamed("told", "n")


@query("c31_static_scan")
def c31(spark: SparkSession, sf: str) -> DataFrame:
    """All style codes of all files and the issues of all tool outputs; SQL of both would be too slow."""
    style = lines.style_check(tables.files(spark, sf)).select("file_id", F.lit("style").alias("source"), "severity")
    tools = toolparse.all_issues(tool_outputs(spark, sf)).select("file_id", F.lit("security").alias("source"), "severity")
    return aggregate.scan_summary(style.unionByName(tools), "file_id")


# answers

_ANSWERS = (
    '```json\n{"type": "xss", "severity": "HIGH", "description": "d", "llm_security_score": 8.1234, "confidence": 2,}\n```',
    "possible inject and csrf, issue here\n建议 use cache\nscore: 7.5 of 10\n# head\nsplit O(N^2) query",
    "plain words",
    'x {"intent": "code", "code_analysis_tasks": [{"target_path": "/a"}], "explanation": "e"} y',
    '[{"target": "issue", "action": "create"}, {"target": "pattern"}]',
)


def example_answers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return tables.table(spark, sf, "customer").select(k.alias("id"), F.element_at(F.array(*map(F.lit, _ANSWERS)), (k % len(_ANSWERS) + 1).cast("int")).alias("answer"))


def _pick_sql(*values: str) -> str:
    return "[" + ", ".join(values) + f"][c_custkey % {len(_ANSWERS)} + 1]"


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _answer(expression):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return example_answers(spark, sf).select("id", *expression(F.col("answer")))

    return run


_CLEAN_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer, '(?i)```json|```', '', 'g'), '(?m)//.*?$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), ',\\s*([\\]}])', '\\1', 'g'), ' ' || chr(10))"
query("x27_sanitized", f"SELECT id, length({_CLEAN_SQL}) AS n FROM (SELECT c_custkey AS id, {_pick_sql(*map(_literal, _ANSWERS))} AS answer FROM customer)")(_answer(lambda a: [F.length(repair.sanitized(a)).alias("n")]))
query("x28_x29_task_plan", "SELECT c_custkey AS id, " + _pick_sql("''", "''", "''", "'code'", "''") + " AS intent, " + _pick_sql("''", "''", "''", "'/a'", "''") + " AS targets FROM customer")(_answer(lambda a: [repair.task_plan(a)["intent"].alias("intent"), F.array_join(repair.task_plan(a)["targets"], ",").alias("targets")]))
query("x31_task_list", "SELECT c_custkey AS id, " + _pick_sql("1", "0", "0", "1", "2") + " AS n FROM customer")(_answer(lambda a: [F.size(repair.task_list(a)).alias("n")]))
query("x32_json_object", "SELECT c_custkey AS id, " + _pick_sql("'HIGH'", "NULL", "NULL", "NULL", "NULL") + " AS severity FROM customer")(_answer(lambda a: [F.try_variant_get(repair.json_object(a), "$.severity", "string").alias("severity")]))
query("x33_rating", "SELECT c_custkey AS id, " + _pick_sql("true", "false", "false", "false", "false") + " AS available, " + _pick_sql("8.123::DOUBLE", "NULL", "NULL", "NULL", "NULL") + " AS score, " + _pick_sql("1.0::DOUBLE", "0", "0", "0", "0") + " AS confidence FROM customer")(_answer(lambda a: [repair.rating(a)[k].alias(k) for k in ("available", "score", "confidence")]))
query("x34_vulnerabilities", "SELECT c_custkey AS id, " + _pick_sql("'xss'", "'generated_threat_indicator'", "NULL", "'generated_threat_indicator'", "'generated_threat_indicator'") + " AS type, " + _pick_sql("'high'", "'medium'", "NULL", "'low'", "'low'") + " AS severity FROM customer")(_answer(lambda a: [answers.vulnerability(a, F.lit(0))[k].alias(k) for k in ("type", "severity")]))
query("x35_complexity", "SELECT c_custkey AS id, " + _pick_sql("'O(n)'", "'O(n^2)'", "'O(n)'", "'O(n)'", "'O(n)'") + " AS estimated FROM customer")(_answer(lambda a: [answers.complexity(a)["estimated_complexity"].alias("estimated")]))
query("x36_signals", "SELECT c_custkey AS id, " + _pick_sql("false", "true", "false", "false", "false") + " AS cache, " + _pick_sql("false", "true", "false", "false", "false") + " AS refactor FROM customer")(_answer(lambda a: [answers.signals(a)["ai_caching_opportunity"].alias("cache"), answers.signals(a)["ai_refactor_needed"].alias("refactor")]))
query("x37_quality_lines", "SELECT c_custkey AS id, " + _pick_sql("0", "1", "0", "0", "1") + " AS issues, " + _pick_sql("0", "1", "0", "0", "0") + " AS recommendations, " + _pick_sql("8.1234::DOUBLE", "7.5", "7.0", "7.0", "7.0") + " AS score FROM customer")(_answer(lambda a: [F.size(answers.quality_lines(a)["issues"]).alias("issues"), F.size(answers.quality_lines(a)["recommendations"]).alias("recommendations"), answers.quality_lines(a)["score"].alias("score")]))
query("x38_suggestion_lines", "SELECT c_custkey AS id, " + _pick_sql("'1,2,3'", "'1,2,3,5'", "'1'", "'1'", "'1'") + " AS ids FROM customer")(_answer(lambda a: [F.array_join(F.transform(answers.suggestion_lines(a), lambda s: s["suggestion_id"].cast("string")), ",").alias("ids")]))
query("x30_mended_paths", "SELECT c_custkey AS id, '{\"path\": \"C:/' || c_custkey || '/b\", \"note\": \"é\"}' AS fixed FROM customer")(lambda spark, sf: tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), repair.mended_paths(F.concat(F.lit('{"path": "C:\\'), F.col("c_custkey"), F.lit('\\b", "note": "é"}'))).alias("fixed")))
query("x42_confirmation", "SELECT c_custkey AS id, [true, false, false, true][c_custkey % 4 + 1] AS confirmed FROM customer")(
    lambda spark, sf: tables.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        repair.confirmation(
            F.element_at(F.array(F.lit('{"confirm": true}'), F.lit('{"confirm": false}'), F.lit("?"), F.lit("?")), (F.col("c_custkey") % 4 + 1).cast("int")),
            F.element_at(F.array(F.lit("不"), F.lit("确认"), F.lit("不要执行"), F.lit("确认删除")), (F.col("c_custkey") % 4 + 1).cast("int")),
        ).alias("confirmed"),
    )
)


@query("a23_threat_text", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN round_even((5.5 + 4.5 * 5) / 6, 2)::DOUBLE ELSE 4.5::DOUBLE END AS overall FROM customer")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("c_custkey") % 2 == 0, "x\nspoofing of the login is likely here\nTampering").otherwise("nothing")
    return tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), answers.threat_model(said)["overall"].alias("overall"))


def example_items(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    item = F.create_map(F.lit("type"), F.when(k % 2 == 0, " MONITORING ").otherwise("odd"), F.lit("suggestion"), F.col("c_name"), F.lit("priority"), F.when(k % 3 == 0, "HIGH").otherwise("?"), F.lit("fix"), F.lit(" f "))
    return tables.table(spark, sf, "customer").select(k.alias("id"), F.array_repeat(item, (k % 8).cast("int")).alias("items"))


_LEVEL = "CASE WHEN c_custkey % 3 = 0 THEN 'high' ELSE 'medium' END"


@query("x52_x53_plan_items", f"SELECT c_custkey AS id, least(c_custkey % 8, 5) AS n, CASE WHEN c_custkey % 8 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'monitoring' ELSE 'odd' END END AS type, CASE WHEN c_custkey % 8 > 0 THEN {_LEVEL} END AS priority, CASE WHEN c_custkey % 8 > 0 THEN c_name END AS recommendation FROM customer")
def x52(spark: SparkSession, sf: str) -> DataFrame:
    rows = example_items(spark, sf).select("id", answers.first_items(F.col("items"), answers.plan_item, 5).alias("p"))
    first = F.get("p", F.lit(0))
    return rows.select("id", F.size("p").alias("n"), first["type"].alias("type"), first["priority"].alias("priority"), first["recommendation"].alias("recommendation"))


@query("x52_optimization_items", f"SELECT c_custkey AS id, CASE WHEN c_custkey % 8 > 1 THEN 2 END AS suggestion_id, CASE WHEN c_custkey % 8 > 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'monitoring' ELSE 'general' END END AS type, CASE WHEN c_custkey % 8 > 1 THEN {_LEVEL} END AS priority FROM customer")
def x52b(spark: SparkSession, sf: str) -> DataFrame:
    rows = example_items(spark, sf).select("id", F.transform("items", answers.optimization_item).alias("p"))
    second = F.get("p", F.lit(1))
    return rows.select("id", second["suggestion_id"].alias("suggestion_id"), second["type"].alias("type"), second["priority"].alias("priority"))


@query("x54_remediation_items", f"SELECT c_custkey AS id, least(c_custkey % 8, 10) AS n, CASE WHEN c_custkey % 8 > 0 THEN 'f' END AS fix, CASE WHEN c_custkey % 8 > 0 THEN {_LEVEL} END AS priority FROM customer")
def x54(spark: SparkSession, sf: str) -> DataFrame:
    rows = example_items(spark, sf).select("id", answers.first_items(F.col("items"), answers.remediation_item, 10).alias("p"))
    return rows.select("id", F.size("p").alias("n"), F.get("p", F.lit(0))["fix"].alias("fix"), F.get("p", F.lit(0))["priority"].alias("priority"))


@query("x55_r07_r08_envelopes", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 3 THEN 'failed' WHEN c_custkey % 2 = 0 THEN 'completed' ELSE 'partial_success' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 0.9::DOUBLE ELSE 0.68 END AS security, CASE WHEN c_custkey % 2 = 0 THEN 0.88::DOUBLE ELSE 0.65 END AS performance FROM customer")
def x55(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    failed, said = F.array_repeat(F.lit("step"), (k % 2).cast("int")), F.when(k % 4 == 3, "failed").otherwise("odd")
    one, two = answers.analysis_envelope(said, failed, 0.9, 0.68), answers.analysis_envelope(said, failed, 0.88, 0.65)
    return tables.table(spark, sf, "customer").select(k.alias("id"), one["analysis_status"].alias("status"), one["confidence"].alias("security"), two["confidence"].alias("performance"))


@query("x56_basic_recommendations", with_issues("SELECT source AS category, CASE WHEN avg(line) < 75 THEN '改进 ' || source || ' 以提升得分' END AS recommendation FROM issues GROUP BY source"))
def x56(spark: SparkSession, sf: str) -> DataFrame:
    score = F.avg("line")
    return tables.issues(spark, sf).groupBy(F.col("source").alias("category")).agg(F.when(score < 75, F.concat(F.lit("改进 "), F.first("source"), F.lit(" 以提升得分"))).alias("recommendation"))


@query("x58_x59_advice", FILES + ", f AS (SELECT file_id, lower(content) AS c, content FROM files) SELECT file_id, (" + " OR ".join(f"contains(c, '{w}')" for w in ("sql", "select", "insert", "update", "delete", "database", "query")) + ")::INT + (" + " OR ".join(f"contains(c, '{w}')" for w in ("requests", "http", "socket", "urllib", "fetch")) + ")::INT AS tests, CASE WHEN file_id % 10 >= 7.5 THEN 'algorithmic_improvement' ELSE 'monitoring' END AS first FROM f")
def x58(spark: SparkSession, sf: str) -> DataFrame:
    flags = lines.operation_flags(tables.files(spark, sf))
    advice = answers.test_advice({"database_operations": F.col("database_operations"), "network_operations": F.col("network_operations"), "async_patterns": F.lit(False)})
    return flags.select("file_id", F.size(advice).alias("tests"), F.get(answers.complexity_advice((F.col("file_id") % 10).cast("double")), F.lit(0))["type"].alias("first"))


@query("x61_prompts", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'V ' || c_name || ' {x}' WHEN 1 THEN 'M ' || c_name ELSE 'D' END AS prompt FROM customer")
def x61(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    made = answers.prompt({"v": "V {name} {{x}}", "m": "M {name}", "default": "D"}, F.when(k % 3 == 0, "v").otherwise("?"), F.when(k % 3 == 1, "m").otherwise("?"), {"name": F.col("c_name")})
    return tables.table(spark, sf, "customer").select(k.alias("id"), made.alias("prompt"))


@query("x20_relative_paths", FILES + "SELECT file_id, CASE WHEN path LIKE 'dir1/%' THEN substr(path, 6) ELSE regexp_extract(path, '([^/]*)$', 1) END AS rel FROM files")
def x20(spark: SparkSession, sf: str) -> DataFrame:
    return tables.files(spark, sf).select("file_id", text.relative_path(F.col("path"), F.lit("dir1")).alias("rel"))


@query("x26_vector_or_text", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 64 ELSE 3 END AS n FROM embeddings")
def x26(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.col("sqlite_id") % 2 == 0, F.col("vector"))
    return tables.vectors(spark, sf).select(F.col("sqlite_id").alias("vec_id"), F.size(vectors.vector_or_embedding(given, F.lit("text"))).alias("n"))


@query("x44_paths_in_text", "SELECT c_custkey AS id, '/srv/' || c_name || '.py,C:\\x\\y' AS paths FROM customer")
def x44(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("look at /srv/"), F.col("c_name"), F.lit(".py and C:\\x\\y now"))
    return tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array_join(reports.paths_in(said), ",").alias("paths"))


@query(
    "x46_tables",
    "WITH c AS (SELECT c_custkey, c_custkey::VARCHAR AS a, c_mktsegment AS b FROM customer), w AS (SELECT greatest(8, max(length(a))) AS wa, greatest(7, max(length(b))) AS wb FROM c) "
    "SELECT 2 AS part, '| ' || rpad(a, wa::INT, ' ') || ' | ' || rpad(b, wb::INT, ' ') || ' |' AS line FROM c, w UNION ALL SELECT 0, '| ' || rpad('customer', wa::INT, ' ') || ' | ' || rpad('segment', wb::INT, ' ') || ' |' FROM w UNION ALL SELECT 1, '|' || repeat('-', (wa + 2)::INT) || '|' || repeat('-', (wb + 2)::INT) || '|' FROM w",
)
def x46(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"))
    return reports.table_lines(rows, "other").select("part", "line")


@query("x48_labels", with_issues("SELECT DISTINCT severity, CASE severity WHEN 'critical' THEN '🚨 严重' WHEN 'high' THEN '🔴 高' WHEN 'medium' THEN '🟡 中' ELSE '🟢 低' END AS label, source, source AS source_label FROM issues"))
def x48(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.issues(spark, sf).select("severity", "source").distinct()
    return rows.select("severity", lookup(F.col("severity"), rules.SEVERITY_LABEL, F.col("severity")).alias("label"), "source", lookup(F.col("source"), rules.SOURCE_LABEL, F.col("source")).alias("source_label"))


@query("x51_timestamps", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def x51(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"))


_X60 = (
    ('{"a": {"b": 1, "c": {"x": %s}}, "d": 0}', '{"a": {"b": 2, "c": {"y": "é"}}, "e": [1, 2]}'),
    ('{"a": {"b": %s}, "d": 0}', '{"a": 5, "d": null}'),
    ('{"a": 1, "n": %s}', "no settings"),
)


@query("x60_merged_config", """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '{"a":{"b":2,"c":{"x":' || c_nationkey || ',"y":"é"}},"d":0,"e":[1,2]}' WHEN 1 THEN '{"a":5,"d":null}' ELSE '{"a":1,"n":' || c_nationkey || '}' END AS config FROM customer""")
def x60(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of each customer merged over the defaults."""
    pick = lambda side: F.replace(F.element_at(F.array(*[F.lit(x[side]) for x in _X60]), (F.col("c_custkey") % 3 + 1).cast("int")), F.lit("%s"), F.col("c_nationkey").cast("string"))
    rows = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), pick(0).alias("defaults"), pick(1).alias("own"))
    return rows.select("id", answers.merged_settings(F.col("defaults"), F.col("own")).alias("config"))


# second pass on code, streams


@query("r06_detections", FILES + "SELECT file_id, count(*) AS n FROM files WHERE length(content) % 11 > 7 GROUP BY file_id")
def r06(spark: SparkSession, sf: str) -> DataFrame:
    """Classifier rows above the confidence bound on each file's first three chunks, deduplicated; what the classifier says is read off the file's length."""
    said = (F.length("content") % 11).cast("double") / 10
    chunks = tables.files(spark, sf).select("file_id", said.alias("confidence"), F.posexplode(F.slice(chunking.line_chunks(F.col("content")), 1, 3)).alias("chunk", "code"))
    scored = chunks.filter("confidence > 0.7")
    found = scored.select("file_id", F.col("chunk").alias("ord"), F.lit("ai_detected_issue").alias("type"), F.lit("").alias("location"), F.lit("same").alias("description"), rules.detection_severity(F.lit("x"), F.col("code"), F.col("confidence")).alias("severity"))
    return dedupe.dedupe_vulnerabilities(found, "file_id").groupBy("file_id").agg(F.count("*").alias("n"))


@query("r09_quality_report", with_issues("SELECT requirement_id, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'high') THEN 'high' WHEN count_if(severity = 'medium') > 5 THEN 'medium' ELSE 'low' END AS risk_level, count(*) AS total_static_issues FROM issues GROUP BY requirement_id"))
def r09(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.issues(spark, sf)
    summary = aggregate.static_insights(aggregate.scan_summary(rows, "requirement_id"))
    return summary.join(aggregate.risk_insight(rows, "requirement_id").select("requirement_id", "risk_level"), "requirement_id").select("requirement_id", "risk_level", F.col("total_issues").alias("total_static_issues"))


@query("w05_deduped_requests", with_issues("SELECT run_id, count(DISTINCT requirement_id) AS n FROM issues GROUP BY run_id"))
def w05(spark: SparkSession, sf: str) -> DataFrame:
    return runs.dedupe_requests(tables.issues(spark, sf)).groupBy("run_id").agg(F.count("*").alias("n"))


@query("w02_dead_letters", "SELECT 'bad' AS kind, count_if(c_custkey % 5 = 0) AS n FROM customer UNION ALL SELECT 'good', count_if(c_custkey % 5 <> 0) FROM customer")
def w02(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "broken {").otherwise('{"a": 1}').alias("content"))
    good, bad = runs.dead_letters(rows, "a int")
    return bad.agg(F.lit("bad").alias("kind"), F.count("*").alias("n")).unionByName(good.agg(F.lit("good").alias("kind"), F.count("*").alias("n")))


@query("w02_delivered", "SELECT event_type AS receiver, event_id AS id, event_id % 5 = 0 AS dead, CASE WHEN event_id % 5 <> 0 THEN row_number() OVER (PARTITION BY event_type, event_id % 5 = 0 ORDER BY event_id) END AS position FROM events")
def w02_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as messages to their type, delivered in three micro-batches; positions in the receivers' queues."""
    source, out = scratch(spark, "mail"), scratch(spark, "delivered")
    content = F.when(F.col("event_id") % 5 == 0, "broken {").otherwise(F.concat(F.lit('{"a": '), F.col("event_id"), F.lit("}")))
    rows = tables.table(spark, sf, "events").select(F.col("event_type").alias("receiver"), F.col("event_id").alias("ord"), F.col("event_id").alias("id"), content.alias("content"))
    most = rows.agg(F.max("ord")).first()[0] or 0
    state = scratch(spark, "delivered-state")
    for k in range(3):  # what all tasks have written since is one micro-batch; the stream goes on from its checkpoint
        rows.filter(F.least(F.lit(2), F.floor(F.col("ord") * 3 / (most + 1))) == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        if not runs.deliver(stream, "a int", out, state):
            raise TimeoutError("the stream did not end in time")
    queue = spark.read.option("basePath", f"{out}/queue").parquet(f"{out}/queue")
    good = runs.positions(queue, scratch(spark, "queued")).select("receiver", "id", F.lit(False).alias("dead"), "position")
    return good.unionByName(spark.read.parquet(f"{out}/dead").select("receiver", "id", F.lit(True).alias("dead"), F.lit(None).cast("long").alias("position")))


@query("w10_available_stream", f"WITH {ISSUES_SQL} SELECT requirement_id, count(*) AS n FROM (SELECT DISTINCT requirement_id, run_id FROM issues) GROUP BY requirement_id")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    """A file stream processed to its end under a timeout, deduplicated by state."""
    source, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    tables.issues(spark, sf).select("requirement_id", "run_id").write.parquet(source)
    stream = runs.dedupe_requests(spark.readStream.schema("requirement_id long, run_id string").parquet(source))
    if not runs.run_available(stream, out, scratch(spark, "stream-state")):
        raise TimeoutError("the stream did not end in time")
    return spark.read.parquet(out).groupBy("requirement_id").agg(F.count("*").alias("n"))


@query("k25_k26_json_outputs", "SELECT ['review_session', 'issue_pattern', 'curated_issue', 'other'][p_partkey % 4 + 1] AS target, count(*) AS n FROM part GROUP BY target")
def k25(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised tasks written as a builder's JSON output and read again."""
    from .knowledge import raw_tasks

    path = scratch(spark, "tasks")
    reports.export_json(tasks.normalize(raw_tasks(spark, sf), "s"), path)
    return spark.read.schema("ord long, target string, action string, data map<string,string>").json(path).groupBy("target").agg(F.count("*").alias("n"))


@query("k21_k22_markdown", with_issues("SELECT requirement_id, '# summary' || chr(10) || '- **total**: ' || count(*) || chr(10) || '- **critical**: ' || CASE WHEN bool_or(severity = 'critical') THEN 'True' ELSE 'False' END || chr(10) || '## sources' || chr(10) || string_agg(DISTINCT '- ' || source, chr(10) ORDER BY '- ' || source) || chr(10) || '# last' || chr(10) || '- **line**: ' || arg_max(line, ord) || chr(10) || '- **note**: None' AS text FROM issues GROUP BY requirement_id"))
def k21(spark: SparkSession, sf: str) -> DataFrame:
    """A nested report of each requirement as Markdown."""
    sources = F.array_sort(F.collect_set("source")).alias("sources")
    found = tables.issues(spark, sf).groupBy("requirement_id").agg(F.count("*").alias("total"), F.bool_or(F.col("severity") == "critical").alias("critical"), sources, F.max_by("line", "ord").alias("line"))
    report = F.struct(F.struct("total", "critical", "sources").alias("summary"), F.struct("line", F.lit(None).cast("string").alias("note")).alias("last"))
    rows = found.select("requirement_id", report.alias("report"))
    return rows.select("requirement_id", reports.markdown_of(F.col("report"), rows.schema["report"].dataType).alias("text"))


@query("x08_changed_ranges", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS first, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS last FROM documents")
def x08(spark: SparkSession, sf: str) -> DataFrame:
    after = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("a new first line\n"), F.col("text")))
    rows = tables.table(spark, sf, "documents").select("doc_id", ingest.changed_range(F.col("text"), after).alias("r"))
    return rows.select("doc_id", F.col("r.first").alias("first"), F.col("r.last").alias("last"))


@query("c28_complexity_blocks", "SELECT event_id AS file_id, 'f' || json_extract_string(props, '$.k') AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS complexity FROM events")
def c28(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    output = F.format_string('{"a.py":[{"name":"f%1$s","type":"function","lineno":1,"complexity":%1$s}]}', k)
    return toolparse.radon(tables.table(spark, sf, "events").select(F.col("event_id").alias("file_id"), output.alias("output"))).select("file_id", "name", "complexity")
