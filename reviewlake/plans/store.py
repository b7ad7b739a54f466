"""Queries of the fact store: filters, lookups, changes, fingerprints, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe, store
from ..operators.aggregate import headers
from ..sources import tables
from ..sources.tables import CURATED_SQL, PATTERNS_SQL, SESSIONS_SQL
from .registry import query

S, C, P = f"WITH {SESSIONS_SQL} ", f"WITH {CURATED_SQL} ", f"WITH {PATTERNS_SQL} "


@query("s01_scans", f"WITH {SESSIONS_SQL}, {CURATED_SQL}, {PATTERNS_SQL} SELECT 'sessions' AS name, count(*) AS n FROM sessions UNION ALL SELECT 'curated', count(*) FROM curated UNION ALL SELECT 'patterns', count(*) FROM patterns")


def s01(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return one("sessions", tables.sessions(spark, sf)).unionByName(one("curated", tables.curated(spark, sf))).unionByName(one("patterns", tables.patterns(spark, sf)))


@query("f01_issue_filter", C + "SELECT id, session_id, file_path, status, created_at FROM curated WHERE file_path = 'f7' AND status = 'O'")


def f01(spark: SparkSession, sf: str) -> DataFrame:
    return store.newest(tables.curated(spark, sf), file_path="f7", status="O", session_id=None).select("id", "session_id", "file_path", "status", "created_at")


@query("f02_session_page", S + "SELECT id, session_id, created_at FROM sessions WHERE status = 'F' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")


def f02(spark: SparkSession, sf: str) -> DataFrame:
    return store.newest(tables.sessions(spark, sf), limit=20, offset=40, status="F").select("id", "session_id", "created_at")


@query("f03_active_patterns", P + "SELECT id, title, error_type, severity, framework, status FROM patterns WHERE status = 'active'")


def f03(spark: SparkSession, sf: str) -> DataFrame:
    return store.where(tables.patterns(spark, sf), status="active").select("id", "title", "error_type", "severity", "framework", "status")


@query("f04_by_ids", C + "SELECT id, pattern_id FROM curated WHERE session_id IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")


def f04(spark: SparkSession, sf: str) -> DataFrame:
    ids = tables.sessions(spark, sf).filter("session_id = 7").select(F.col("id").alias("session_id"))
    return store.by_ids(tables.curated(spark, sf), ids, "session_id").select("id", "pattern_id")


@query("f05_latest_session", S + "SELECT id, session_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS rn FROM sessions) WHERE rn = 1")


def f05(spark: SparkSession, sf: str) -> DataFrame:
    return store.latest_by(tables.sessions(spark, sf), "session_id").select("id", "session_id", "created_at")


@query("f06_latest_issue", C + "SELECT id, session_id, pattern_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, pattern_id ORDER BY created_at DESC, id DESC) AS rn FROM curated) WHERE rn = 1")


def f06(spark: SparkSession, sf: str) -> DataFrame:
    return store.latest_by(tables.curated(spark, sf), "session_id", "pattern_id").select("id", "session_id", "pattern_id")


@query("f19_defaults", P + "SELECT title, error_type, 'medium' AS severity, '' AS class_pattern, 'active' AS status FROM (SELECT title, error_type FROM patterns)")


def f19(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.patterns(spark, sf).select("title", "error_type", F.lit(None).cast("string").alias("severity"))
    return store.fill_defaults(rows, {"title": "", "error_type": "general", "severity": "medium", "class_pattern": "", "status": "active"})


@query("k01_insert_sessions", S + ", top AS (SELECT max(id) AS m FROM sessions) SELECT id, session_id, status FROM sessions UNION ALL SELECT m + 1 + c_custkey, c_custkey, 'open' FROM customer, top WHERE c_custkey <= 20")


def k01(spark: SparkSession, sf: str) -> DataFrame:
    new = tables.table(spark, sf, "customer").filter("c_custkey <= 20").select(F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("session_id"))
    return store.insert(tables.sessions(spark, sf), new, "review_session", now=F.lit("2024-01-01").cast("timestamp")).select("id", "session_id", "status")


@query("k02_insert_issues", C + "SELECT count(*) AS n, max(id) AS top FROM (SELECT id FROM curated UNION ALL SELECT (SELECT max(id) FROM curated) + 1 + s_suppkey FROM supplier WHERE s_suppkey <= 10)")


def k02(spark: SparkSession, sf: str) -> DataFrame:
    new = tables.table(spark, sf, "supplier").filter("s_suppkey <= 10").select(F.col("s_suppkey").alias("ord"), F.lit(1).alias("session_id"))
    return store.insert(tables.curated(spark, sf), new, "curated_issue", now=F.lit("2024-01-01").cast("timestamp")).agg(F.count("*").alias("n"), F.max("id").alias("top"))


@query("k03_insert_patterns", P + "SELECT status, severity, count(*) AS n FROM (SELECT status, severity FROM patterns UNION ALL SELECT 'active', 'medium' FROM nation) GROUP BY status, severity")


def k03(spark: SparkSession, sf: str) -> DataFrame:
    new = tables.table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("title"))
    return store.insert(tables.patterns(spark, sf), new, "issue_pattern").groupBy("status", "severity").agg(F.count("*").alias("n"))


@query("k04_k05_set_status", S + "SELECT id, CASE WHEN session_id <= 50 THEN 'closed' ELSE status END AS status FROM sessions")


def k04(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.sessions(spark, sf)
    return store.set_status(rows, rows.filter("session_id <= 50"), "closed").select("id", "status")


@query("k06_update_patterns", P + "SELECT id, CASE WHEN id % 10 = 0 THEN 'high' ELSE severity END AS severity, title FROM patterns")


def k06(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.patterns(spark, sf)
    changes = rows.filter("id % 10 = 0").select("id", F.lit("high").alias("severity"), F.lit(None).cast("string").alias("title"))
    return store.update(rows, changes, ["severity", "title"]).select("id", "severity", "title")


@query("k07_delete_session", f"WITH {SESSIONS_SQL}, {CURATED_SQL} SELECT 'sessions' AS name, count(*) AS n FROM sessions WHERE session_id > 100 UNION ALL SELECT 'issues', count(*) FROM curated WHERE session_id NOT IN (SELECT id FROM sessions WHERE session_id <= 100)")


def k07(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.sessions(spark, sf)
    parents, children = store.delete_cascade(rows, tables.curated(spark, sf), rows.filter("session_id <= 100").select("id"), "session_id")
    return parents.agg(F.lit("sessions").alias("name"), F.count("*").alias("n")).unionByName(children.agg(F.lit("issues").alias("name"), F.count("*").alias("n")))


@query("k08_delete_issues", C + "SELECT count(*) AS n FROM curated WHERE start_line <> 1")


def k08(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.curated(spark, sf)
    return store.delete(rows, rows.filter("start_line = 1").select("id")).agg(F.count("*").alias("n"))


@query("k09_delete_pattern", f"WITH {PATTERNS_SQL}, {CURATED_SQL} SELECT (SELECT count(*) FROM patterns WHERE status = 'active') AS patterns, count(*) AS issues FROM curated WHERE pattern_id NOT IN (SELECT id FROM patterns WHERE status <> 'active')")


def k09(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.patterns(spark, sf)
    parents, children = store.delete_cascade(rows, tables.curated(spark, sf), rows.filter("status != 'active'").select("id"), "pattern_id")
    return parents.agg(F.count("*").alias("patterns")).crossJoin(children.agg(F.count("*").alias("issues")))


@query("k10_truncate", C + "SELECT 0 AS sessions, count(*) AS issues FROM curated")


def k10(spark: SparkSession, sf: str) -> DataFrame:
    emptied, issues = store.truncate(tables.sessions(spark, sf), tables.curated(spark, sf), "session_id")
    return emptied.agg(F.count("*").alias("sessions")).crossJoin(issues.agg(F.count("*").alias("issues")))


@query("k11_soft_delete", P + "SELECT count(*) AS n FROM patterns WHERE status = 'active' AND severity <> 'low'")


def k11(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.patterns(spark, sf)
    return store.where(store.set_status(rows, rows.filter("severity = 'low'"), "deleted"), status="active").agg(F.count("*").alias("n"))


@query("k02_missing_parents", f"WITH {SESSIONS_SQL}, {PATTERNS_SQL}, {CURATED_SQL} SELECT missing, count(*) AS n FROM (SELECT 'session' AS missing FROM curated WHERE session_id NOT IN (SELECT id FROM sessions WHERE id % 100 <> 0) UNION ALL SELECT 'pattern' FROM curated WHERE pattern_id NOT IN (SELECT id FROM patterns WHERE status = 'active')) GROUP BY missing")


def k02_fk(spark: SparkSession, sf: str) -> DataFrame:
    return store.missing_parents(tables.curated(spark, sf), tables.sessions(spark, sf).filter("id % 100 != 0"), tables.patterns(spark, sf).filter("status = 'active'")).groupBy("missing").agg(F.count("*").alias("n"))


_FP_SQL = "lower(trim(title)) || '|' || lower(trim(error_type)) || '|' || language || '|' || lower(trim(framework)) || '|' || substr(lower(trim(error_description)), 1, 280)"


@query("d07_pattern_fingerprints", P + f"SELECT id, {_FP_SQL} AS fp FROM patterns")


def d07(spark: SparkSession, sf: str) -> DataFrame:
    return tables.patterns(spark, sf).select("id", dedupe.pattern_fingerprint().alias("fp"))


_ISSUE_FP_SQL = "session_id || '|' || pattern_id || '||' || file_path || '|' || start_line || '||' || lower(status) || '|' || lower(severity)"


def _issues_for_fp(spark: SparkSession, sf: str) -> DataFrame:
    return tables.curated(spark, sf).withColumns({"project_path": F.lit(None).cast("string"), "end_line": F.lit(0), "problem_phenomenon": F.col("status"), "root_cause": F.col("severity")})


@query("d08_issue_fingerprints", C + f"SELECT id, {_ISSUE_FP_SQL} AS fp FROM curated")


def d08(spark: SparkSession, sf: str) -> DataFrame:
    return _issues_for_fp(spark, sf).select("id", dedupe.issue_fingerprint().alias("fp"))


@query("j04_pattern_match", P + f", f AS (SELECT id, {_FP_SQL} AS fp FROM patterns) SELECT id AS incoming, (SELECT min(g.id) FROM f g WHERE g.fp = f.fp AND g.id % 2 = 0) AS existing_id FROM f")


def j04(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.patterns(spark, sf).withColumn("fp", dedupe.pattern_fingerprint())
    return dedupe.matched_ids(rows.select(F.col("id").alias("incoming"), "fp"), rows.filter("id % 2 = 0"), "fp").select("incoming", "existing_id")


@query("j05_new_issues", C + f", f AS (SELECT id, {_ISSUE_FP_SQL} AS fp FROM curated) SELECT min(id) AS id FROM f WHERE fp NOT IN (SELECT fp FROM f WHERE id % 3 = 0) GROUP BY fp")


def j05(spark: SparkSession, sf: str) -> DataFrame:
    rows = _issues_for_fp(spark, sf).withColumn("fp", dedupe.issue_fingerprint()).withColumn("ord", F.col("id"))
    return dedupe.new_rows(rows, rows.filter("id % 3 = 0"), "fp").select("id")


@query("j06_session_issues", f"WITH {SESSIONS_SQL}, {CURATED_SQL} SELECT s.status AS session_status, count(*) AS n FROM sessions s JOIN curated c ON c.session_id = s.id GROUP BY s.status")


def j06(spark: SparkSession, sf: str) -> DataFrame:
    return store.session_issues(tables.sessions(spark, sf), tables.curated(spark, sf)).groupBy("session_status").agg(F.count("*").alias("n"))


@query("j07_pattern_issues", f"WITH {PATTERNS_SQL}, {CURATED_SQL} SELECT p.id, count(c.id) AS n FROM patterns p LEFT JOIN curated c ON c.pattern_id = p.id GROUP BY p.id")


def j07(spark: SparkSession, sf: str) -> DataFrame:
    counts = tables.curated(spark, sf).groupBy(F.col("pattern_id").alias("id")).agg(F.count("*").alias("n"))
    return tables.patterns(spark, sf).select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("d09_upsert_patterns", P + ", top AS (SELECT max(id) AS m FROM patterns) SELECT id, title, CASE WHEN id % 5 = 0 THEN 'critical' ELSE severity END AS severity FROM patterns UNION ALL SELECT m + n_nationkey + 1, 'new ' || n_name, 'low' FROM nation, top")


def d09(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.patterns(spark, sf).withColumn("key", F.col("id").cast("string"))
    change = rows.filter("id % 5 = 0").select("key", F.lit(None).cast("string").alias("title"), F.lit("critical").alias("severity"), F.col("id").alias("ord"))
    fresh = tables.table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_name").alias("key"), F.concat(F.lit("new "), "n_name").alias("title"), F.lit("low").alias("severity"), F.col("n_nationkey").cast("long").alias("ord"))
    return dedupe.upsert(rows, change.unionByName(fresh), "key", ["title", "severity"]).select("id", "title", "severity")


@query("d11_upsert_sessions", S + ", last AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS rn FROM sessions) SELECT session_id, CASE WHEN session_id % 4 = 0 THEN 'again' ELSE user_message END AS user_message FROM last WHERE rn = 1")


def d11(spark: SparkSession, sf: str) -> DataFrame:
    rows = store.latest_by(tables.sessions(spark, sf), "session_id")
    change = rows.filter("session_id % 4 = 0").select("session_id", F.lit("again").alias("user_message"), F.col("id").alias("ord"))
    return dedupe.upsert(rows, change, "session_id", ["user_message"]).select("session_id", "user_message")


@query("d12_upsert_issue_status", C + "SELECT id, CASE WHEN session_id % 2 = 0 THEN 'resolved' ELSE status END AS status FROM (SELECT *, row_number() OVER (PARTITION BY session_id, pattern_id ORDER BY created_at DESC, id DESC) AS rn FROM curated) WHERE rn = 1")


def d12(spark: SparkSession, sf: str) -> DataFrame:
    rows = store.latest_by(tables.curated(spark, sf), "session_id", "pattern_id")
    return store.update(rows, rows.filter("session_id % 2 = 0").select("id", F.lit("resolved").alias("status")), ["status"]).select("id", "status")


_TASK_TARGETS = ("issue_pattern", "review_session", "curated_issue")


def example_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks from nations: target, action and a small map."""
    target = F.element_at(F.array(*map(F.lit, _TASK_TARGETS)), (F.col("n_regionkey") % 3 + 1).cast("int"))
    return tables.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), target.alias("target"), F.lit("upsert").alias("action"), F.create_map(F.lit("b"), (F.col("n_regionkey") % 2).cast("string"), F.lit("a"), F.lit("x")).alias("data"))


@query("d05_dedupe_tasks", "SELECT min(n_nationkey)::BIGINT AS ord, ['issue_pattern', 'review_session', 'curated_issue'][n_regionkey % 3 + 1] AS target, '{\"a\":\"x\",\"b\":\"' || (n_regionkey % 2) || '\"}' AS data FROM nation GROUP BY n_regionkey % 3, n_regionkey % 2")


def d05(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.dedupe_tasks(example_tasks(spark, sf)).select("ord", "target", dedupe.canonical_map(F.col("data")).alias("data"))


@query("a33_headers", "SELECT ['issue_pattern', 'review_session', 'curated_issue'][n_regionkey % 3 + 1] AS target, 'a,b' AS headers FROM nation GROUP BY target")


def a33(spark: SparkSession, sf: str) -> DataFrame:
    return headers(example_tasks(spark, sf), "data", "target").withColumn("headers", F.array_join("headers", ","))


@query("x50_canonical_json", "SELECT p_partkey AS id, '{\"brand\":\"' || p_brand || '\",\"size\":\"' || p_size || '\"}' AS data FROM part")


def x50(spark: SparkSession, sf: str) -> DataFrame:
    data = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return tables.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), dedupe.canonical_map(data).alias("data"))
