"""Queries over issues: counts, scores, ranking, dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import aggregate, dedupe, ranking
from ..schema import SEVERITIES, lookup, severity_rank
from ..sources import tables
from ..sources.tables import ISSUES_SQL
from .registry import query

RANK_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"


def with_issues(sql: str) -> str:
    return f"WITH {ISSUES_SQL} {sql}"


@query("a01_severity_counts", with_issues(f"SELECT severity, {RANK_SQL} AS severity_rank, count(*) AS n FROM issues GROUP BY severity"))
def a01(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.severity_counts(tables.issues(spark, sf)).select("severity", severity_rank(F.col("severity")).alias("severity_rank"), "n")


_STATIC = {"click": "quality", "error": "security", "purchase": "type", "signup": "style"}
_STATIC_SQL = "CASE source WHEN 'click' THEN 'quality' WHEN 'error' THEN 'security' WHEN 'purchase' THEN 'type' WHEN 'signup' THEN 'style' ELSE 'security_ai' END"


def sourced(spark: SparkSession, sf: str) -> DataFrame:
    """Issues whose event types stand for analysis sources."""
    return tables.issues(spark, sf).withColumn("source", lookup(F.col("source"), _STATIC, "security_ai"))


SOURCED_SQL = f"{ISSUES_SQL}, sourced AS (SELECT * REPLACE ({_STATIC_SQL} AS source) FROM issues)"


@query("a02_run_summary", f"WITH {SOURCED_SQL} SELECT run_id, count(*) AS issue_count, " + ", ".join(f"count_if(severity = '{s}') AS {s}" for s in SEVERITIES) + " FROM sourced WHERE source IN ('quality', 'security', 'type', 'style') GROUP BY run_id")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.run_summary(sourced(spark, sf))


@query("a03_second_pass_stats", with_issues("SELECT run_id, lower(severity) AS severity, count(*) AS n FROM issues GROUP BY ALL"))
def a03(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.severity_counts(tables.issues(spark, sf).withColumn("severity", F.initcap("severity")), "run_id", lower=True)


_PENALTY = "3.0 * critical + 2.0 * high + 1.0 * medium + 0.5 * low"


@query(
    "a04_scan_summary",
    f"""WITH {SOURCED_SQL}, c AS (SELECT requirement_id, count(*) AS total_issues, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium,
    count_if(severity = 'low') AS low, bool_or(source = 'security') AS has_security_issues, bool_or(source = 'type') AS has_type_issues FROM sourced GROUP BY requirement_id),
    s AS (SELECT *, greatest(0.0, 10.0 - ({_PENALTY})) AS raw FROM c)
    SELECT requirement_id, total_issues, critical, high, medium, low, has_security_issues, has_type_issues, CAST(round_even(raw, 1) AS DOUBLE) AS quality_score,
    CASE WHEN raw >= 9 THEN 'A' WHEN raw >= 8 THEN 'B' WHEN raw >= 7 THEN 'C' WHEN raw >= 6 THEN 'D' ELSE 'F' END AS quality_grade,
    coalesce(array_to_string(list_filter([CASE WHEN critical > 0 THEN '{rules.SCAN_ADVICE[0]}' END, CASE WHEN high > 0 THEN '{rules.SCAN_ADVICE[1]}' END, CASE WHEN total_issues > 50 THEN '{rules.SCAN_ADVICE[2]}' END, CASE WHEN low > 20 THEN '{rules.SCAN_ADVICE[3]}' END], lambda x: x IS NOT NULL), '|'), '') AS recommendations FROM s""",
)
def a04(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.scan_summary(sourced(spark, sf), "requirement_id").withColumn("recommendations", F.array_join("recommendations", "|"))


@query(
    "a05_category_scores",
    f"""WITH {ISSUES_SQL}, c AS (SELECT source AS category, 10 * avg(score) AS score, count(*) AS issue_count FROM issues GROUP BY source)
    SELECT category, round_even(score, 6) AS score, CAST(issue_count AS BIGINT) AS issue_count, round_even((SELECT avg(round_even(score, 6)) FROM c), 2) AS overall_score,
    CASE WHEN score < 75 THEN '改进 ' || category || ' 以提升得分' END AS recommendation FROM c""",
)
def a05(spark: SparkSession, sf: str) -> DataFrame:
    per = tables.issues(spark, sf).groupBy(F.col("source").alias("category")).agg(rules.rounded(F.avg("score") * 10, 6).alias("score"), F.count("*").alias("n"))
    none = F.array().cast("array<struct<type:string,severity:string,count:bigint>>")
    one = F.array(F.struct(F.lit("t").alias("type"), F.lit("low").alias("severity"), F.col("n").alias("count")))
    return aggregate.aggregate_categories(per.select("category", "score", one.alias("issues"), none.alias("vulnerabilities"), none.alias("bottlenecks")))


@query(
    "a06_executive_summary",
    with_issues("""SELECT run_id, CAST(count(*) AS BIGINT) AS total_issues, 'Overall score ' || CAST(count_if(severity = 'low') AS VARCHAR) || ' with ' || count(*) || ' issues (critical:' || count_if(severity = 'critical') || ' high:' || count_if(severity = 'high') || ')' AS headline,
    array_to_string(list_filter([CASE WHEN count_if(severity = 'critical') > 0 THEN '存在关键高危问题' END, CASE WHEN count_if(severity = 'low') < 70 THEN '整体质量需提升' END], lambda x: x IS NOT NULL), '|') AS main_concerns,
    CASE WHEN count_if(severity = 'low') >= 80 THEN '总体评分良好' ELSE '' END AS success_areas FROM issues GROUP BY run_id"""),
)
def a06(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    totals = tables.issues(spark, sf).groupBy("run_id").agg(n("low").alias("overall_score"), F.count("*").alias("total_issues"), n("critical").alias("critical_issues"), n("high").alias("high_issues"))
    return aggregate.executive_summary(totals).select("run_id", "total_issues", "headline", F.array_join("main_concerns", "|").alias("main_concerns"), F.array_join("success_areas", "|").alias("success_areas"))


@query(
    "a07_trends",
    with_issues("""SELECT requirement_id, CASE WHEN s1 > s0 THEN 'improving' WHEN s1 < s0 THEN 'declining' ELSE 'stable' END AS score_trend, CASE WHEN i1 < i0 THEN 'decreasing' WHEN i1 > i0 THEN 'increasing' ELSE 'stable' END AS issues_trend,
    CASE WHEN s0 <> 0 THEN round_even((s1 - s0) / s0 * 100, 2) ELSE 0 END AS improvement_rate
    FROM (SELECT requirement_id, arg_min(line::DOUBLE, ord) AS s0, arg_max(line::DOUBLE, ord) AS s1, arg_min(ord % 10, ord) AS i0, arg_max(ord % 10, ord) AS i1 FROM issues GROUP BY requirement_id)"""),
)
def a07(spark: SparkSession, sf: str) -> DataFrame:
    history = tables.issues(spark, sf).select("requirement_id", "ord", F.col("line").cast("double").alias("overall_score"), (F.col("ord") % 10).alias("issues"))
    return aggregate.trends(history, "requirement_id")


@query(
    "a08_correlations",
    with_issues("""SELECT requirement_id, unnest.categories AS categories, unnest.relationship AS relationship, unnest.impact AS impact FROM (SELECT requirement_id, unnest(list_filter([
    CASE WHEN count_if(severity = 'high') > 0 AND max(line) > 90 THEN {'categories': 'code_quality,performance', 'relationship': 'High complexity may contribute to memory usage', 'impact': 'medium'} END,
    CASE WHEN count_if(severity = 'critical') > 0 AND max(line) < 80 + 20 * (requirement_id % 2) AND 100 - max(line) < 80 THEN {'categories': 'code_quality,security', 'relationship': 'Lower maintainability can hide security issues', 'impact': 'high'} END], lambda x: x IS NOT NULL)) AS unnest FROM issues GROUP BY requirement_id)""").replace(" AND max(line) < 80 + 20 * (requirement_id % 2)", ""),
)
def a08(spark: SparkSession, sf: str) -> DataFrame:
    wide = tables.issues(spark, sf).groupBy("requirement_id").agg(
        F.count_if(F.col("severity") == "high").alias("complexity_issues"), F.when(F.max("line") > 90, "high").otherwise("low").alias("memory_usage"),
        F.count_if(F.col("severity") == "critical").alias("vulnerabilities"), (100 - F.max("line")).alias("maintainability_score"),
    )
    return aggregate.correlations(wide)


@query("a09_comprehensive", with_issues("SELECT run_id, round_even(avg(round_even(score * 10, 6)), 2) AS overall_score, CAST(sum(CASE WHEN line <> 0 THEN line WHEN ord % 3 <> 0 THEN ord % 3 ELSE 1 END) AS BIGINT) AS total_issues FROM issues GROUP BY run_id"))
def a09(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.issues(spark, sf).select("run_id", rules.rounded(F.col("score") * 10, 6).alias("score"), F.col("line").alias("issues"), (F.col("ord") % 3).alias("vulnerabilities"), F.lit(1).cast("long").alias("bottlenecks"))
    return aggregate.comprehensive(rows, "run_id")


@query("a14_by_source", with_issues("SELECT run_id, source, count(*) AS n, array_to_string(list_sort(list(ord)), ',') AS ords FROM issues GROUP BY run_id, source"))
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.by_source(tables.issues(spark, sf), "run_id").withColumn("ords", F.concat_ws(",", F.col("ords").cast("array<string>")))


@query("a15_by_analysis_type", f"WITH {SOURCED_SQL} SELECT count_if(source IN ('security_vulnerability', 'security_risk')) AS security_analysis, count_if(source = 'performance_bottleneck') AS performance_analysis, count_if(source IN ('style', 'quality')) AS static_analysis, CAST(0 AS BIGINT) AS ai_analysis FROM sourced")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.by_analysis_type(sourced(spark, sf))


@query("a16_progress", with_issues("SELECT count(DISTINCT run_id) AS reports, count(*) AS issue_count, " + ", ".join(f"count_if(severity = '{s}') AS {s}" for s in SEVERITIES) + " FROM issues"))
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.progress(aggregate.severity_map(tables.issues(spark, sf), "run_id"))


def _score_sql(penalties: dict[str, float], base: float, shift: str) -> str:
    total = " + ".join(f"{p} * count_if(severity = '{s}')" for s, p in penalties.items())
    counts = ", ".join(f"count_if(severity = '{s}') AS {s}" for s in penalties)
    return with_issues(f"SELECT requirement_id, round_even(greatest(0.0, least(10.0, CAST({base} AS DOUBLE) - CAST({total} AS DOUBLE) + {shift})), 3) AS score, round_even(CAST({total} AS DOUBLE), 3) AS penalty, {counts} FROM issues GROUP BY requirement_id")


@query("a17_security_score", _score_sql(rules.SECURITY_PENALTY, 9.5, "(-0.35 * (CAST(max(line) % 10 AS DOUBLE) - 5.0))"))
def a17(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.rule_score(tables.issues(spark, sf), "requirement_id", penalties=rules.SECURITY_PENALTY, default=0.4, base=9.5, shift=-0.35 * ((F.max("line") % 10).cast("double") - 5.0))


@query("a18_performance_score", _score_sql(rules.PERFORMANCE_PENALTY, 8.0, "(CAST(max(line) % 10 AS DOUBLE) - 5.0)"))
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.rule_score(tables.issues(spark, sf), "requirement_id", penalties=rules.PERFORMANCE_PENALTY, default=0.5, base=8.0, shift=(F.max("line") % 10).cast("double") - 5.0)


@query("a19_score_fusion", with_issues("SELECT ord, CASE WHEN line % 7 = 0 THEN score ELSE round_even(greatest(0.0::DOUBLE, least(10.0::DOUBLE, w * m + (1.0::DOUBLE - w) * score)), 3) END AS fused FROM (SELECT ord, line, score::DOUBLE AS score, (line % 11)::DOUBLE AS m, (CASE WHEN line / 100.0 >= 0.8 THEN 0.65 WHEN line / 100.0 >= 0.55 THEN 0.55 ELSE 0.4 END)::DOUBLE AS w FROM issues)"))
def a19(spark: SparkSession, sf: str) -> DataFrame:
    model = F.when(F.col("line") % 7 != 0, (F.col("line") % 11).cast("double"))
    return tables.issues(spark, sf).select("ord", rules.fused_score(F.col("score"), model, F.col("line") / 100.0).alias("fused"))


_LABELS = ("NEGATIVE", "label_1", "Neutral", "other", "unsafe_good")


@query("a20_label_score", with_issues("""SELECT ord, round_even(CAST(greatest(0.0, least(10.0, CASE line % 5 WHEN 0 THEN 5.5 - 4.5 * c WHEN 1 THEN 5.5 + 4.0 * c WHEN 2 THEN 5.5 WHEN 3 THEN 5.0 + (c - 0.5) ELSE 5.5 - 4.5 * c END)) AS DOUBLE), 3) AS score FROM (SELECT ord, line, line::DOUBLE / 100.0::DOUBLE AS c FROM issues)"""))
def a20(spark: SparkSession, sf: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("line") % 5 + 1).cast("int"))
    return tables.issues(spark, sf).select("ord", rules.label_score(label, F.col("line") / 100.0).alias("score"))


@query("a21_overall_complexity", with_issues("""SELECT requirement_id, round_even(avg(s), 3) AS average_score, round_even(max(s), 3) AS max_score, count(*) AS n, CASE WHEN round_even(avg(s), 3) >= 8 THEN 'critical' WHEN round_even(avg(s), 3) >= 6.8 THEN 'high' WHEN round_even(avg(s), 3) >= 5.4 THEN 'medium' ELSE 'low' END AS risk_level
FROM (SELECT requirement_id, score::DOUBLE * 0.5::DOUBLE + 5.0::DOUBLE * (1.0::DOUBLE - 0.5::DOUBLE) AS s FROM issues) GROUP BY requirement_id"""))
def a21(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.overall_complexity(tables.issues(spark, sf).select("requirement_id", "score", F.lit(0.5).alias("confidence")), "requirement_id")


@query("a22_threat_model", with_issues("SELECT ord, round_even((30.0::DOUBLE - CASE WHEN line % 2 = 0 THEN 2.0 ELSE 0.0 END) / 6, 2) AS overall_risk_score FROM issues"))
def a22(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.stride(tables.issues(spark, sf).select("ord", (F.col("line") % 2 == 0).alias("authentication_present")), "ord")


@query("a24_a25_effort", with_issues("""SELECT *, CASE WHEN critical >= 2 OR total >= 8 THEN '1-2 weeks' WHEN critical >= 1 OR high >= 2 OR total >= 5 THEN '3-5 days' WHEN total >= 1 THEN '1-2 days' ELSE '0.5-1 day' END AS estimated_effort,
CASE WHEN total = 0 THEN '无' WHEN total < 10 THEN '低 (~0.5-1天)' WHEN total < 30 THEN '中 (~2-3天)' WHEN total < 60 THEN '高 (~1周)' ELSE '非常高 (>1周)' END AS fix_effort
FROM (SELECT requirement_id, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count(*) AS total FROM issues GROUP BY requirement_id)"""))
def a24(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.remediation_effort(tables.issues(spark, sf), "requirement_id")


@query("a26_risk_level", with_issues("""SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 5 THEN 'medium' ELSE 'low' END AS risk_level FROM (SELECT requirement_id, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium FROM issues GROUP BY requirement_id)"""))
def a26(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.risk_insight(tables.issues(spark, sf), "requirement_id")


@query("a27_chunk_mean", with_issues("SELECT requirement_id, round_even(avg(score::DOUBLE), 6) AS score FROM issues WHERE ord % 10 < 3 GROUP BY requirement_id"))
def a27(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.mean_of_first(tables.issues(spark, sf).withColumn("idx", F.col("ord") % 10), 3, "requirement_id")


@query("a28_cache_stats", with_issues("SELECT source, count(*) AS requests, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS hits, round_even((count(*) - count(DISTINCT line)) / count(*), 4) AS hit_rate FROM issues GROUP BY source"))
def a28(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.cache_stats(tables.issues(spark, sf).withColumnRenamed("line", "cache_key"), "source")


@query("a29_status", with_issues("SELECT requirement_id, CASE WHEN bool_and(line <> 0) THEN 'success' ELSE 'partial' END AS status FROM issues GROUP BY requirement_id"))
def a29(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.status_of(tables.issues(spark, sf).withColumn("success", F.col("line") != 0), "requirement_id")


@query("a34_collected_sets", with_issues("SELECT run_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS types, array_to_string(list_sort(list(DISTINCT file)), ',') AS files FROM issues GROUP BY run_id"))
def a34(spark: SparkSession, sf: str) -> DataFrame:
    return tables.issues(spark, sf).groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("types"), F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))


@query("t01_priority", with_issues(f"SELECT ord, severity, {RANK_SQL} AS rank FROM issues"))
def t01(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.prioritize(tables.issues(spark, sf)).select("ord", "severity", "rank")


@query("t02_action_plan", with_issues(f"""SELECT requirement_id, bucket, CAST(position AS INTEGER) AS position, ord FROM (SELECT *, row_number() OVER (PARTITION BY requirement_id, bucket ORDER BY {RANK_SQL}, ord) AS position FROM
(SELECT *, CASE WHEN severity IN ('critical', 'high') THEN 'immediate_actions' WHEN severity = 'medium' THEN 'short_term_goals' ELSE 'long_term_improvements' END AS bucket FROM issues)) WHERE position <= 5"""))
def t02(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.action_plan(tables.issues(spark, sf), "requirement_id").select("requirement_id", "bucket", "position", "ord")


@query("t03_risk_sort", with_issues("SELECT ord, severity, round_even(least(10.0::DOUBLE, (CASE severity WHEN 'critical' THEN 9.0 WHEN 'high' THEN 7.5 WHEN 'medium' THEN 5.5 ELSE 3.0 END)::DOUBLE + line::DOUBLE / 100 * 1.5::DOUBLE), 2) AS risk_score FROM issues"))
def t03(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.by_risk(tables.issues(spark, sf).withColumn("confidence", F.col("line") / 100.0)).select("ord", "severity", "risk_score")


@query("t05_source_caps", f"""WITH {SOURCED_SQL} SELECT ord, run_id, source FROM (SELECT *, row_number() OVER (PARTITION BY run_id, source ORDER BY ord) AS rn FROM sourced) WHERE rn <= CASE source WHEN 'quality' THEN 50 WHEN 'security' THEN 50 WHEN 'type' THEN 50 ELSE 30 END""")
def t05(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.capped(sourced(spark, sf), "run_id").select("ord", "run_id", "source")


@query("t07_remediation_buckets", with_issues("SELECT CASE WHEN severity IN ('critical', 'high') THEN 'immediate_actions' WHEN severity = 'medium' THEN 'short_term_fixes' ELSE 'long_term_improvements' END AS bucket, count(*) AS n FROM issues GROUP BY bucket"))
def t07(spark: SparkSession, sf: str) -> DataFrame:
    return tables.issues(spark, sf).groupBy(ranking.remediation_bucket(F.col("severity")).alias("bucket")).agg(F.count("*").alias("n"))


@query("t11_per_source_and_severity", with_issues("SELECT ord, CAST(greatest(n - 5, 0) AS BIGINT) AS more FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY severity, source) AS n FROM issues WINDOW w AS (PARTITION BY severity, source ORDER BY ord)) WHERE rn <= 5"))
def t11(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.per_severity_and_source(tables.issues(spark, sf)).select("ord", "more")


@query("t13_sample_size", with_issues("SELECT least(count(*), 100) AS n, true AS inside FROM issues"))
def t13(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.issues(spark, sf)
    return ranking.sample_rows(rows, 100).join(rows.select(F.col("ord"), F.lit(True).alias("there")), "ord", "left").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("there", F.lit(False))).alias("inside"))


@query("t13_sample", with_issues("SELECT ord, run_id, severity FROM issues ORDER BY md5('42:' || ord) LIMIT 100"))
def t13_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.sample_rows(tables.issues(spark, sf), 100).select("ord", "run_id", "severity")


@query("d01_dedupe_issues", with_issues("SELECT ord, description, line FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(description)), lower(trim(source)), CASE WHEN line = 0 THEN '' ELSE CAST(line AS VARCHAR) END ORDER BY ord) AS rn FROM issues) WHERE rn = 1"))
def d01(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.dedupe_issues(tables.issues(spark, sf)).select("ord", "description", "line")


@query("d02_dedupe_vulnerabilities", with_issues("""SELECT run_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY r DESC, seen) AS p FROM (SELECT *, row_number() OVER (PARTITION BY run_id, k ORDER BY r DESC, ord) AS rn, min(ord) OVER (PARTITION BY run_id, k) AS seen FROM
(SELECT run_id, ord, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END AS r, lower(source || '|' || file || '|' || tool) AS k FROM issues)) WHERE rn = 1) WHERE p <= 10"""))
def d02(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.issues(spark, sf).select("run_id", "ord", "severity", F.upper("source").alias("type"), F.col("file").alias("location"), F.concat(F.lit(" "), "tool", F.lit("  ")).alias("description"))
    return dedupe.dedupe_vulnerabilities(rows.withColumn("description", F.trim("description")), "run_id").select("run_id", "ord")


@query("d06_dedupe_requests", with_issues("SELECT count(*) AS n FROM (SELECT DISTINCT requirement_id, run_id FROM issues)"))
def d06(spark: SparkSession, sf: str) -> DataFrame:
    return tables.issues(spark, sf).dropDuplicates(["requirement_id", "run_id"]).agg(F.count("*").alias("n"))


@query("d13_signatures", with_issues("SELECT file || '|' || source || '|' || severity || '|' || tool || '|' || CASE WHEN requirement_id = 0 THEN '' ELSE CAST(requirement_id AS VARCHAR) END AS signature, count(*) AS n FROM issues GROUP BY signature"))
def d13(spark: SparkSession, sf: str) -> DataFrame:
    return tables.issues(spark, sf).groupBy(dedupe.semantic_signature().alias("signature")).agg(F.count("*").alias("n"))


@query("d14_cache_keys", with_issues("SELECT ord, sha256('classify|' || sha256(description) || '|{}') AS cache_key FROM issues"))
def d14(spark: SparkSession, sf: str) -> DataFrame:
    return tables.issues(spark, sf).select("ord", dedupe.cache_key(F.lit("classify"), F.col("description"), F.lit("{}")).alias("cache_key"))


@query("f17_detections", with_issues("SELECT ord, CASE WHEN severity IN ('critical', 'high', 'medium') THEN severity WHEN line / 100.0 > 0.88 THEN 'medium' ELSE 'low' END AS detected FROM issues WHERE line / 100.0 > 0.7"))
def f17(spark: SparkSession, sf: str) -> DataFrame:
    confidence = F.col("line") / 100.0
    return tables.issues(spark, sf).filter(confidence > 0.7).select("ord", rules.detection_severity(F.lit("label"), F.col("severity"), confidence).alias("detected"))


@query("f18_confident_classes", with_issues("SELECT count(*) AS n FROM issues WHERE line / 100.0 > 0.6"))
def f18(spark: SparkSession, sf: str) -> DataFrame:
    return tables.issues(spark, sf).filter(F.col("line") / 100.0 > 0.6).agg(F.count("*").alias("n"))


@query("u01_union_all", with_issues("SELECT source, count(*) * 2 AS n FROM issues GROUP BY source"))
def u01(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.issues(spark, sf)
    return rows.unionByName(rows.drop("score"), allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"))


@query("u03_set_equality", with_issues("SELECT run_id, list_sort(list(DISTINCT source)) = list_sort(list(DISTINCT source) FILTER (line > 20)) AS complete FROM issues GROUP BY run_id"))
def u03(spark: SparkSession, sf: str) -> DataFrame:
    seen = F.array_sort(F.collect_set(F.when(F.col("line") > 20, F.col("source"))))
    return tables.issues(spark, sf).groupBy("run_id").agg((F.array_sort(F.collect_set("source")) == seen).alias("complete"))


@query("x14_x18_score_labels", with_issues("""SELECT ord, CASE WHEN score >= 9 THEN 'A' WHEN score >= 8 THEN 'B' WHEN score >= 7 THEN 'C' WHEN score >= 6 THEN 'D' ELSE 'F' END AS grade,
CASE WHEN score >= 9 THEN 'Excellent' WHEN score >= 7.5 THEN 'Good' WHEN score >= 6 THEN 'Fair' WHEN score >= 4 THEN 'Poor' ELSE 'Critical' END AS performance,
CASE WHEN score >= 8.5 THEN 'Excellent' WHEN score >= 7 THEN 'Good' WHEN score >= 5 THEN 'Fair' WHEN score >= 3 THEN 'Poor' ELSE 'Critical' END AS security, severity AS priority,
CASE severity WHEN 'critical' THEN '🚨 严重' WHEN 'high' THEN '🔴 高' WHEN 'medium' THEN '🟡 中' ELSE '🟢 低' END AS label FROM issues"""))
def x14(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("score")
    return tables.issues(spark, sf).select("ord", rules.scan_grade(s).alias("grade"), rules.performance_grade(s).alias("performance"), rules.security_rating(s).alias("security"), rules.priority(F.upper("severity")).alias("priority"), lookup(F.col("severity"), rules.SEVERITY_LABEL, F.col("severity")).alias("label"))
