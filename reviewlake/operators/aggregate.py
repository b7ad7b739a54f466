"""Counts, scores and reports over issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..schema import SEVERITIES, severity_rank


def severity_counts(issues: DataFrame, *keys: str, lower: bool = False) -> DataFrame:
    """Issues per severity (and keys); null counts as low."""
    severity = F.coalesce("severity", F.lit("low"))
    return issues.groupBy(*keys, (F.lower(severity) if lower else severity).alias("severity")).agg(F.count("*").alias("n"))


def severity_map(issues: DataFrame, *keys: str) -> DataFrame:
    """One row per key: issue_count and severity_stats, a map of severity to count."""
    counts = severity_counts(issues, *keys)
    return counts.groupBy(*keys).agg(F.sum("n").alias("issue_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("severity_stats"))


#: Sources that the run summary counts.
STATIC_SOURCES = ("quality", "security", "type", "style")
#: Issues of each source that a consolidated report keeps, in input order.
SOURCE_CAPS = {"quality": 50, "security": 50, "type": 50, "style": 30, "ai_quality_fix": 20, "ai_quality_enhancement": 20, "security_ai": 30, "performance_bottleneck": 30}


def run_summary(issues: DataFrame, sources: tuple[str, ...] = STATIC_SOURCES) -> DataFrame:
    """Per run: issues of static sources and their severities, one column each."""
    kept = issues.filter(F.col("source").isin(*sources))
    return kept.groupBy("run_id").agg(F.count("*").alias("issue_count"), *[F.count_if(F.coalesce("severity", F.lit("low")) == s).alias(s) for s in SEVERITIES])


def scan_summary(issues: DataFrame, *keys: str) -> DataFrame:
    """Per key: totals, the four severity counts, quality score and grade, flags, advice."""
    n = {s: F.count_if(F.coalesce("severity", F.lit("low")) == s) for s in rules.SCAN_PENALTY}
    counted = issues.groupBy(*keys).agg(
        F.count("*").alias("total_issues"),
        *[c.alias(s) for s, c in n.items()],
        F.coalesce(F.bool_or(F.col("source") == "security"), F.lit(False)).alias("has_security_issues"),
        F.coalesce(F.bool_or(F.col("source") == "type"), F.lit(False)).alias("has_type_issues"),
    )
    penalty = sum((F.col(s) * p for s, p in rules.SCAN_PENALTY.items()), F.lit(0.0))
    raw = F.greatest(F.lit(0.0), 10.0 - penalty)
    advice = F.array_compact(
        F.array(
            F.when(F.col("critical") > 0, rules.SCAN_ADVICE[0]),
            F.when(F.col("high") > 0, rules.SCAN_ADVICE[1]),
            F.when(F.col("total_issues") > 50, rules.SCAN_ADVICE[2]),
            F.when(F.col("low") > 20, rules.SCAN_ADVICE[3]),
        )
    )
    return counted.select("*", rules.rounded(raw, 1).alias("quality_score"), rules.scan_grade(raw).alias("quality_grade"), advice.alias("recommendations"))


def category_issues(results: DataFrame) -> DataFrame:
    """Issues, vulnerabilities and bottlenecks of each category as one table, in input order.

    ``results``: category, score, and the three arrays of struct(type, severity, count).
    """
    defaults = {"issues": (F.col("category"), "low"), "vulnerabilities": (F.lit("vulnerability"), "medium"), "bottlenecks": (F.lit("bottleneck"), "medium")}
    parts = []
    for k, (field, (kind, severity)) in enumerate(defaults.items()):
        rows = results.select("category", "score", F.posexplode(field).alias("pos", "i"))
        parts.append(rows.select("category", F.lit(k).alias("part"), "pos", F.coalesce("i.type", kind).alias("type"), F.coalesce("i.severity", F.lit(severity)).alias("severity"), F.coalesce("i.count", F.lit(1)).alias("count")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def aggregate_categories(results: DataFrame) -> DataFrame:
    """Per category: score, issue_count, whether it needs work; overall_score on every row (two digits, 0 without scores)."""
    counts = category_issues(results).groupBy("category").agg(F.sum("count").alias("issue_count"))
    overall = results.agg(F.coalesce(rules.rounded(F.avg("score"), 2), F.lit(0.0)).alias("overall_score"))
    advice = F.when(F.coalesce("score", F.lit(0)) < 75, F.concat(F.lit("改进 "), F.col("category"), F.lit(" 以提升得分")))
    return results.select("category", "score").join(counts, "category", "left").crossJoin(F.broadcast(overall)).select("category", "score", F.coalesce("issue_count", F.lit(0)).alias("issue_count"), "overall_score", advice.alias("recommendation"))


def executive_summary(totals: DataFrame) -> DataFrame:
    """Headline, concerns and successes of rows with overall_score, total_issues, critical_issues, high_issues."""
    o, t, c, h = (F.coalesce(x, F.lit(0)) for x in ("overall_score", "total_issues", "critical_issues", "high_issues"))
    text = lambda x: x.cast("string")
    headline = F.concat(F.lit("Overall score "), text(o), F.lit(" with "), text(t), F.lit(" issues (critical:"), text(c), F.lit(" high:"), text(h), F.lit(")"))
    concerns = F.array_compact(F.array(F.when(c > 0, "存在关键高危问题"), F.when(o < 70, "整体质量需提升")))
    return totals.select("*", headline.alias("headline"), concerns.alias("main_concerns"), F.array_compact(F.array(F.when(o >= 80, "总体评分良好"))).alias("success_areas"))


def trends(history: DataFrame, *keys: str, order: str = "ord", score: str = "overall_score", issues: str = "issues") -> DataFrame:
    """First against last entry by ``order``: directions and improvement rate in percent (two digits)."""
    ends = history.groupBy(*keys).agg(
        F.min_by(F.struct(score, issues), order).alias("first"),
        F.max_by(F.struct(score, issues), order).alias("last"),
    )
    s0, s1 = F.coalesce(F.col("first")[score], F.lit(0)), F.coalesce(F.col("last")[score], F.lit(0))
    i0, i1 = F.coalesce(F.col("first")[issues], F.lit(0)), F.coalesce(F.col("last")[issues], F.lit(0))
    rate = F.when(s0 != 0, rules.rounded((s1 - s0) / F.nullif(s0, F.lit(0)) * 100, 2)).otherwise(0.0)
    return ends.select(
        *keys,
        F.when(s1 > s0, "improving").when(s1 < s0, "declining").otherwise("stable").alias("score_trend"),
        F.when(i1 < i0, "decreasing").when(i1 > i0, "increasing").otherwise("stable").alias("issues_trend"),
        rate.alias("improvement_rate"),
    )


def correlations(wide: DataFrame) -> DataFrame:
    """Findings of the two rules over rows with the four category figures (null: category absent)."""
    rules_ = F.array_compact(
        F.array(
            F.when((F.col("complexity_issues") > 0) & (F.col("memory_usage") == "high"), F.struct(F.lit("code_quality,performance").alias("categories"), F.lit("High complexity may contribute to memory usage").alias("relationship"), F.lit("medium").alias("impact"))),
            F.when((F.col("vulnerabilities") > 0) & (F.coalesce("maintainability_score", F.lit(100)) < 80), F.struct(F.lit("code_quality,security").alias("categories"), F.lit("Lower maintainability can hide security issues").alias("relationship"), F.lit("high").alias("impact"))),
        )
    )
    keep = [c for c in wide.columns if c not in ("complexity_issues", "memory_usage", "vulnerabilities", "maintainability_score")]
    return wide.select(*keep, F.inline(rules_))


def comprehensive(results: DataFrame, *keys: str) -> DataFrame:
    """Mean score (two digits) and the total of the first non-zero count of each category."""
    first = F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in ("issues", "vulnerabilities", "bottlenecks")], F.lit(0))
    return results.groupBy(*keys).agg(F.coalesce(rules.rounded(F.avg("score"), 2), F.lit(0.0)).alias("overall_score"), F.sum(first).alias("total_issues"))


def by_source(issues: DataFrame, *keys: str) -> DataFrame:
    """Issues of each source in order; a null source is named unknown."""
    return issues.groupBy(*keys, F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("ord")).alias("ords"))


def by_analysis_type(issues: DataFrame) -> DataFrame:
    """One row: issues of each analysis type by the source map."""
    return issues.agg(*[F.count_if(F.col("source").isin(*sources)).alias(t) if sources else F.lit(0).cast("long").alias(t) for t, sources in rules.TYPE_SOURCES.items()])


def rule_score(issues: DataFrame, *keys: str, penalties: dict[str, float], default: float, base: float, shift: Column | None = None) -> DataFrame:
    """Base less the penalties of each key's issues plus ``shift`` (an aggregate), within 0 and 10, three digits.

    Penalties are summed as counts times weights, so the order of rows cannot move the result.
    """
    severity = F.lower(F.coalesce("severity", F.lit("low")))
    known = [F.count_if(severity == s).alias(f"n_{s}") for s in penalties]
    counted = issues.groupBy(*keys).agg(F.count("*").alias("n"), *known, (F.lit(0.0) if shift is None else shift).alias("shift"))
    rest = F.col("n") - sum((F.col(f"n_{s}") for s in penalties), F.lit(0))
    penalty = sum((F.col(f"n_{s}") * p for s, p in penalties.items()), F.lit(0.0)) + rest * default
    return counted.select(*keys, rules.rounded(rules.clamp(base - penalty + F.col("shift")), 3).alias("score"), rules.rounded(penalty, 3).alias("penalty"), *[F.col(f"n_{s}").alias(s) for s in penalties])


def overall_complexity(classes: DataFrame, *keys: str) -> DataFrame:
    """Mean and largest class score, shrunk to 5 by confidence, three digits, with a risk level."""
    shrunk = F.col("score") * F.col("confidence") + 5.0 * (1.0 - F.col("confidence"))
    means = classes.groupBy(*keys).agg(rules.rounded(F.avg(shrunk), 3).alias("average_score"), rules.rounded(F.max(shrunk), 3).alias("max_score"), F.count("*").alias("n"))
    return means.withColumn("risk_level", rules.bands(F.col("average_score"), (8.0, "critical"), (6.8, "high"), (5.4, "medium"), other="low"))


#: The six threat categories of the fallback model.
STRIDE = ("Spoofing", "Tampering", "Repudiation", "Information Disclosure", "Denial of Service", "Elevation of Privilege")


def stride(flags: DataFrame, *keys: str) -> DataFrame:
    """Mean risk of the six threat categories, two digits: 5 each, spoofing 2 less where authentication is present."""
    return flags.select(*keys, rules.rounded((5.0 * len(STRIDE) - F.when(F.col("authentication_present"), 2.0).otherwise(0.0)) / len(STRIDE), 2).alias("overall_risk_score"))


def static_insights(summary: DataFrame) -> DataFrame:
    """Insight lines of rows as ``scan_summary`` makes them, in a fixed order."""
    bad = F.col("high") + F.col("critical")
    found = F.col("total_issues") > 0
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    lines = F.array_compact(
        F.array(
            F.when(~found, "未发现静态问题，代码基础健康。"),
            F.when(found & (bad > 0), text("存在 ", bad.cast("string"), " 个高/严重级别问题，需优先处理。")),
            F.when(found & (F.col("medium") > 0), text("有 ", F.col("medium").cast("string"), " 个中等级问题，可排期处理。")),
            F.when(found & (F.col("low") > 15), "低等级样式/约定问题较多，考虑引入自动格式化。"),
            F.when(F.col("has_security_issues"), "检测到安全相关静态问题，需结合安全分析结果确认风险。"),
            F.when(F.col("has_type_issues"), "存在类型检查问题，建议补全类型注解。"),
            text("静态质量等级: ", F.col("quality_grade")),
        )
    )
    return summary.withColumn("insights", lines)


def remediation_effort(issues: DataFrame, *keys: str) -> DataFrame:
    severity = F.lower("severity")
    counts = issues.groupBy(*keys).agg(F.count_if(severity == "critical").alias("critical"), F.count_if(severity == "high").alias("high"), F.count("*").alias("total"))
    return counts.withColumn("estimated_effort", rules.remediation_effort(F.col("critical"), F.col("high"), F.col("total"))).withColumn("fix_effort", rules.fix_effort(F.col("total")))


def risk_insight(issues: DataFrame, *keys: str) -> DataFrame:
    counts = issues.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium")])
    return counts.withColumn("risk_level", F.when(F.col("critical") > 0, "critical").when(F.col("high") > 0, "high").when(F.col("medium") > 5, "medium").otherwise("low"))


def mean_of_first(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Mean score of the chunks numbered below ``n``."""
    return rows.filter(F.col("idx") < n).groupBy(*keys).agg(rules.rounded(F.avg("score"), 6).alias("score"))


def cache_stats(requests: DataFrame, *keys: str) -> DataFrame:
    """Hit rate (four digits) where every repeat of a key is a hit."""
    used = requests.groupBy(*keys, "cache_key").agg(F.count("*").alias("n"))
    total = used.groupBy(*keys).agg(F.sum("n").alias("requests"), F.sum(F.col("n") - 1).alias("hits"))
    return total.withColumn("hit_rate", rules.rounded(F.col("hits") / F.col("requests"), 4))


def progress(reports: DataFrame) -> DataFrame:
    """Totals over report rows: the five known levels of severity_stats and issue_count."""
    level = lambda s: F.coalesce(F.sum(F.coalesce(F.try_element_at("severity_stats", F.lit(s)), F.lit(0))), F.lit(0)).alias(s)
    return reports.agg(F.count("*").alias("reports"), F.coalesce(F.sum("issue_count"), F.lit(0)).alias("issue_count"), *map(level, SEVERITIES))


def status_of(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys).agg(F.when(F.bool_and("success"), "success").otherwise("partial").alias("status"))


def file_groups(files: DataFrame, limit: int = 20, small: int = 10) -> DataFrame:
    """Files with their group: the first path segment (root at top level), one group for few files; first groups by name."""
    many = files.agg((F.count("*") > small).alias("many"))
    named = files.crossJoin(F.broadcast(many)).withColumn("grp", F.when(~F.col("many"), "all").when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("root"))
    groups = named.select("grp").distinct().orderBy("grp").limit(limit)
    return named.join(F.broadcast(groups), "grp").drop("many")


def group_contents(files: DataFrame) -> DataFrame:
    """Contents of each group's files with a header line, in path order, blank lines between."""
    part = F.concat(F.lit("/* File: "), F.col("path"), F.lit(" */\n"), F.col("content"))
    listed = files.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("path", part.alias("part")))).alias("parts"), F.count("*").alias("n_files"))
    return listed.select("grp", "n_files", F.concat_ws("\n\n", F.transform("parts", lambda p: p["part"])).alias("content"))


def headers(rows: DataFrame, data: str = "data", *keys: str) -> DataFrame:
    """Sorted set of the map's keys."""
    return rows.select(*keys, F.explode(F.map_keys(data)).alias("k")).groupBy(*keys).agg(F.array_sort(F.collect_set("k")).alias("headers"))


def ranked(issues: DataFrame) -> DataFrame:
    """Rank column of the severity order; ties keep the input order."""
    return issues.withColumn("rank", severity_rank(F.col("severity")))


def numbered(df: DataFrame, keys: list, order: list, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
