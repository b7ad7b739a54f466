"""Sorts, caps, buckets and top-k, all with explicit order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.vectors import cosine_distance
from ..schema import severity_rank
from .aggregate import SOURCE_CAPS, numbered


def prioritize(issues: DataFrame) -> DataFrame:
    """Issues by severity, ties in input order."""
    return issues.withColumn("rank", severity_rank(F.col("severity"))).orderBy("rank", "ord")


def first_per(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; the limit is pushed below the shuffle as a group limit."""
    return numbered(df, keys, order, "__rn").filter(F.col("__rn") <= n).drop("__rn")


def action_plan(issues: DataFrame, *keys: str, n: int = 5) -> DataFrame:
    """Immediate, short-term and long-term rows, ``n`` each, by severity and input order."""
    bucket = F.when(F.col("severity").isin("critical", "high"), "immediate_actions").when(F.col("severity") == "medium", "short_term_goals").when(F.col("severity").isin("low", "info"), "long_term_improvements")
    marked = issues.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull()).withColumn("rank", severity_rank(F.col("severity")))
    return numbered(marked, [*keys, "bucket"], ["rank", "ord"], "position").filter(F.col("position") <= n).drop("rank")


def capped(issues: DataFrame, *keys: str, caps: dict[str, int] | None = None) -> DataFrame:
    """Issues up to each source's cap in input order; sources without a cap have none kept."""
    caps = SOURCE_CAPS if caps is None else caps
    limit = F.lit(0)
    for source, n in caps.items():
        limit = F.when(F.col("source") == source, n).otherwise(limit)
    rows = numbered(issues.withColumn("cap", limit).filter("cap > 0"), [*keys, "source"], ["ord"])
    most = max(caps.values())
    return rows.filter((F.col("rn") <= most) & (F.col("rn") <= F.col("cap"))).drop("rn", "cap")


def by_risk(vulnerabilities: DataFrame) -> DataFrame:
    """Risk score and a severity derived from it where none is known, riskiest first, ties in input order."""
    known = F.coalesce("severity", F.lit("info"))
    score = rules.risk_score(F.col("severity"), F.col("confidence"))
    raw = F.least(F.lit(10.0), rules.number_of(known, rules.RISK_BASE, 2.0) + F.coalesce("confidence", F.lit(0.5)) * 1.5)
    derived = rules.bands(raw, (8.5, "high"), (6.5, "medium"), (4.0, "low"), other="info")
    return vulnerabilities.select(
        *[c for c in vulnerabilities.columns if c != "severity"],
        score.alias("risk_score"),
        F.when(known.isin(*rules.RISK_BASE), F.col("severity")).otherwise(derived).alias("severity"),
    ).orderBy(F.desc("risk_score"), "ord")


def per_severity_and_source(issues: DataFrame, n: int = 5) -> DataFrame:
    """Up to ``n`` issues of each severity and source with the number left out."""
    keys = ["severity", F.coalesce("source", F.lit("unknown"))]
    rows = numbered(issues.filter(F.col("severity").isin("critical", "high", "medium", "low")), keys, ["ord"])
    more = F.count("*").over(Window.partitionBy(*keys)) - n
    return rows.withColumn("more", F.greatest(more, F.lit(0))).filter(F.col("rn") <= n)


def remediation_bucket(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "immediate_actions").when(severity == "medium", "short_term_fixes").otherwise("long_term_improvements")


def sample_rows(df: DataFrame, n: int, key: str = "ord", seed: int = 42) -> DataFrame:
    """``n`` rows at random without replacement: those of least md5 of seed and key, whatever the partitions.

    Samples merge: each task keeps its ``n`` least rows, the least of those are the sample. Rows
    that repeat a key follow each other by a hash of all their columns.
    """
    priority = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return df.orderBy(priority, F.xxhash64(*df.columns)).limit(n)


def exact_distance(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Cosine distance of two tables' vectors that share a key."""
    return a.select(on, F.col("vector").alias("a")).join(b.select(on, F.col("vector").alias("b")), on).select(on, F.round(cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


def optimisation_bucket(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "immediate_optimizations").otherwise("algorithmic_improvements")
