"""Second pass: issues against known patterns and vectors, corrections, gap findings, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import embed, similarity
from .aggregate import numbered
from .dedupe import dedupe_issues
from .evidence import occurring, pattern_counts
from .ranking import first_per
from .search import nearest

TOP_K, THRESHOLD, GAP, MOST_FINDINGS, MOST_PATTERNS = 5, 0.78, 0.06, 5, 200


def _low(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))))


def matches(error_type: Column, pattern_text: Column, description: Column, source: Column) -> Column:
    """The pattern's type or the first 32 characters of its text in the description, or its type in the source."""
    kind, start, whole = _low(error_type), F.substring(_low(pattern_text), 1, 32), _low(description)
    held = lambda piece, text: (piece != "") & F.contains(text, piece)
    return held(kind, whole) | held(start, whole) | held(kind, _low(source))


def _pieces(patterns: DataFrame) -> DataFrame:
    """``(id, kind, start)``: what the rule seeks for each pattern."""
    return patterns.select("id", _low("error_type").alias("kind"), F.substring(_low("error_description"), 1, 32).alias("start"))


def text_evidence(issues: DataFrame, patterns: DataFrame, k: int = TOP_K, most_patterns: int | None = MOST_PATTERNS) -> DataFrame:
    """``(issue_ord, hit_ord, id, error_type, severity, solution)``: the first ``k`` patterns by id that match each issue.

    The rule reads the first ``most_patterns`` active patterns (None: all). Their types and the
    starts of their texts are sought at once, in one pass over the issues' texts and one over
    their sources; ``ord`` and ``id`` name one row each.
    """
    active = patterns.filter("status = 'active'")
    active = active if most_patterns is None else active.orderBy("id").limit(most_patterns)
    pieces = _pieces(active)
    kinds = pieces.select(F.col("kind").alias("needle"), "id")
    rows = issues.select(F.col("ord").alias("text_id"), _low("description").alias("text"), _low("source").alias("source"))
    hits = occurring(rows.select("text_id", "text"), kinds.unionByName(pieces.select(F.col("start").alias("needle"), "id")), k)
    hits = hits.unionByName(occurring(rows.select("text_id", F.col("source").alias("text")), kinds, k)).distinct()
    first = numbered(hits, ["text_id"], ["id"], "rn").filter(F.col("rn") <= k)
    return first.join(active.select("id", "error_type", "severity", "solution"), "id").select(F.col("text_id").alias("issue_ord"), (F.col("rn") - 1).alias("hit_ord"), "id", "error_type", "severity", "solution")


def match_counts(patterns: DataFrame, issues: DataFrame) -> DataFrame:
    """``(id, n)``: how many issues (ord, description, source) match each pattern that any does."""
    rows = issues.select(F.col("ord").alias("text_id"), _low("description").alias("text"), _low("source").alias("source"))
    return pattern_counts(_pieces(patterns), rows)


def vector_evidence(issues: DataFrame, vectors: DataFrame, k: int = TOP_K) -> DataFrame:
    """``(issue_ord, hit_ord, sqlite_id, error_type, severity, distance, similarity)``: nearest vectors of each distinct issue text.

    ``vectors``: sqlite_id, vector, error_type, severity; issues without a description have no hits.
    """
    texts = issues.filter("coalesce(trim(description), '') != ''").select(F.col("ord").alias("issue_ord"), F.concat(F.lit("["), F.trim(F.coalesce("source", F.lit(""))), F.lit("] "), F.trim("description")).alias("text"))
    once = texts.groupBy("text").agg(F.min("issue_ord").alias("query_id")).withColumn("vector", embed(F.col("text")))
    near = nearest(once.select("query_id", "vector"), vectors, k)
    ranked = near.withColumn("hit_ord", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "sqlite_id")) - 1)
    hits = ranked.join(vectors.drop("vector"), "sqlite_id").withColumn("similarity", similarity(F.col("distance")))
    return texts.join(once.select("text", "query_id"), "text").join(hits, "query_id").drop("text", "query_id")


def best_hits(evidence: DataFrame) -> DataFrame:
    """Most similar hit of each issue, the earliest among equals."""
    return first_per(evidence, ["issue_ord"], [F.desc("similarity"), F.col("hit_ord")])


def corrections(issues: DataFrame, evidence: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Issues with the severity of a similar known pattern; ``old_severity`` is set where it changed."""
    best = best_hits(evidence).select(F.col("issue_ord").alias("ord"), F.col("severity").alias("__severity"), "similarity", "sqlite_id")
    joined = issues.join(best, "ord", "left")
    old = F.lower(F.coalesce("severity", F.lit("low")))
    new = F.lower(F.coalesce("__severity", old))
    change = (F.col("similarity") >= threshold) & (new != "") & (new != old)
    changed = F.coalesce(change, F.lit(False))
    columns = {
        "old_severity": F.when(changed, old),
        "severity": F.when(changed, new).otherwise(F.col("severity")),
        "source": F.when(changed, F.concat(F.coalesce("source", F.lit("unknown")), F.lit("_db_corrected"))).otherwise(F.col("source")),
        "similarity": F.when(changed, F.col("similarity")),
        "sqlite_id": F.when(changed, F.col("sqlite_id")),
    }
    return joined.select(*[columns.pop(c).alias(c) if c in columns else c for c in issues.columns], *[v.alias(k) for k, v in columns.items()])


def findings(issues: DataFrame, evidence: DataFrame, threshold: float = THRESHOLD, most: int | None = MOST_FINDINGS, *keys: str) -> DataFrame:
    """New issues for very similar patterns that the description does not name, in issue and hit order, ``most`` per key."""
    near = evidence.filter(F.col("similarity") >= threshold + GAP).select(F.col("issue_ord").alias("ord"), "hit_ord", "sqlite_id", F.coalesce("error_type", F.lit("潜在已知问题模式命中")).alias("known"), F.coalesce("severity", F.lit("medium")).alias("hit_severity"), "similarity")
    hits = issues.join(near, "ord").filter(~F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lower("known")))
    rows = hits.select(
        "ord", "hit_ord", "requirement_id", "file", F.lit("db_supplemented").alias("source"), F.col("hit_severity").alias("severity"), "line",
        F.concat(F.lit("历史知识命中，可能漏报: "), F.col("known")).alias("description"), F.lit("second_pass_analysis").alias("tool"), "run_id", "sqlite_id", "similarity",
    )
    if most is None:
        return rows
    if keys:
        return first_per(rows, list(keys), ["ord", "hit_ord"], most)
    return rows.orderBy("ord", "hit_ord").limit(most)


def second_pass(issues: DataFrame, vectors: DataFrame, *keys: str) -> DataFrame:
    """Corrected issues and new findings as one deduplicated table; corrected issues come first."""
    evidence = vector_evidence(issues, vectors)
    corrected = corrections(issues, evidence).withColumn("part", F.lit(0)).withColumn("hit_ord", F.lit(0))
    new = findings(issues, evidence, THRESHOLD, MOST_FINDINGS, *keys).withColumn("part", F.lit(1)).withColumn("old_severity", F.lit(None).cast("string"))
    columns = ["part", "ord", "hit_ord", "requirement_id", "file", "source", "severity", "line", "description", "tool", "run_id", "old_severity", "sqlite_id", "similarity"]
    both = corrected.select(*columns).unionByName(new.select(*columns))
    # findings order behind all corrected issues: the key is (part, ord, hit)
    ranked = both.withColumnRenamed("ord", "issue_ord").withColumn("ord", F.struct("part", "issue_ord", "hit_ord"))
    return dedupe_issues(ranked).drop("ord")
