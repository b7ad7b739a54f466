"""Fingerprints, first-wins and best-wins dedupe, upserts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key
from .ranking import first_per
from .store import with_fresh_ids


def issue_key() -> list[Column]:
    lower = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    line = F.when(F.coalesce(F.col("line"), F.lit(0)) == 0, "").otherwise(F.col("line").cast("string"))
    return [lower("description"), lower("source"), line]


def dedupe_issues(issues: DataFrame) -> DataFrame:
    """First issue by ``ord`` of each (description, source, line)."""
    return first_per(issues, issue_key(), ["ord"])


def squeezed(*values: Column) -> Column:
    """Values joined by bars, lower-case, white space single."""
    return F.lower(F.trim(F.regexp_replace(F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]), r"\s+", " ")))


#: Ranks of vulnerability severities; unknown ones count as low.
VULNERABILITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def vulnerability_rank(severity: Column) -> Column:
    out = F.lit(2)
    for name, rank in VULNERABILITY_RANK.items():
        out = F.when(F.lower(F.coalesce(severity, F.lit("low"))) == name, rank).otherwise(out)
    return out


def dedupe_vulnerabilities(rows: DataFrame, *keys: str, n: int = 10) -> DataFrame:
    """Most severe row of each (type, location, description), the first among equals; ``n`` per key, most severe first.

    Rows of equal severity keep the order in which their descriptions first came up.
    """
    marked = rows.withColumn("__key", squeezed(F.col("type"), F.col("location"), F.col("description"))).withColumn("__rank", vulnerability_rank(F.col("severity")))
    same = Window.partitionBy(*keys, "__key")
    best = marked.withColumn("__seen", F.min("ord").over(same)).withColumn("__rn", F.row_number().over(same.orderBy(F.desc("__rank"), "ord"))).filter("__rn = 1")
    if not keys:
        return best.orderBy(F.desc("__rank"), "__seen").limit(n).select(*rows.columns)
    return first_per(best, list(keys), [F.desc("__rank"), F.col("__seen")], n).select(*rows.columns)


def pattern_fingerprint() -> Column:
    fields = [norm_key(F.col(c)) for c in ("title", "error_type", "language", "framework")]
    return F.concat_ws("|", *fields, F.substring(norm_key(F.col("error_description")), 1, 280))


def issue_fingerprint() -> Column:
    number = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, "").otherwise(F.col(c).cast("string"))
    return F.concat_ws(
        "|",
        F.coalesce(F.col("session_id").cast("string"), F.lit("None")),
        F.coalesce(F.col("pattern_id").cast("string"), F.lit("None")),
        norm_key(F.col("project_path")),
        norm_key(F.col("file_path")),
        number("start_line"),
        number("end_line"),
        F.substring(norm_key(F.col("problem_phenomenon")), 1, 220),
        F.substring(norm_key(F.col("root_cause")), 1, 220),
    )


def semantic_signature() -> Column:
    lower = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    requirement = F.when(F.coalesce(F.col("requirement_id"), F.lit(0)) == 0, "").otherwise(F.col("requirement_id").cast("string"))
    return F.concat_ws("|", *map(lower, ("file", "source", "severity", "tool")), requirement)


def canonical_map(data: Column) -> Column:
    """JSON of a map with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(data))))


def dedupe_tasks(tasks: DataFrame) -> DataFrame:
    """First task by ``ord`` of each (target, action, data)."""
    return first_per(tasks, ["target", "action", canonical_map(F.col("data"))], ["ord"])


def cache_key(kind: Column, payload: Column, options: Column) -> Column:
    """SHA-256 of the type, the payload's SHA-256 and the options' canonical JSON."""
    return F.sha2(F.concat_ws("|", kind, F.sha2(F.coalesce(payload, F.lit("")), 256), options), 256)


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not there yet, the first by ``ord`` of each key."""
    return first_per(incoming.join(existing.select(key).distinct(), key, "left_anti"), [key], ["ord"])


def matched_ids(incoming: DataFrame, existing: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Incoming rows with ``existing_id``, the smallest id of an existing row of the same key (null: none)."""
    ids = existing.groupBy(key).agg(F.min(id_col).alias("existing_id"))
    return incoming.join(ids, key, "left")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str], id_col: str = "id") -> DataFrame:
    """Existing rows with the fields of the last incoming row of their key, and new rows with fresh ids.

    Null incoming fields keep the old value. New ids follow the largest one in ``ord`` order.
    """
    last = first_per(incoming, [key], [F.desc("ord")])
    changes = last.select(key, *[F.col(f).alias(f"__new_{f}") for f in fields])
    updated = existing.join(changes, key, "left").select(*[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in existing.columns])
    fresh = last.join(existing.select(key).distinct(), key, "left_anti")
    numbered = with_fresh_ids(fresh, existing, id_col)
    missing = [c for c in existing.columns if c not in numbered.columns]
    return updated.unionByName(numbered.withColumns({c: F.lit(None).cast(existing.schema[c].dataType) for c in missing}).select(*existing.columns))


PLAN_FIELDS = ("type", "description", "recommendation", "priority", "expected_effect", "location", "reason")
PLAN_CATEGORIES = ("immediate_optimizations", "algorithmic_improvements", "architectural_changes")


def merge_plans(items: DataFrame) -> DataFrame:
    """Optimisation items of each plan, deduplicated across its three categories, five per category.

    ``items``: plan_id, category, pos and the plan fields. Items of one text are merged in category
    and list order: one of higher priority than all before gives the values, the others fill its
    gaps, so a gap is filled by the last such item that has the field, else by the first item at all.
    """
    gaps = ("expected_effect", "location", "reason")
    ordered = F.array_position(F.array(*map(F.lit, PLAN_CATEGORIES)), F.col("category")).cast("int")
    field = {f: F.coalesce(F.col(f), F.lit("")) for f in PLAN_FIELDS}
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in VULNERABILITY_RANK.items() for x in pair]), field["priority"]), F.lit(3))
    said = F.concat_ws("|", F.when(field["type"] == "", "general").otherwise(field["type"]), field["description"], field["recommendation"])
    key = F.lower(F.trim(F.regexp_replace(said, r"(?U)[\s\x1C-\x1F]+", " ")))
    place = F.struct(F.coalesce(ordered, F.lit(len(PLAN_CATEGORIES) + 1)).alias("category_ord"), F.col("pos").alias("pos"))
    rows = items.select(F.col("plan_id").cast("long").alias("plan_id"), "category", place.alias("place"), rank.alias("rank"), key.alias("key"), *[c.alias(f) for f, c in field.items()])
    before = F.max("rank").over(Window.partitionBy("plan_id", "key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("leads", F.when(F.col("rank") > F.coalesce(before, F.lit(0)), F.col("rank")))
    filled = [F.coalesce(F.max_by(f, F.when(F.col(f) != "", F.col("leads"))), F.min_by(f, F.when(F.col(f) != "", F.col("place"))), F.lit("")).alias(f) for f in gaps]
    kept = ["category", "place", "rank", *[f for f in PLAN_FIELDS if f not in gaps]]
    merged = rows.groupBy("plan_id", "key").agg(F.min("place").alias("first"), F.max_by(F.struct(*kept), "leads").alias("main"), *filled).select("plan_id", "first", "main.*", *gaps)
    merged = merged.withColumn("category_ord", F.col("place.category_ord")).filter(F.col("category_ord") <= len(PLAN_CATEGORIES))
    placed = first_per(merged, ["plan_id", "category_ord"], [F.desc("rank"), F.col("first")], 5)
    position = F.row_number().over(Window.partitionBy("plan_id", "category_ord").orderBy(F.desc("rank"), "first")).cast("long")
    return placed.select("plan_id", "category", position.alias("position"), *PLAN_FIELDS)


def dedupe_remediation(fixes: DataFrame, hardening: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Fixes once across the three buckets in order, ``n`` each; hardening rows whose text is no fix, once each.

    Texts count even where the limit drops their row.
    """
    text = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    order = F.array_position(F.array(F.lit("immediate_actions"), F.lit("short_term_fixes"), F.lit("long_term_improvements")), F.col("bucket"))
    keyed = fixes.withColumn("__text", text("fix")).withColumn("__bucket", order).filter(F.col("__text") != "")
    once = first_per(keyed, ["plan_id", "__text"], ["__bucket", "ord"])
    kept = first_per(once, ["plan_id", "bucket"], ["ord"], n).select(*fixes.columns)
    advice = hardening.withColumn("__text", text("recommendation")).join(once.select("plan_id", "__text"), ["plan_id", "__text"], "left_anti")
    return kept, first_per(advice, ["plan_id", squeezed(F.col("category"), F.col("recommendation"))], ["ord"]).select(*hardening.columns)
