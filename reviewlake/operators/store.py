"""Fact store: filters, lookups and changes as functions from tables to tables.

Plain files know no update; a change is a new table, to be written as the next version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LAYERS, layer_text
from ..functions.vectors import embed
from .ranking import first_per


def where(df: DataFrame, **equal) -> DataFrame:
    """Conjunction of the predicates that are given (not None)."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def newest(df: DataFrame, limit: int | None = None, offset: int = 0, order: str = "created_at", id_col: str = "id", **equal) -> DataFrame:
    """Filtered rows, newest first, ties by the larger id; optional page."""
    out = where(df, **equal).orderBy(F.desc(order), F.desc(id_col))
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def by_ids(df: DataFrame, ids: DataFrame | list, id_col: str = "id") -> DataFrame:
    """Rows of a list or table of ids."""
    if isinstance(ids, list):
        return df.filter(F.col(id_col).isin(*ids)) if ids else df.limit(0)
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def latest_by(df: DataFrame, *keys: str, order: str = "created_at", id_col: str = "id") -> DataFrame:
    """Newest row of each key, ties by the larger id."""
    return first_per(df, list(keys), [F.desc(order), F.desc(id_col)])


#: Values that a new row takes where none is given.
DEFAULTS = {
    "review_session": {"status": "open"},
    "curated_issue": {"severity": "medium", "status": "open"},
    "issue_pattern": {"severity": "medium", "status": "active"},
}


def with_fresh_ids(rows: DataFrame, table: DataFrame, id_col: str = "id") -> DataFrame:
    """``rows`` with ids above the table's largest one, in the order of their unique ``ord``.

    The id is that maximum plus the distance from the smallest ``ord``: no global sort, each
    row by itself. Gaps in ``ord`` leave gaps in the ids.
    """
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    first = rows.agg(F.min("ord").alias("__first"))
    placed = rows.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(first))
    return placed.withColumn(id_col, (F.col("__top") + 1 + F.col("ord") - F.col("__first")).cast(table.schema[id_col].dataType)).drop("__top", "__first")


def insert(table: DataFrame, rows: DataFrame, target: str, now: Column | None = None, id_col: str = "id") -> DataFrame:
    """The table with ``rows`` added: ids follow the largest one in ``ord`` order, defaults and times filled in."""
    now = F.current_timestamp() if now is None else now
    new = with_fresh_ids(rows, table, id_col)
    values = []
    for field in table.schema:
        given = F.col(field.name) if field.name in new.columns else F.lit(None)
        default = DEFAULTS[target].get(field.name)
        if default is not None:
            given = F.coalesce(given, F.lit(default))
        elif field.name in ("created_at", "updated_at"):
            given = F.coalesce(given, now)
        values.append(given.cast(field.dataType).alias(field.name))
    return table.unionByName(new.select(*values))


def missing_parents(issues: DataFrame, sessions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Issues whose session does not exist, or whose pattern is named but does not."""
    no_session = issues.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti").withColumn("missing", F.lit("session"))
    no_pattern = issues.filter("pattern_id is not null").join(patterns.select(F.col("id").alias("pattern_id")), "pattern_id", "left_anti").withColumn("missing", F.lit("pattern"))
    return no_session.unionByName(no_pattern)


def set_status(table: DataFrame, ids: DataFrame | list, status: str, now: Column | None = None, id_col: str = "id") -> DataFrame:
    """The table with a new status (and time) on the given ids; unknown ids change nothing."""
    if isinstance(ids, list):
        hit = F.col(id_col).isin(*ids) if ids else F.lit(False)
        marked = table.withColumn("__hit", hit)
    else:
        marked = table.join(ids.select(id_col).distinct().withColumn("__hit", F.lit(True)), id_col, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    out = marked.withColumn("status", F.when(F.col("__hit"), status).otherwise(F.col("status")))
    if "updated_at" in table.columns:
        out = out.withColumn("updated_at", F.when(F.col("__hit"), F.current_timestamp() if now is None else now).otherwise(F.col("updated_at")))
    return out.select(*table.columns)


def update(table: DataFrame, changes: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """Partial update: only values of ``changes`` that are not null replace the old ones.

    Of several changes to one id the largest value of each field counts.
    """
    new = changes.groupBy(id_col).agg(*[F.max(f).alias(f"__new_{f}") for f in fields])
    return table.join(new, id_col, "left").select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def delete(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return table.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_anti").select(*table.columns)


def delete_cascade(parents: DataFrame, children: DataFrame, ids: DataFrame, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parents and their children without the given parent ids."""
    return delete(parents, ids), delete(children, ids, foreign)


def truncate(table: DataFrame, children: DataFrame | None = None, foreign: str | None = None, cascade: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Empty table; children stay unless ``cascade`` is asked for, as bulk deletes skip them."""
    emptied = children
    if cascade and children is not None:
        emptied = children.filter(F.col(foreign).isNull())
    return table.limit(0), emptied


def delete_pages(rows: DataFrame, page: int = 100) -> DataFrame:
    """``(page, n)``: what deleting all rows page by page removes, from pages counted from 1; full ones but for the last.

    Only the number of rows is needed, since no order is asked of the pages.
    """
    total = rows.agg(F.count("*").alias("total"))
    pages = total.select("total", F.explode(F.sequence(F.lit(1).cast("long"), F.call_function("div", F.col("total") + page - 1, F.lit(page)))).alias("page")) if page > 0 else None
    if pages is None:
        raise ValueError("a page holds one row at least")
    return pages.filter("page >= 1 and total > 0").select("page", F.least(F.lit(page), F.col("total") - (F.col("page") - 1) * page).cast("long").alias("n"))


def vector_rows(patterns: DataFrame, embed_with: Callable[[Column], Column] = embed, layers: tuple[str, ...] = tuple(LAYERS)) -> DataFrame:
    """A vector object per pattern and layer: text, vector and the stored properties, null properties empty."""
    patterns = patterns.withColumns({f: F.lit(None).cast("string") for lines in LAYERS.values() for _, f in lines if f not in patterns.columns})
    texts = F.create_map(*[x for layer in layers for x in (F.lit(layer), layer_text(layer))])
    exploded = patterns.select("*", F.explode(texts).alias("vector_layer", "text"))
    stored = ["error_type", "severity", "language", "framework", "status"]
    return exploded.select(F.col("id").alias("sqlite_id"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in stored], "vector_layer", "text", embed_with(F.col("text")).alias("vector"))


def sync_vectors(store: DataFrame, patterns: DataFrame, replace: bool = True, status: str | None = None, **options) -> DataFrame:
    """Vector store after syncing patterns: their objects are replaced, or added to where ``replace`` is off."""
    new = vector_rows(where(patterns, status=status), **options)
    kept = store.join(new.select("sqlite_id", "vector_layer").distinct(), ["sqlite_id", "vector_layer"], "left_anti") if replace else store
    return kept.select(*new.columns).unionByName(new)


def session_issues(sessions: DataFrame, issues: DataFrame, how: str = "inner") -> DataFrame:
    return sessions.select(F.col("id").alias("session_id"), F.col("status").alias("session_status")).join(issues, "session_id", how)


def fill_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Projection to the fields of ``defaults``, in their order, with null or missing values filled."""
    return rows.select(*[F.coalesce(F.col(c), F.lit(v)).alias(c) if c in rows.columns else F.lit(v).alias(c) for c, v in defaults.items()])


#: Fields that come first in a table's display, by target.
COLUMN_ORDER = {
    "review_session": ("id", "session_id", "user_message", "code_directory", "code_patch", "git_commit", "status", "created_at", "updated_at"),
    "curated_issue": ("id", "session_id", "pattern_id", "project_path", "file_path", "start_line", "end_line", "code_snippet", "problem_phenomenon", "root_cause", "solution", "severity", "status", "created_at", "updated_at"),
    "issue_pattern": ("id", "title", "error_type", "severity", "language", "framework", "error_description", "problematic_pattern", "solution", "file_pattern", "class_pattern", "tags", "status", "created_at", "updated_at"),
}


def ordered_columns(target: str, columns: list[str]) -> list[str]:
    """Keys, then model order, then unknown columns by name."""
    known = [c for c in COLUMN_ORDER.get(target, ()) if c in columns]
    return known + sorted(c for c in columns if c not in known)


def in_order(rows: DataFrame, target: str) -> DataFrame:
    """``rows`` with its columns in the target's order."""
    return rows.select(*ordered_columns(target, rows.columns))
