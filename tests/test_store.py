"""Fact store lifecycle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from reviewlake import schema
from reviewlake.operators import store

T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 2, 1)


def sessions(spark):
    empty = spark.createDataFrame([], schema.REVIEW_SESSION)
    new = spark.createDataFrame([(1, "cli-session-1", "check", "/tmp/project"), (2, "cli-session-2", "more", "/tmp/b")], "ord long, session_id string, user_message string, code_directory string")
    return store.insert(empty, new, "review_session", now=F.lit(T0).cast("timestamp"))


def issues(spark):
    empty = spark.createDataFrame([], schema.CURATED_ISSUE)
    new = spark.createDataFrame([(1, 1, 1, "app/payment.py", 10, 20, "high"), (2, 2, None, "b.py", 1, 2, None)], "ord long, session_id long, pattern_id long, file_path string, start_line int, end_line int, severity string")
    return store.insert(empty, new, "curated_issue", now=F.lit(T0).cast("timestamp"))


def test_session_lifecycle(spark):
    rows = sessions(spark)
    assert [(r.id, r.session_id, r.status) for r in rows.orderBy("id").collect()] == [(1, "cli-session-1", "open"), (2, "cli-session-2", "open")]
    done = store.set_status(rows, [1], "completed", now=F.lit(NOW).cast("timestamp"))
    first = done.filter("id = 1").first()
    assert first.status == "completed" and first.updated_at > first.created_at
    cancelled = store.set_status(done, [1], "cancelled")
    assert [r.id for r in store.newest(cancelled, status="open").collect()] == [2]
    parents, children = store.delete_cascade(cancelled, issues(spark), spark.createDataFrame([(1,)], "id long"), "session_id")
    assert parents.count() == 1 and [r.session_id for r in children.collect()] == [2]
    assert store.set_status(rows, [99], "x").filter("status = 'x'").count() == 0


def test_issue_lifecycle(spark):
    rows = issues(spark)
    assert {(r.id, r.severity, r.status) for r in rows.collect()} == {(1, "high", "open"), (2, "medium", "open")}
    resolved = store.set_status(rows, [1], "resolved", now=F.lit(NOW).cast("timestamp"))
    assert store.where(resolved, status="resolved", file_path="app/payment.py").count() == 1
    assert store.delete(resolved, spark.createDataFrame([(1,)], "id long")).count() == 1


def test_pattern_lifecycle(spark):
    empty = spark.createDataFrame([], schema.ISSUE_PATTERN)
    new = spark.createDataFrame([(1, "SQLInjection", "desc", "pat", "fix", "critical", "python", "django", "*views.py", "*View")], "ord long, error_type string, error_description string, problematic_pattern string, solution string, severity string, language string, framework string, file_pattern string, class_pattern string")
    rows = store.insert(empty, new, "issue_pattern", now=F.lit(T0).cast("timestamp"))
    changed = store.update(rows, spark.createDataFrame([(1, "high", None, "deprecated")], "id long, severity string, title string, status string"), ["severity", "title", "status"]).first()
    assert (changed.severity, changed.status, changed.error_type, changed.language) == ("high", "deprecated", "SQLInjection", "python")
    parents, children = store.delete_cascade(rows, issues(spark), rows.select("id"), "pattern_id")
    assert parents.count() == 0 and [r.id for r in children.collect()] == [2]


def test_vectors_have_a_row_per_layer(spark):
    pattern = spark.createDataFrame([(7, "SQLInjection", "critical", "active", None)], "id long, error_type string, severity string, status string, language string")
    rows = {r.vector_layer: r for r in store.vector_rows(pattern).collect()}
    assert set(rows) == {"semantic", "code_pattern", "solution", "full"}
    assert rows["semantic"].text == "[error_type] SQLInjection\n[severity] critical\n[language] \n[framework] \n[description] "
    assert rows["semantic"].vector[0] == len(rows["semantic"].text)
    again = store.sync_vectors(store.vector_rows(pattern), pattern)
    assert again.count() == 4 and store.sync_vectors(store.vector_rows(pattern), pattern, replace=False).count() == 8


def test_truncate_does_not_cascade(spark):
    emptied, kept = store.truncate(sessions(spark), issues(spark), "session_id")
    assert emptied.count() == 0 and kept.count() == 2
    assert store.truncate(sessions(spark), issues(spark), "session_id", cascade=True)[1].count() == 0


def test_missing_parents(spark):
    patterns = spark.createDataFrame([(5,)], "id long")
    found = store.missing_parents(issues(spark), sessions(spark).filter("id = 2"), patterns).collect()
    assert sorted((r.id, r.missing) for r in found) == [(1, "pattern"), (1, "session")]
