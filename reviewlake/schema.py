"""Types and fixed orders of the issue model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITIES = ("critical", "high", "medium", "low", "info")

ISSUE = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("requirement_id", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("description", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("run_id", T.StringType()),
    ]
)

# The schemas below are DDL text: parsing it needs a session, which workers do not have.
REVIEW_SESSION = ("id BIGINT, session_id STRING, user_message STRING, code_directory STRING, code_patch STRING, git_commit STRING, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP")
CURATED_ISSUE = ("id BIGINT, session_id BIGINT, pattern_id BIGINT, project_path STRING, file_path STRING, start_line INT, end_line INT, code_snippet STRING, problem_phenomenon STRING, root_cause STRING, solution STRING, severity STRING, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP")
ISSUE_PATTERN = ("id BIGINT, title STRING, error_type STRING, severity STRING, language STRING, framework STRING, error_description STRING, problematic_pattern STRING, solution STRING, file_pattern STRING, class_pattern STRING, tags STRING, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP")
TASK = ("target STRING, action STRING, data MAP<STRING,STRING>")
MESSAGE = ("id STRING, sender STRING, receiver STRING, content STRING, timestamp DOUBLE, message_type STRING")
INGEST = ("version STRING, ingest_mode STRING, data ARRAY<STRUCT<"
    "pattern: STRUCT<title: STRING, error_type: STRING, severity: STRING, language: STRING, framework: STRING, error_description: STRING, problematic_pattern: STRING, solution: STRING, tags: STRING, status: STRING>, "
    "instances: ARRAY<STRUCT<session_meta: STRUCT<session_id: STRING, user_message: STRING, code_directory: STRING>, "
    "issue: STRUCT<project_path: STRING, file_path: STRING, start_line: INT, end_line: INT, code_snippet: STRING, problem_phenomenon: STRING, root_cause: STRING, solution: STRING, severity: STRING, status: STRING>>>>>")


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info, 5 for anything else; null counts as low."""
    rank = F.lit(len(SEVERITIES))
    for k in reversed(range(len(SEVERITIES))):
        rank = F.when(F.coalesce(severity, F.lit("low")) == SEVERITIES[k], k).otherwise(rank)
    return rank


def lookup(key: Column, table: dict[str, str], default: str | Column | None = None) -> Column:
    """Value of a small fixed table, as one expression."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return found if default is None else F.coalesce(found, F.lit(default) if isinstance(default, str) else default)
