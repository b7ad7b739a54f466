"""Vulnerability metadata and structured files as tasks and records."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import normalize_text, split_summary
from ..schema import INGEST

CVE = "cve_id STRING, summary STRING, cwe_id STRING, vulnerability_classification STRING, score STRING, lang STRING, project STRING"
COMMIT = "files ARRAY<STRUCT<local_name: STRING, original_path: STRING>>"


def _parent(path: Column, up: int) -> Column:
    return F.element_at(F.split(path, "/"), -1 - up)


def cve_metadata(spark: SparkSession, root: str, start: int = 0, count: int | None = None) -> DataFrame:
    """One row per ``CVE-*`` folder by name, from ``start`` on, with its metadata."""
    rows = spark.read.schema(CVE).option("multiLine", True).json(f"{root}/CVE-*/cve_metadata.json").withColumn("folder", _parent(F.input_file_name(), 1))
    rows = rows.orderBy("folder").offset(start)
    return rows if count is None else rows.limit(count)


def commit_files(spark: SparkSession, root: str) -> DataFrame:
    """``(folder, commit, pos, local_name, original_path)`` of every commit's files."""
    rows = spark.read.schema(COMMIT).option("multiLine", True).json(f"{root}/CVE-*/*/commit_metadata.json")
    path = F.input_file_name()
    return rows.select(_parent(path, 2).alias("folder"), _parent(path, 1).alias("commit"), F.posexplode("files").alias("pos", "f")).select("folder", "commit", "pos", "f.local_name", "f.original_path")


def source_texts(spark: SparkSession, root: str) -> DataFrame:
    """``(folder, commit, local_name, text)`` of the code files below ``root``; undecodable bytes are dropped."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return rows.select(_parent(F.col("path"), 2).alias("folder"), _parent(F.col("path"), 1).alias("commit"), _parent(F.col("path"), 0).alias("local_name"), text.alias("text"))


def changed_range(before: Column, after: Column) -> Column:
    """``struct(first, last)``: lines of the first change, counted from 1; 0 and 0 without one."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            codes = difflib.SequenceMatcher(a=(x or "").splitlines(), b=(y or "").splitlines()).get_opcodes()
            change = next((c for c in codes if c[0] != "equal"), None)
            out.append((0, 0) if change is None else (change[1] + 1, max(change[1] + 1, change[2])))
        return pd.DataFrame(out, columns=["first", "last"])

    return F.pandas_udf(run, "struct<first:int,last:int>")(before, after)


def pattern_tasks(cves: DataFrame) -> DataFrame:
    """Pattern fields derived from CVE metadata."""
    summary, cwe, kind = normalize_text(F.col("summary")), normalize_text(F.col("cwe_id")), normalize_text(F.col("vulnerability_classification"))
    error = rules.error_type(F.col("cwe_id"), F.col("vulnerability_classification"), F.col("summary"))
    return cves.withColumn("__error", error).select(
        normalize_text(F.col("cve_id")).alias("title"),
        F.col("__error").alias("error_type"),
        rules.score_severity(F.col("score")).alias("severity"),
        normalize_text(F.col("lang")).alias("language"),
        normalize_text(F.col("project")).alias("framework"),
        summary.alias("error_description"),
        rules.problematic_pattern(F.col("__error"), F.col("summary")).alias("problematic_pattern"),
        rules.solution(F.col("__error")).alias("solution"),
        F.when(kind != "", kind).otherwise(cwe).alias("tags"),
        F.lit("active").alias("status"),
    )


def issue_tasks(cves: DataFrame, files: DataFrame, before: DataFrame, after: DataFrame, before_root: str, max_snippet: int) -> DataFrame:
    """Issue fields of every changed file, and one placeholder for a CVE without files.

    Missing texts count as empty.
    """
    keys = ["folder", "commit", "local_name"]
    joined = files.join(before.withColumnRenamed("text", "before"), keys, "left").join(after.withColumnRenamed("text", "after"), keys, "left")
    sided = joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("before", "after")}).withColumn("range", changed_range(F.col("before"), F.col("after")))
    parts = split_summary(F.col("summary"))
    error = rules.error_type(F.col("cwe_id"), F.col("vulnerability_classification"), F.col("summary"))
    rows = cves.withColumn("parts", parts).join(sided, "folder", "left")
    return rows.select(
        "folder",
        F.coalesce("commit", F.lit("")).alias("commit"),
        F.coalesce("pos", F.lit(0)).alias("pos"),
        F.concat(F.lit(f"{before_root}/"), F.coalesce("cve_id", F.lit(""))).alias("project_path"),
        normalize_text(F.col("original_path")).alias("file_path"),
        F.coalesce("range.first", F.lit(0)).alias("start_line"),
        F.coalesce("range.last", F.lit(0)).alias("end_line"),
        F.substring(F.coalesce("before", F.lit("")), 1, max_snippet).alias("code_snippet"),
        F.col("parts.phenomenon").alias("problem_phenomenon"),
        F.col("parts.root_cause").alias("root_cause"),
        rules.solution(error).alias("solution"),
        rules.score_severity(F.col("score")).alias("severity"),
        F.lit("open").alias("status"),
    )


TARGETS = ("review_session", "issue_pattern", "curated_issue")
ACTIONS = ("upsert", "create", "update", "query", "delete", "delete_all", "sync")
REQUIRED = ("error_type", "error_description", "problematic_pattern", "solution")
WEAK = ("problem_phenomenon", "root_cause", "solution")


def validate(tasks: DataFrame) -> DataFrame:
    """``(ord, level, message)``: errors and warnings of tasks (ord, target, action, data map), in order."""
    at = F.concat(F.lit("task["), F.col("ord").cast("string"), F.lit("] "))
    text = lambda *parts: F.concat(at, *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    name = lambda c: F.coalesce(F.col(c), F.lit("None"))
    blank = lambda key: normalize_text(F.try_element_at("data", F.lit(key))) == ""
    has_data = F.col("data").isNotNull()
    checks = [
        ("error", ~F.coalesce(F.col("target").isin(*TARGETS), F.lit(False)), text("invalid target: ", name("target"))),
        ("error", ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), text("invalid action: ", name("action"))),
        ("error", ~has_data, text("data must be dict")),
        *(("error", has_data & (F.col("target") == "issue_pattern") & blank(k), text(f"issue_pattern missing {k}")) for k in REQUIRED),
        *(("warning", has_data & (F.col("target") == "curated_issue") & blank(k), text(f"curated_issue weak field {k}")) for k in WEAK),
    ]
    rows = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(level).alias("level"), message.alias("message"))) for level, test, message in checks]))
    return tasks.select("ord", F.inline(rows))


def summary(tasks: DataFrame) -> DataFrame:
    """``(kind, name, n)``: tasks by target, and by severity where one is given."""
    by_target = tasks.groupBy(F.lit("target").alias("kind"), F.coalesce("target", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"))
    severity = normalize_text(F.try_element_at("data", F.lit("severity")))
    by_severity = tasks.select(severity.alias("name")).filter("name != ''").groupBy(F.lit("severity").alias("kind"), "name").agg(F.count("*").alias("n"))
    return by_target.unionByName(by_severity)


def structured(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a structured ingest file: entry, pattern, instance number and instance (null without any)."""
    rows = spark.read.schema(INGEST).option("multiLine", True).json(path).select(F.posexplode("data").alias("entry", "e"))
    return rows.select("entry", "e.pattern", F.posexplode_outer("e.instances").alias("instance", "i"))


def cwe_records(rows: DataFrame) -> DataFrame:
    """Pattern fields of dataset rows (idx, vulnerability, func_before, func_after)."""
    from .lines import snippet_language

    kind = F.coalesce("vulnerability", F.lit(""))
    cut = lambda c: F.concat(F.substring(F.coalesce(c, F.lit("")), 1, 200), F.lit("..."))
    return rows.select(
        F.concat(F.lit("BigVul漏洞模式-"), F.col("idx").cast("string")).alias("title"),
        rules.cwe_type(kind).alias("error_type"),
        rules.cwe_severity(kind).alias("severity"),
        snippet_language(F.coalesce("func_before", F.lit(""))).alias("language"),
        F.concat(F.lit("BigVul数据集中的"), F.coalesce("vulnerability", F.lit("未知漏洞")), F.lit("类型漏洞。问题代码: "), cut(F.col("func_before"))).alias("error_description"),
        F.concat(F.lit("修复建议: 检查代码中的安全漏洞，使用安全的编程实践。修复后代码: "), cut(F.col("func_after"))).alias("solution"),
        F.concat(F.lit("BigVul,"), kind).alias("tags"),
        F.lit("active").alias("status"),
    )


def name_slice(rows: DataFrame, name: str, prefix: str, start: int, count: int) -> DataFrame:
    """Rows whose name has the prefix, by name, from ``start`` on."""
    return rows.filter(F.startswith(F.col(name), F.lit(prefix))).orderBy(name).offset(start).limit(count)


def both_sides(keys: DataFrame, before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """Texts before and after a change by key; a missing side is empty."""
    joined = keys.join(before.withColumnRenamed("text", "before"), on, "left").join(after.withColumnRenamed("text", "after"), on, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("before", "after")})
