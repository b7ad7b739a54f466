"""Table scans and the views that give driver tables the shape of the issue model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import score_severity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues from events; the score, and so the severity, comes from the event's properties."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.col("user_id").alias("requirement_id"),
        F.concat(F.lit("src/f"), (F.col("user_id") % 50).cast("string"), F.lit(".py")).alias("file"),
        F.col("event_type").alias("source"),
        score_severity(k / 10.0).alias("severity"),
        k.alias("line"),
        F.concat_ws(" ", "event_type", k.cast("string")).alias("description"),
        F.concat(F.lit("tool"), (k % 4).cast("string")).alias("tool"),
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        (k / 10.0).alias("score"),
    )


ISSUES_SQL = """issues AS (
  SELECT event_id AS ord, user_id AS requirement_id, 'src/f' || (user_id % 50) || '.py' AS file, event_type AS source,
    CASE WHEN k / 10.0 >= 9 THEN 'critical' WHEN k / 10.0 >= 7 THEN 'high' WHEN k / 10.0 >= 4 THEN 'medium' ELSE 'low' END AS severity,
    k AS line, event_type || ' ' || k AS description, 'tool' || (k % 4) AS tool, strftime(ts, '%Y-%m-%d') AS run_id, k / 10.0 AS score
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("user_message"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"),
    )


SESSIONS_SQL = "sessions AS (SELECT o_orderkey AS id, o_custkey AS session_id, o_orderstatus AS status, o_orderpriority AS user_message, o_orderdate AS created_at, o_totalprice AS price FROM orders)"


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("pattern_id"),
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file_path"), F.col("l_linenumber").alias("start_line"),
        F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("created_at"), F.col("l_returnflag").alias("severity"),
    )


CURATED_SQL = "curated AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS session_id, l_partkey AS pattern_id, 'f' || l_suppkey AS file_path, l_linenumber AS start_line, l_linestatus AS status, l_shipdate AS created_at, l_returnflag AS severity FROM lineitem)"


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("error_type"), F.col("p_brand").alias("framework"),
        F.when(size % 3 == 0, "deprecated").otherwise("active").alias("status"),
        F.when(size % 4 == 0, "critical").when(size % 4 == 1, "high").when(size % 4 == 2, "medium").otherwise("low").alias("severity"),
        F.lit("python").alias("language"), F.concat_ws(" ", "p_type", "p_brand").alias("error_description"), F.lit("fix").alias("solution"),
    )


PATTERNS_SQL = "patterns AS (SELECT p_partkey AS id, p_name AS title, p_type AS error_type, p_brand AS framework, CASE WHEN p_size % 3 = 0 THEN 'deprecated' ELSE 'active' END AS status, CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, 'python' AS language, p_type || ' ' || p_brand AS error_description, 'fix' AS solution FROM part)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code files: each document's first words set into a template chosen by its id."""
    pieces = [F.lit(p) for part in zip(CODE_TEMPLATE_HEADS, strict=True) for p in part]
    head = F.element_at(F.array(*pieces), (F.col("doc_id") % len(CODE_TEMPLATE_HEADS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("dir"), (F.col("doc_id") % 7).cast("string"), F.lit("/sub/f"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, CODE_SUFFIXES)), (F.col("doc_id") % len(CODE_SUFFIXES) + 1).cast("int"))).alias("path"),
        F.concat(head, F.col("text")).alias("content"),
    )


CODE_SUFFIXES = (".py", ".js", ".cpp", ".java", ".txt")
CODE_TEMPLATE_HEADS = (
    "import os\nMAX_SIZE = 10\n\ndef load(path):\n    for a in path:\n        for b in a:\n            if b:\n                open(b)\n    return load(path)\n\nclass Box(object):\n    pass\n",
    "const x = require('fs')\nfunction main() {\n  // note\n  while (true) { fetch('http://a') }\n}\nclass Thing {\n}\n",
    "#include <vector>\nint main() {\n  std::vector<int> v;\n  int *p = new int;\n  for (int i = 0; i < 3; i++) {\n    v.push_back(i);\n  }\n  delete p;\n}\n",
    "public class A {\n  public void run() {\n    String password = null;\n    execute(select);\n  }\n}\n",
    "",
)


def files_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    heads = ", ".join(map(quote, CODE_TEMPLATE_HEADS))
    suffixes = ", ".join(map(quote, CODE_SUFFIXES))
    return f"files AS (SELECT doc_id AS file_id, 'dir' || (doc_id % 7) || '/sub/f' || doc_id || [{suffixes}][doc_id % {len(CODE_SUFFIXES)} + 1] AS path, [{heads}][doc_id % {len(CODE_TEMPLATE_HEADS)} + 1] || text AS content FROM documents)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sqlite_id"), F.col("embedding").cast("array<double>").alias("vector"), F.concat(F.lit("layer"), F.col("label").cast("string")).alias("vector_layer"))


def lookup_types(source):
    """Analysis type that an event type stands for."""
    return (
        F.when(source.isin("click", "view"), "static_analysis").when(source == "error", "security_analysis").when(source == "purchase", "performance_analysis").otherwise("ai_analysis")
    )
