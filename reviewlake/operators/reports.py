"""Report rows, exports and rendering."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..functions.text import cell
from ..schema import lookup
from .ranking import per_severity_and_source
from .store import ordered_columns


def consolidated(issues: DataFrame, *keys: str) -> DataFrame:
    """One report row per key: status, issue_count, severity_stats, issues in order.

    Feed it capped issues: the caps bound what a report holds.
    """
    fields = F.struct("ord", *[c for c in issues.columns if c != "ord" and c not in keys])
    stats = issues.groupBy(*keys, F.coalesce("severity", F.lit("low")).alias("s")).agg(F.count("*").alias("n"))
    maps = stats.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("s", "n")))).alias("severity_stats"))
    lists = issues.groupBy(*keys).agg(F.count("*").alias("issue_count"), F.array_sort(F.collect_list(fields)).alias("issues"))
    return lists.join(maps, list(keys)).withColumn("status", F.lit("completed"))


def write_run_reports(reports: DataFrame, path: str) -> None:
    """JSON lines, one folder for each run."""
    reports.write.mode("append").partitionBy("run_id").json(path)


def export_csv(rows: DataFrame, path: str, key: str = "target") -> None:
    """CSV with a folder for each target, columns in sorted order."""
    columns = sorted(c for c in rows.columns if c != key)
    rows.select(key, *columns).write.mode("overwrite").partitionBy(key).option("header", True).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def grouped_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several targets under the union of their columns, absent ones null."""
    out = None
    for target, rows in parts.items():
        marked = rows.withColumn("target", F.lit(target))
        out = marked if out is None else out.unionByName(marked, allowMissingColumns=True)
    return out.select("target", *sorted(c for c in out.columns if c != "target"))


def as_markdown(data: Any, level: int = 1) -> str:
    """Nested values as Markdown: keys as headings, lists as items."""
    if isinstance(data, dict):
        return "\n".join(f"{'#' * min(level, 6)} {k}\n{as_markdown(v, level + 1)}" if isinstance(v, dict | list) else f"- **{k}**: {v}" for k, v in data.items())
    if isinstance(data, list):
        return "\n".join(as_markdown(x, level) if isinstance(x, dict | list) else f"- {x}" for x in data)
    return str(data)


def markdown_of(value: Column, kind: T.DataType, level: int = 1) -> Column:
    """``as_markdown`` of a nested column, as one expression built from its type: structs and arrays of any depth.

    Nulls are written None, as fields and as items; a null struct or array is a null value.
    """

    def plain(c: Column, t: T.DataType) -> Column:
        text = F.when(c, "True").otherwise("False") if isinstance(t, T.BooleanType) else c.cast("string")
        return F.when(c.isNull(), F.lit("None")).otherwise(text)

    nested = lambda t: isinstance(t, T.StructType | T.ArrayType)
    if isinstance(kind, T.StructType):
        lines = []
        for f in kind.fields:
            c = value[f.name]
            flat = F.concat(F.lit(f"- **{f.name}**: "), plain(c, f.dataType) if not nested(f.dataType) else F.lit("None"))
            deep = F.concat(F.lit(f"{'#' * min(level, 6)} {f.name}\n"), markdown_of(c, f.dataType, level + 1)) if nested(f.dataType) else None
            lines.append(flat if deep is None else F.when(c.isNull(), flat).otherwise(deep))
        return F.concat_ws("\n", *lines)
    if isinstance(kind, T.ArrayType):
        item = kind.elementType
        return F.array_join(F.transform(value, lambda x: markdown_of(x, item, level) if nested(item) else F.concat(F.lit("- "), plain(x, item))), "\n")
    return plain(value, kind)


def export_line(key: Column, value: Column, form: str) -> Column:
    """One entry of a summary export: markdown (values over the limit cut) or html (escaped)."""
    if form == "markdown":
        return F.concat(F.lit("- **"), key, F.lit("**: "), F.substring(value, 1, 500))
    if form == "html":
        text = F.substring(value, 1, 1000)
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            text = F.replace(text, F.lit(sign), F.lit(name))
        return F.concat(F.lit("<h2>"), key, F.lit("</h2><pre>"), text, F.lit("</pre>"))
    return F.to_json(F.create_map(key, value))


def table_text(rows: DataFrame, target: str, width: int = 80, limit: int = 1000) -> str:
    """A table as text for display, at most ``limit`` rows, columns in the target's order."""
    columns = ordered_columns(target, rows.columns)
    data = [[r[c] for c in columns] for r in rows.select(*[cell(F.col(c), width).alias(c) for c in columns]).limit(limit).collect()]
    widths = [max(len(c), *(len(r[k]) for r in data)) if data else len(c) for k, c in enumerate(columns)]
    line = lambda row: "| " + " | ".join(v.ljust(w) for v, w in zip(row, widths, strict=True)) + " |"
    return "\n".join([line(columns), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, data)])


def table_lines(rows: DataFrame, target: str, width: int = 80) -> DataFrame:
    """The rows' own columns, ``part`` and ``line``: a table as lines of text, columns in the target's order.

    Part 0 is the head, 1 the rule below it, 2 a row. The widths, one number for each column, are
    read first; each row is then written where it lies. Of an empty table head and rule are left.
    """
    columns = ordered_columns(target, rows.columns)
    cells = [cell(F.col(c), width) for c in columns]
    found = rows.agg(*[F.coalesce(F.max(F.length(c)), F.lit(0)) for c in cells]).first()
    widths = [max(len(c), w) for c, w in zip(columns, found, strict=True)]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.rpad(c, w, " ") for c, w in zip(cells, widths, strict=True)]), F.lit(" |"))
    head = "| " + " | ".join(c.ljust(w) for c, w in zip(columns, widths, strict=True)) + " |"
    rule = "|" + "|".join("-" * (w + 2) for w in widths) + "|"
    top = rows.sparkSession.createDataFrame([(0, head), (1, rule)], "part int, line string")
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns]
    return top.select(*none, "part", "line").unionByName(rows.select(*columns, F.lit(2).alias("part"), row.alias("line")))


def markdown_summary(issues: DataFrame) -> DataFrame:
    """``(severity, source, markdown)``: up to five issues of each pair as list items and how many more there are."""
    item = F.concat(F.lit("- "), F.coalesce("description", F.lit("")), F.when(F.col("line").isNotNull(), F.concat(F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))).otherwise(""))
    rows = per_severity_and_source(issues).withColumn("item", item)
    listed = rows.groupBy("severity", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.array_sort(F.collect_list(F.struct("ord", "item"))).alias("items"), F.max("more").alias("more"))
    head = F.concat(F.lit("### "), lookup(F.col("severity"), rules.SEVERITY_LABEL, F.col("severity")), F.lit(" / "), lookup(F.col("source"), rules.SOURCE_LABEL, F.col("source")))
    body = F.array_join(F.transform("items", lambda x: x["item"]), "\n")
    more = F.when(F.col("more") > 0, F.concat(F.lit("\n- ... "), F.col("more").cast("string"), F.lit(" more"))).otherwise("")
    return listed.select("severity", "source", F.concat(head, F.lit("\n"), body, more).alias("markdown"))


def suggestions(ai: DataFrame, static: DataFrame, risk: DataFrame) -> DataFrame:
    """Per file: up to five suggestions of each kind, one for a high risk, a default where there are none.

    ``ai``: file_id, pos, description, priority; ``static``: file_id, pos, description; ``risk``: file_id, risk_level.
    """
    columns = ["file_id", "part", "pos", "source", "description", "priority"]
    of = lambda df, k, source, description, level: df.select("file_id", F.lit(k).alias("part"), F.col("pos") if "pos" in df.columns else F.lit(0).alias("pos"), F.lit(source).alias("source"), description.alias("description"), level.alias("priority"))
    one = of(ai.filter("pos < 5"), 0, "ai_improvement", F.col("description"), F.coalesce("priority", F.lit("medium")))
    two = of(static.filter("pos < 5"), 1, "static_scan", F.col("description"), F.lit("medium"))
    three = of(risk.filter("risk_level in ('high', 'critical')"), 2, "risk_assessment", F.lit("优先修复高风险及潜在安全漏洞。"), F.lit("high"))
    found = one.unionByName(two).unionByName(three)
    rest = of(risk.join(found.select("file_id").distinct(), "file_id", "left_anti"), 3, "general", F.lit("整体质量良好，无需立即动作。"), F.lit("low"))
    return found.unionByName(rest).select(*columns)


def history(messages: DataFrame, n: int = 5, cut: int = 100) -> DataFrame:
    """Last ``n`` messages of each conversation (conv_id, turn, role, text) as labelled lines."""
    from .ranking import first_per

    last = first_per(messages, ["conv_id"], [F.desc("turn")], n)
    line = F.concat(F.when(F.col("role") == "user", "用户").otherwise("AI"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, cut))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


def paths_in(text: Column) -> Column:
    """Unix and Windows paths that a text names, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"((?:[A-Za-z]:[\\/]|/)[^\s\"'<>|，。]+)"), F.lit(1)))


#: Fields that a report must have.
REPORT_FIELDS = ("run_id", "requirement_id", "issues", "analysis_types")


def report_errors(body: Column) -> Column:
    """What keeps a JSON text from being a report, joined by semicolons; empty for a valid one."""
    v = F.try_parse_json(body)
    shape = lambda x: F.coalesce(F.schema_of_variant(x), F.lit(""))
    get = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    missing = [F.when(get(k).isNull(), F.lit(f"missing {k}")) for k in REPORT_FIELDS]
    no_list = F.when(get("issues").isNotNull() & ~F.startswith(shape(get("issues")), F.lit("ARRAY")), F.lit("issues no list"))
    return F.when(~F.startswith(shape(v), F.lit("OBJECT")), "no JSON object").otherwise(F.array_join(F.array_compact(F.array(*missing, no_list)), "; "))


def conversation_report(messages: DataFrame) -> DataFrame:
    """Message counts of each conversation."""
    return messages.groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("total_messages"), F.count_if(F.col("role") == "user").alias("user_requests"), F.count_if(F.col("role") == "assistant").alias("ai_responses"))
