"""Outputs of external analysers as issue rows; the tools themselves are not run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..schema import lookup


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def semgrep(outputs: DataFrame) -> DataFrame:
    """``(file_id, output)`` JSON with results; broken JSON gives no rows."""
    schema = "results array<struct<check_id:string,start:struct<line:long,col:long>,extra:struct<message:string,severity:string,metadata:struct<cwe:string>>>>"
    rows = outputs.select("file_id", F.posexplode(F.from_json("output", schema).results).alias("pos", "r"))
    return rows.select(
        "file_id", "pos", F.lit("semgrep").alias("tool"), _or(F.col("r.extra.message"), "").alias("message"), _or(F.col("r.start.line"), 0).alias("line"), _or(F.col("r.start.col"), 0).alias("column"),
        lookup(F.upper(_or(F.col("r.extra.severity"), "INFO")), rules.SEMGREP_SEVERITY, "low").alias("severity"), _or(F.col("r.check_id"), "").alias("rule_id"), _or(F.col("r.extra.metadata.cwe"), "").alias("cwe"),
    )


def cppcheck(outputs: DataFrame) -> DataFrame:
    """XML with error elements; the first location counts."""
    well = F.when(F.col("output").rlike(r"^\s*<"), F.col("output"))
    schema = "errors struct<error: array<struct<_id:string,_severity:string,_msg:string,location:array<struct<_file:string,_line:string>>>>>"
    rows = outputs.select("file_id", F.posexplode(F.from_xml(well, schema).errors.error).alias("pos", "e"))
    place = F.get(F.col("e.location"), F.lit(0))
    return rows.select(
        "file_id", "pos", F.lit("cppcheck").alias("tool"), _or(F.col("e._msg"), "").alias("message"), _or(place["_line"].try_cast("long"), 0).alias("line"), _or(place["_file"], "").alias("file"),
        lookup(F.lower(_or(F.col("e._severity"), "style")), rules.CPPCHECK_SEVERITY, "low").alias("severity"), _or(F.col("e._id"), "").alias("rule_id"),
    )


def spotbugs(outputs: DataFrame) -> DataFrame:
    well = F.when(F.col("output").rlike(r"^\s*<"), F.col("output"))
    schema = "BugInstance array<struct<_type:string,_priority:string,ShortMessage:string,LongMessage:string,SourceLine:array<struct<_start:string,_sourcepath:string>>>>"
    rows = outputs.select("file_id", F.posexplode(F.from_xml(well, schema).BugInstance).alias("pos", "b"))
    place = F.get(F.col("b.SourceLine"), F.lit(0))
    return rows.select(
        "file_id", "pos", F.lit("spotbugs").alias("tool"), F.coalesce(F.nullif("b.LongMessage", F.lit("")), "b.ShortMessage", F.lit("")).alias("message"), _or(place["_start"].try_cast("long"), 0).alias("line"), _or(place["_sourcepath"], "").alias("file"),
        lookup(_or(F.col("b._priority"), "3"), rules.SPOTBUGS_PRIORITY, "low").alias("severity"), _or(F.col("b._type"), "").alias("rule_id"),
    )


_TIDY = r"^(.*?):(\d+):(\d+):\s+(warning|error|note):\s+(.*?)\s*(\[.*\])?$"


def _text_lines(outputs: DataFrame) -> DataFrame:
    return outputs.select("file_id", F.posexplode(F.split(F.trim("output"), r"\r?\n")).alias("pos", "raw")).select("file_id", "pos", F.trim("raw").alias("text"))


def clang_tidy(outputs: DataFrame) -> DataFrame:
    rows = _text_lines(outputs).filter(F.col("text").rlike(_TIDY))
    part = lambda k: F.regexp_extract("text", _TIDY, k)
    return rows.select(
        "file_id", "pos", F.lit("clang-tidy").alias("tool"), part(5).alias("message"), part(2).cast("long").alias("line"), part(3).cast("long").alias("column"), part(1).alias("file"),
        F.when(part(4) == "note", "style").otherwise("security").alias("type"), F.when(part(4) == "error", "high").otherwise("medium").alias("severity"), F.regexp_replace(part(6), r"^[\[\]]+|[\[\]]+$", "").alias("rule_id"),
    )


def pylint(outputs: DataFrame) -> DataFrame:
    schema = "array<struct<type:string,message:string,line:long,column:long,symbol:string,`message-id`:string>>"
    rows = outputs.select("file_id", F.posexplode(F.from_json("output", schema)).alias("pos", "r"))
    return rows.select(
        "file_id", "pos", F.lit("pylint").alias("tool"), _or(F.col("r.message"), "").alias("message"), _or(F.col("r.line"), 0).alias("line"), _or(F.col("r.column"), 0).alias("column"),
        _or(F.col("r.type"), "unknown").alias("type"), lookup(_or(F.col("r.type"), ""), rules.PYLINT_SEVERITY, "low").alias("severity"), _or(F.col("r.symbol"), "").alias("symbol"), _or(F.col("r")["message-id"], "").alias("message_id"),
    )


def _number(parts: Column, k: int) -> Column:
    piece = F.get(parts, F.lit(k))
    return F.when(piece.rlike(r"^\d+$"), piece.try_cast("long")).otherwise(F.lit(0))


def _rest(parts: Column, k: int) -> Column:
    return F.trim(F.array_join(F.slice(parts, k + 1, F.greatest(F.size(parts) - k, F.lit(0))), ":"))


def flake8(outputs: DataFrame) -> DataFrame:
    rows = _text_lines(outputs).withColumn("p", F.split("text", ":")).filter(F.size("p") >= 4)
    code = F.regexp_extract(F.trim(F.get("p", F.lit(3))), r"^(\S*)", 1)
    return rows.select("file_id", "pos", F.lit("flake8").alias("tool"), _rest(F.col("p"), 3).alias("message"), _number(F.col("p"), 1).alias("line"), _number(F.col("p"), 2).alias("column"), F.lit("low").alias("severity"), code.alias("code"))


def mypy(outputs: DataFrame) -> DataFrame:
    rows = _text_lines(outputs).withColumn("p", F.split("text", ":")).filter(F.size("p") >= 3)
    return rows.select("file_id", "pos", F.lit("mypy").alias("tool"), _rest(F.col("p"), 2).alias("message"), _number(F.col("p"), 1).alias("line"), F.lit("medium").alias("severity"))


def bandit(outputs: DataFrame) -> DataFrame:
    schema = "results array<struct<issue_text:string,line_number:long,issue_severity:string,issue_confidence:string,test_id:string,test_name:string>>"
    rows = outputs.select("file_id", F.posexplode(F.from_json("output", schema).results).alias("pos", "r"))
    return rows.select(
        "file_id", "pos", F.lit("bandit").alias("tool"), _or(F.col("r.issue_text"), "").alias("message"), _or(F.col("r.line_number"), 0).alias("line"), F.lower(_or(F.col("r.issue_severity"), "low")).alias("severity"),
        F.lower(_or(F.col("r.issue_confidence"), "low")).alias("confidence"), _or(F.col("r.test_id"), "").alias("test_id"), _or(F.col("r.test_name"), "").alias("test_name"),
    )


def radon(outputs: DataFrame) -> DataFrame:
    """Complexity blocks of each path: file_id, path, name, complexity."""
    blocks = F.from_json("output", "map<string,array<struct<name:string,type:string,lineno:long,complexity:long>>>")
    rows = outputs.select("file_id", F.explode(blocks).alias("path", "blocks")).select("file_id", "path", F.posexplode("blocks").alias("pos", "b"))
    return rows.select("file_id", "path", "pos", "b.name", "b.type", "b.lineno", "b.complexity")


# Which tools look at which language.
TOOLS = {
    "python": ("semgrep", "bandit", "pylint", "flake8", "mypy", "radon", "pep8_checker"),
    "c": ("semgrep", "cppcheck", "clang-tidy"),
    "cpp": ("semgrep", "cppcheck", "clang-tidy"),
    "java": ("semgrep", "spotbugs"),
    "javascript": ("semgrep",),
}


def dispatch(files: DataFrame, available: list[str] | None = None) -> DataFrame:
    """``(file_id, language, tool)``: the available tools for each file's language."""
    kept = {k: [t for t in v if available is None or t in available] for k, v in TOOLS.items()}
    table = F.create_map(*[x for k, v in kept.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    return files.select("file_id", "language", F.explode(F.coalesce(F.try_element_at(table, F.col("language")), F.array(F.lit("semgrep")))).alias("tool"))


PARSERS = {"semgrep": semgrep, "cppcheck": cppcheck, "spotbugs": spotbugs, "clang-tidy": clang_tidy, "pylint": pylint, "flake8": flake8, "mypy": mypy, "bandit": bandit}


def all_issues(outputs: DataFrame) -> DataFrame:
    """Issues of every parser from ``(file_id, tool, output)``, with the columns they share."""
    parts = [parse(outputs.filter(F.col("tool") == tool)).select("file_id", "tool", "pos", "message", "line", "severity") for tool, parse in PARSERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
