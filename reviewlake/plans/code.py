"""Queries of the code analytics over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, lines, toolparse
from ..sources import tables
from .registry import SQL, query

W = f"WITH {tables.files_sql()} "
#: White space that DuckDB's trim must name to match the lines' own.
TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
LINES = f"{tables.files_sql()}, raw AS (SELECT file_id, content, string_split(content, chr(10)) AS ls FROM files), l AS (SELECT file_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS text FROM raw), lines AS (SELECT *, {TRIM} AS s, length(text) - length(regexp_replace(text, '^\\s+', '')) AS indent FROM l)"
WL = f"WITH {LINES} "


@query("c01_line_stats", WL + "SELECT file_id, count(*) AS total_lines, count_if(s = '') AS blank_lines, count_if(s LIKE '#%' OR s LIKE '//%') AS comment_lines, count_if(s <> '' AND s NOT LIKE '#%' AND s NOT LIKE '//%') AS code_lines FROM lines GROUP BY file_id")
def c01(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_stats(tables.files(spark, sf))


_has = lambda col, *words: "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query("c02_scan_language", W + f"SELECT file_id, CASE WHEN contains(content, 'def ') AND contains(content, 'import ') THEN 'python' WHEN {_has('content', 'function ', 'const ')} THEN 'javascript' WHEN contains(content, 'class ') AND contains(content, 'public ') THEN 'java' WHEN contains(content, '#include') THEN CASE WHEN contains(content, 'std::') THEN 'cpp' ELSE 'c' END WHEN regexp_matches(content, '\\b(int|char|void|size_t|struct)\\s+\\w+\\s*\\(') THEN 'cpp' ELSE 'unknown' END AS language FROM files")
def c02(spark: SparkSession, sf: str) -> DataFrame:
    return tables.files(spark, sf).select("file_id", lines.scan_language(F.col("content")).alias("language"))


# Fixed values of the rules, written out for the SQL alone, so that a wrong word in the operators shows.
_PERFORMANCE = {
    "python": ("def ", "import ", "class ", "self.", "__init__", "lambda:", "yield "),
    "cpp": ("#include", "namespace", "std::", "cout", "cin", "template<", "using namespace"),
    "c": ("#include", "printf", "scanf", "malloc", "free", "struct ", "typedef"),
}
_QUALITY = {
    "python": ("def ", "import ", "class ", "self.", "__init__"),
    "cpp": ("#include", "namespace", "std::", "cout", "cin"),
    "c": ("#include", "printf", "scanf", "malloc", "free"),
}
_IO = {
    "file_io": ("open(", "read(", "write(", "close()"),
    "database_io": ("execute(", "query(", "select", "insert", "update"),
    "network_io": ("requests.", "urllib.", "socket.", "httpx."),
}
_CONTEXT = {
    "web_application": ("flask", "django", "fastapi"),
    "authentication_present": ("password", "auth", "jwt", "oauth"),
    "database_usage": ("sql", "database", "sqlite", "mysql", "postgres"),
    "network_operations": ("requests", "http", "socket", "urllib", "aiohttp"),
    "encryption_usage": ("encrypt", "hash", "bcrypt", "sha", "cipher"),
}


def _marks_sql(marks: dict[str, tuple[str, ...]]) -> str:
    one = lambda k, words: " + ".join(f"contains({'content' if k == 'python' else 'lower(content)'}, '{w}')::INT" for w in words)
    return ", ".join(f"{one(k, words)} AS {k}_n" for k, words in marks.items())


_BEST = "CASE WHEN greatest(python_n, cpp_n, c_n) = 0 THEN 'unknown' WHEN python_n = greatest(python_n, cpp_n, c_n) THEN 'python' WHEN cpp_n = greatest(python_n, cpp_n, c_n) THEN 'cpp' ELSE 'c' END"


@query("c03_performance_language", W + f"SELECT file_id, {_BEST} AS language FROM (SELECT file_id, {_marks_sql(_PERFORMANCE)} FROM files)")
def c03(spark: SparkSession, sf: str) -> DataFrame:
    return tables.files(spark, sf).select("file_id", lines.performance_language(F.col("content")).alias("language"))


@query("c04_quality_language", W + f"SELECT file_id, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.cpp' THEN 'cpp' ELSE {_BEST} END AS language FROM (SELECT file_id, path, {_marks_sql(_QUALITY)} FROM files)")
def c04(spark: SparkSession, sf: str) -> DataFrame:
    return tables.files(spark, sf).select("file_id", lines.quality_language(F.col("content"), F.regexp_extract("path", r"(\.[^.]*)$", 1)).alias("language"))


_BRANCH = _has("x", *lines.BRANCHES)


@query(
    "c05_c10_python_structure",
    WL
    + f"""SELECT l.file_id, kind, name, l.line_no, CASE WHEN kind = 'function' THEN 1 + (SELECT count_if({_BRANCH}) FROM (SELECT n.text AS x, max((n.s <> '' AND n.indent <= l.indent)::INT) OVER (ORDER BY n.line_no) AS ended FROM lines n WHERE n.file_id = l.file_id AND n.line_no > l.line_no AND n.line_no <= l.line_no + 49) WHERE ended = 0) END AS complexity FROM (
    SELECT *, CASE WHEN s LIKE 'def %' THEN 'function' WHEN s LIKE 'class %' THEN 'class' WHEN s LIKE 'import %' OR s LIKE 'from %' THEN 'import' WHEN contains(s, '=') AND regexp_matches(trim(split_part(s, '=', 1)), '\\pL') AND upper(trim(split_part(s, '=', 1))) = trim(split_part(s, '=', 1)) AND lower(trim(split_part(s, '=', 1))) <> trim(split_part(s, '=', 1)) THEN 'constant' END AS kind,
    CASE WHEN s LIKE 'def %' THEN regexp_extract(split_part(substr(s, 5), 'def ', 1), '^([^(]*)', 1) WHEN s LIKE 'class %' THEN regexp_extract(split_part(substr(s, 7), 'class ', 1), '^([^(:]*)', 1) WHEN s LIKE 'import %' OR s LIKE 'from %' THEN s ELSE trim(split_part(s, '=', 1)) END AS name FROM lines) l WHERE kind IS NOT NULL""",
)
def c05(spark: SparkSession, sf: str) -> DataFrame:
    return lines.python_structure(tables.files(spark, sf))


@query("c06_js_structure", WL + "SELECT * FROM (SELECT file_id, CASE WHEN contains(s, 'function ') THEN CASE WHEN regexp_matches(s, 'function\\s+\\w+') THEN 'function' END WHEN s LIKE 'class %' THEN CASE WHEN regexp_matches(s, 'class\\s+\\w+') THEN 'class' END WHEN contains(s, 'import ') OR contains(s, 'require(') THEN 'import' END AS kind, CASE WHEN contains(s, 'function ') THEN regexp_extract(s, 'function\\s+(\\w+)', 1) WHEN s LIKE 'class %' THEN regexp_extract(s, 'class\\s+(\\w+)', 1) ELSE s END AS name, line_no FROM lines) WHERE kind IS NOT NULL")
def c06(spark: SparkSession, sf: str) -> DataFrame:
    return lines.js_structure(tables.files(spark, sf))


_LOOP = lambda t: f"(contains({t}, 'for ') OR contains({t}, 'while '))"


@query("c11_nested_loops", WL + f"SELECT l.file_id, l.line_no AS line_number, any_value(l.s) AS outer_loop, arg_min(n.s, n.line_no) AS inner_loop, 2 AS nesting_level FROM lines l JOIN lines n ON n.file_id = l.file_id AND n.line_no > l.line_no AND n.line_no < l.line_no + 20 AND n.s <> '' AND n.indent > l.indent AND {_LOOP('n.text')} WHERE {_LOOP('l.text')} GROUP BY l.file_id, l.line_no")
def c11(spark: SparkSession, sf: str) -> DataFrame:
    return lines.nested_loops(tables.files(spark, sf))


@query(
    "c12_recursive_calls",
    WL
    + f"""SELECT file_id, function_name, line_no AS line_number, s AS call_expression FROM (SELECT l.*, last_value(CASE WHEN s LIKE 'def %' THEN trim(regexp_extract(split_part(text, 'def ', 2), '^([^(]*)', 1)) END IGNORE NULLS) OVER (PARTITION BY l.file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS function_name
    FROM lines l JOIN (SELECT file_id FROM (SELECT file_id, {_marks_sql(_PERFORMANCE)} FROM files) WHERE {_BEST} = 'python') p ON p.file_id = l.file_id) WHERE s NOT LIKE 'def %' AND function_name <> '' AND contains(text, function_name) AND contains(text, '(')""",
)
def c12(spark: SparkSession, sf: str) -> DataFrame:
    return lines.python_recursion(tables.files(spark, sf))


#: C definitions with their names, and the second of the first two closing lines in a row within 50 lines.
_C_SCOPES = f"""c AS (SELECT l.*, lag(s) OVER (PARTITION BY l.file_id ORDER BY line_no) AS before FROM lines l JOIN (SELECT file_id FROM (SELECT file_id, {_marks_sql(_PERFORMANCE)} FROM files) WHERE {_BEST} IN ('c', 'cpp')) p ON p.file_id = l.file_id),
d AS (SELECT file_id, line_no, regexp_extract(trim(split_part(text, '(', 1)), '(\\S+)$', 1) AS name FROM c WHERE regexp_matches(text, 'void |int |bool |char |double |float ') AND contains(text, '(') AND contains(text, '{{') AND contains(trim(split_part(text, '(', 1)), ' ')),
e AS (SELECT d.file_id, d.line_no, any_value(d.name) AS name, min(c.line_no) AS closed FROM d LEFT JOIN c ON c.file_id = d.file_id AND c.line_no > d.line_no AND c.line_no <= d.line_no + 50 AND c.s = '}}' AND c.before = '}}' GROUP BY d.file_id, d.line_no) """


@query("c12_c_recursion", WL + f", {_C_SCOPES} SELECT e.file_id, e.name AS function_name, CAST(c.line_no AS INTEGER) AS line_number, c.s AS call_expression FROM e JOIN c ON c.file_id = e.file_id AND c.line_no > e.line_no AND (e.closed IS NULL OR c.line_no < e.closed) AND contains(c.text, e.name) AND contains(c.text, '(') AND contains(c.text, ';')")
def c12c(spark: SparkSession, sf: str) -> DataFrame:
    return lines.c_recursion(tables.files(spark, sf))


#: Lines of Python functions: from a definition to the next line that is not indented deeper, comments aside.
_PY_SCOPES = """d AS (SELECT *, sum((s LIKE 'def %')::INT) OVER (PARTITION BY file_id ORDER BY line_no) AS position FROM lines),
e AS (SELECT *, first_value(indent) OVER w AS depth, first_value(line_no) OVER w AS opened, trim(split_part(split_part(first_value(text) OVER w, 'def ', 2), '(', 1)) AS name FROM d WHERE position > 0 WINDOW w AS (PARTITION BY file_id, position ORDER BY line_no)),
f AS (SELECT *, max((line_no > opened AND s <> '' AND indent <= depth AND s NOT LIKE '#%')::INT) OVER (PARTITION BY file_id, position ORDER BY line_no) AS ended FROM e),
g AS (SELECT * FROM f WHERE ended = 0 AND position <= 10) """


@query("c13_recursive_functions", WL + f", {_PY_SCOPES} SELECT file_id, CAST(position AS INTEGER) AS position, any_value(name) AS function_name, arg_min(s, line_no) AS recursive_call_line FROM g WHERE line_no > opened AND name <> '' AND contains(text, name) AND contains(text, '(') GROUP BY file_id, position")
def c13(spark: SparkSession, sf: str) -> DataFrame:
    return lines.recursive_functions(tables.files(spark, sf))


@query("c09_functions", WL + f", {_PY_SCOPES} SELECT file_id, CAST(position AS INTEGER) AS position, any_value(name) AS name, string_agg(text, chr(10) ORDER BY line_no) AS code FROM g GROUP BY file_id, position")
def c09(spark: SparkSession, sf: str) -> DataFrame:
    return lines.python_functions(tables.files(spark, sf))


def _io_sql() -> str:
    parts = []
    for kind, marks in _IO.items():
        case = " ".join(f"WHEN contains(lower(text), '{m}') THEN '{m}'" for m in marks)
        parts.append(f"SELECT file_id, line_no AS line_number, '{kind}' AS io_type, s AS operation, CASE {case} END AS pattern_matched FROM lines")
    return WL + "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE pattern_matched IS NOT NULL"


@query("c14_io_operations", _io_sql())
def c14(spark: SparkSession, sf: str) -> DataFrame:
    return lines.io_operations(tables.files(spark, sf))


@query(
    "c15_bottlenecks",
    f"WITH parts AS (SELECT file_id, line_number, 'nested_loop' AS type, 'medium' AS severity, 6.0 AS severity_score, 0 AS part FROM ({SQL['c11_nested_loops']}) UNION ALL SELECT file_id, line_number, 'recursion', 'medium', 5.0, 1 FROM ({SQL['c12_recursive_calls']}) "
    f"UNION ALL SELECT DISTINCT file_id, line_number, 'io_operation', 'low', 3.0, 2 FROM ({SQL['c14_io_operations']})) "
    "SELECT file_id, line_number, type, severity, severity_score::DOUBLE AS severity_score, position::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY severity_score DESC, part, line_number) AS position FROM parts) WHERE position <= 10",
)
def c15(spark: SparkSession, sf: str) -> DataFrame:
    return lines.bottlenecks(tables.files(spark, sf))


_n = lambda w: f"CAST((length(content) - length(replace(content, '{w}', ''))) / {len(w)} AS BIGINT)"


@query("c16_python_counts", W + f"SELECT file_id, {_n('def ')} AS function_count, {_n('class ')} AS class_count, {_n('for ')} + {_n('while ')} + {_n('forEach')} AS loop_count, {_has('content', 'async ', 'await ')} AS async_patterns, {_n('[')} + {_n(']')} AS list_comprehensions, {_n('(')} + {_n(')')} AS generator_expressions, {_n('@')} AS decorator_usage, {_n('with ')} AS context_managers FROM files")
def c16(spark: SparkSession, sf: str) -> DataFrame:
    return lines.python_counts(tables.files(spark, sf))


@query("c17_cpp_counts", W + f"SELECT file_id, {_n('{')} AS function_count, {_n('class ')} + {_n('struct ')} AS class_count, {_n('for ')} + {_n('while ')} + {_n('do ')} AS loop_count, {_has('content', 'malloc', 'free', 'new', 'delete', 'alloc')} AS memory_operations, contains(content, '*') AND contains(content, '&') AS pointer_usage, contains(lower(content), 'template<') AS template_usage, contains(content, '#') AS preprocessor_directives, contains(lower(content), 'std::') AS stl_usage, {_has('content', 'std::unique_ptr', 'std::shared_ptr', 'std::weak_ptr')} AS smart_pointers FROM files")
def c17(spark: SparkSession, sf: str) -> DataFrame:
    return lines.cpp_counts(tables.files(spark, sf))


@query("c18_operation_flags", W + f"SELECT file_id, {_has('lower(content)', 'sql', 'select', 'insert', 'update', 'delete', 'database', 'query')} AS database_operations, {_has('lower(content)', 'open(', 'read(', 'write(', 'file', 'io')} AS file_operations, {_has('lower(content)', 'requests', 'http', 'socket', 'urllib', 'fetch')} AS network_operations FROM files")
def c18(spark: SparkSession, sf: str) -> DataFrame:
    return lines.operation_flags(tables.files(spark, sf))


@query("c19_style", WL + "SELECT file_id, line_no AS line, 'E501' AS code, 'Line too long (' || length(text) || ' > 79 characters)' AS message, 'low' AS severity FROM lines WHERE length(text) > 79 UNION ALL SELECT file_id, line_no, 'E111', 'Indentation is not a multiple of four', 'low' FROM lines WHERE text LIKE ' %' AND text NOT LIKE '    %' AND s <> ''")
def c19(spark: SparkSession, sf: str) -> DataFrame:
    return lines.style_check(tables.files(spark, sf))


@query("c20_security_context", W + "SELECT dir, " + ", ".join(f"bool_or({_has('lower(content)', *words)}) AS {flag}" for flag, words in _CONTEXT.items()) + " FROM (SELECT *, split_part(path, '/', 1) AS dir, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path) AS rn FROM files) WHERE rn <= 5 GROUP BY dir")
def c20(spark: SparkSession, sf: str) -> DataFrame:
    return lines.security_context(tables.files(spark, sf).withColumn("dir", F.split_part("path", F.lit("/"), F.lit(1))), "dir")


def _hardening_sql() -> str:
    parts = [f"SELECT file_id, {k} AS position, '{c}' AS category, '{p}' AS priority FROM files WHERE {_has('lower(content)', *words)}" + "".join(f" AND NOT contains(lower(content), '{w}')" for w in without) for k, (c, words, without, p) in enumerate(lines.HARDENING)]
    return W + " UNION ALL ".join(parts)


@query("x57_hardening", _hardening_sql())
def x57(spark: SparkSession, sf: str) -> DataFrame:
    return lines.hardening(tables.files(spark, sf))


@query("a31_file_groups", W + "SELECT split_part(path, '/', 1) AS grp, count(*) AS n FROM files GROUP BY grp ORDER BY grp LIMIT 20")
def a31(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.file_groups(tables.files(spark, sf)).groupBy("grp").agg(F.count("*").alias("n"))


@query("a32_group_contents", W + "SELECT split_part(path, '/', 1) AS grp, count(*) AS n_files, sha256(string_agg('/* File: ' || path || ' */' || chr(10) || content, chr(10) || chr(10) ORDER BY path)) AS content FROM files GROUP BY grp")
def a32(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.group_contents(aggregate.file_groups(tables.files(spark, sf))).withColumn("content", F.sha2("content", 256))


@query("c30_dispatch", W + "SELECT tool, count(*) AS n FROM (SELECT unnest(CASE file_id % 5 WHEN 0 THEN ['semgrep', 'bandit', 'pylint', 'flake8', 'mypy', 'radon', 'pep8_checker'] WHEN 2 THEN ['semgrep', 'cppcheck', 'clang-tidy'] WHEN 3 THEN ['semgrep', 'spotbugs'] ELSE ['semgrep'] END) AS tool FROM files) GROUP BY tool")
def c30(spark: SparkSession, sf: str) -> DataFrame:
    language = F.element_at(F.array(*map(F.lit, ("python", "javascript", "cpp", "java", "unknown"))), (F.col("file_id") % 5 + 1).cast("int"))
    return toolparse.dispatch(tables.files(spark, sf).withColumn("language", language)).groupBy("tool").agg(F.count("*").alias("n"))


def tool_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs of the eight tools made from events, one tool for each remainder of the id."""
    e = tables.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("k"))
    text = lambda pattern: F.format_string(pattern, F.col("k"))
    shapes = (
        ("semgrep", '{"results":[{"check_id":"r.%1$s","start":{"line":%1$s,"col":2},"extra":{"message":"m%1$s","severity":"WARNING","metadata":{"cwe":"CWE-1"}}}]}'),
        ("cppcheck", '<results><errors><error id="e%1$s" severity="error" msg="m%1$s"><location file="a.c" line="%1$s"/></error></errors></results>'),
        ("clang-tidy", "/a.c:%1$s:5: warning: m%1$s [c-%1$s]\nnoise"),
        ("spotbugs", '<BugCollection><BugInstance type="T%1$s" priority="2"><LongMessage>m%1$s</LongMessage><SourceLine start="%1$s" sourcepath="A.java"/></BugInstance></BugCollection>'),
        ("pylint", '[{"type":"error","message":"m%1$s","line":%1$s,"column":1,"symbol":"s","message-id":"E1"}]'),
        ("flake8", "a.py:%1$s:3: E501 m%1$s"),
        ("bandit", '{"results":[{"issue_text":"m%1$s","line_number":%1$s,"issue_severity":"HIGH","issue_confidence":"LOW","test_id":"B1","test_name":"n"}]}'),
        ("mypy", "a.py:%1$s: m%1$s"),
    )
    k = F.col("id") % len(shapes)
    tool, output = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (name, pattern) in enumerate(shapes):
        tool, output = F.when(k == n, name).otherwise(tool), F.when(k == n, text(pattern)).otherwise(output)
    return e.select(F.col("id").alias("file_id"), tool.alias("tool"), output.alias("output"))


@query("c21_c29_tool_issues", "SELECT event_id AS file_id, ['semgrep', 'cppcheck', 'clang-tidy', 'spotbugs', 'pylint', 'flake8', 'bandit', 'mypy'][event_id % 8 + 1] AS tool, CASE WHEN event_id % 8 = 5 THEN 'E501 m' || k ELSE 'm' || k END AS message, CAST(k AS BIGINT) AS line, ['medium', 'high', 'medium', 'medium', 'high', 'low', 'high', 'medium'][event_id % 8 + 1] AS severity FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)")
def c21(spark: SparkSession, sf: str) -> DataFrame:
    return toolparse.all_issues(tool_outputs(spark, sf)).drop("pos")
