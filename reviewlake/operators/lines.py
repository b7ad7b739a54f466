"""Code analytics over files and their lines."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_of
from .aggregate import numbered


def lines(files: DataFrame) -> DataFrame:
    """``(file_id, line_no, text)`` of each file's lines, counted from 1."""
    return files.select("file_id", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text")).select("file_id", (F.col("pos") + 1).alias("line_no"), "text")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _indent(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, r"(?U)^\s+", ""))


def _has(c: Column, *pieces: str) -> Column:
    out = F.lit(False)
    for p in pieces:
        out = out | F.contains(c, F.lit(p))
    return out


def line_stats(files: DataFrame) -> DataFrame:
    """Total, blank, comment and code lines of each file, without leaving the row."""
    rows = F.transform(F.split("content", "\n", -1), _strip)
    n = lambda test: F.size(F.filter(rows, test)).cast("long")
    comment = lambda s: F.startswith(s, F.lit("#")) | F.startswith(s, F.lit("//"))
    return files.select(
        "file_id",
        F.size(rows).cast("long").alias("total_lines"),
        n(lambda s: s == "").alias("blank_lines"),
        n(comment).alias("comment_lines"),
        n(lambda s: (s != "") & ~comment(s)).alias("code_lines"),
    )


def scan_language(content: Column) -> Column:
    """Language by marks, in the order of the static scan."""
    return (
        F.when(_has(content, "def ") & _has(content, "import "), "python")
        .when(_has(content, "function ", "const "), "javascript")
        .when(_has(content, "class ") & _has(content, "public "), "java")
        .when(_has(content, "#include"), F.when(_has(content, "std::"), "cpp").otherwise("c"))
        .when(content.rlike(r"\b(int|char|void|size_t|struct)\s+\w+\s*\("), "cpp")
        .otherwise("unknown")
    )


# Marks of the languages, of the performance and of the quality analysis.
PERFORMANCE_MARKS = {
    "python": ("def ", "import ", "class ", "self.", "__init__", "lambda:", "yield "),
    "cpp": ("#include", "namespace", "std::", "cout", "cin", "template<", "using namespace"),
    "c": ("#include", "printf", "scanf", "malloc", "free", "struct ", "typedef"),
}
QUALITY_MARKS = {
    "python": ("def ", "import ", "class ", "self.", "__init__"),
    "cpp": ("#include", "namespace", "std::", "cout", "cin"),
    "c": ("#include", "printf", "scanf", "malloc", "free"),
}


def _by_marks(content: Column, marks: dict[str, tuple[str, ...]]) -> tuple[Column, Column]:
    """The language with most marks, earlier ones first among equals, and the number of its marks."""
    lower = F.lower(content)
    score = {k: sum((_has(content if k == "python" else lower, p).cast("int") for p in pieces), F.lit(0)) for k, pieces in marks.items()}
    best = F.greatest(*score.values())
    out = None
    for k, s in score.items():
        out = F.when(s == best, k) if out is None else out.when(s == best, k)
    return out, best


def performance_language(content: Column) -> Column:
    name, n = _by_marks(content, PERFORMANCE_MARKS)
    return F.when(n > 0, name).otherwise("unknown")


def quality_language(content: Column, extension: Column) -> Column:
    """Language by extension, headers and unknown extensions by content."""
    lower = F.lower(content)
    name, n = _by_marks(content, QUALITY_MARKS)
    header = F.when(_has(lower, "namespace", "std::", "template"), "cpp").when(_has(lower, "#include", "printf"), "c").otherwise("c_cpp_header")
    return (
        F.when(extension == ".py", "python")
        .when(extension.isin(".cpp", ".cxx", ".cc"), "cpp")
        .when(extension == ".c", "c")
        .when(extension.isin(".h", ".hpp", ".hxx"), header)
        .when(n > 0, name)
        .otherwise("unknown")
    )


def snippet_language(code: Column) -> Column:
    return F.when(_has(code, "def ") & _has(code, "import "), "python").when(_has(code, "function ") & _has(code, "var "), "javascript").when(_has(code, "public ") & _has(code, "class "), "java").otherwise("unknown")


#: Words of a line that add a branch.
BRANCHES = ("if ", "elif ", "for ", "while ", "try:", "except:")


def python_structure(files: DataFrame) -> DataFrame:
    """Functions (with complexity), classes, imports and constants: file_id, kind, name, line_no, complexity.

    Complexity is one plus the branching lines among the next 49 up to the first line that is
    not indented deeper; the lines ahead are a slice of the file's own array, so nothing is joined.
    """
    rows = files.select("file_id", F.split("content", "\n", -1).alias("all")).select("file_id", "all", F.posexplode("all").alias("pos", "text"))
    s = _strip(F.col("text"))
    after = lambda mark: F.substr(s, F.lit(len(mark) + 1))
    first = lambda c, stops: F.regexp_extract(c, f"^([^{stops}]*)", 1)
    constant = F.trim(F.split_part(s, F.lit("="), F.lit(1)))
    upper = (F.upper(constant) == constant) & constant.rlike(r"(?U)\p{L}") & (F.lower(constant) != constant)
    found = (
        F.when(F.startswith(s, F.lit("def ")), F.struct(F.lit("function").alias("kind"), first(F.split_part(after("def "), F.lit("def "), F.lit(1)), "(").alias("name")))
        .when(F.startswith(s, F.lit("class ")), F.struct(F.lit("class").alias("kind"), first(F.split_part(after("class "), F.lit("class "), F.lit(1)), "(:").alias("name")))
        .when(F.startswith(s, F.lit("import ")) | F.startswith(s, F.lit("from ")), F.struct(F.lit("import").alias("kind"), s.alias("name")))
        .when(F.contains(s, F.lit("=")) & upper, F.struct(F.lit("constant").alias("kind"), constant.alias("name")))
    )
    ahead = F.slice("all", F.col("pos") + 2, 49)
    indent = _indent(F.col("text"))
    # 1 where the line ends the body; the first of these cuts the lines ahead
    ends = F.array_position(F.transform(ahead, lambda x: ((_strip(x) != "") & (_indent(x) <= indent)).cast("int")), F.lit(1))
    body = F.when(ends > 0, F.slice(ahead, F.lit(1), (ends - 1).cast("int"))).otherwise(ahead)
    complexity = 1 + F.size(F.filter(body, lambda x: _has(x, *BRANCHES)))
    marked = rows.withColumn("f", found).filter(F.col("f").isNotNull())
    return marked.select("file_id", "f.kind", "f.name", (F.col("pos") + 1).alias("line_no"), F.when(F.col("f.kind") == "function", complexity).alias("complexity"))


def js_structure(files: DataFrame) -> DataFrame:
    rows = lines(files)
    s = _strip(F.col("text"))
    function, class_ = F.regexp_extract(s, r"function\s+(\w+)", 1), F.regexp_extract(s, r"class\s+(\w+)", 1)
    kind = F.when(_has(s, "function "), F.when(function != "", "function")).when(F.startswith(s, F.lit("class ")), F.when(class_ != "", "class")).when(_has(s, "import ", "require("), "import")
    return rows.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("file_id", "kind", F.when(F.col("kind") == "function", function).when(F.col("kind") == "class", class_).otherwise(s).alias("name"), "line_no")


LOOPS = ("for ", "while ")


def nested_loops(files: DataFrame) -> DataFrame:
    """Loop lines with the first deeper-indented loop line among the next 19: line_number, outer_loop, inner_loop."""
    rows = files.filter(_has(F.col("content"), *LOOPS)).select("file_id", F.split("content", "\n", -1).alias("all"))
    marked = F.filter(F.transform("all", lambda x, k: F.when(_has(x, *LOOPS), k)), lambda k: k.isNotNull())
    # loop lines alone leave the row, each with the loop lines near it, never with the file
    loops = rows.select("file_id", F.inline(F.transform(marked, lambda k: F.struct(k.alias("pos"), F.get("all", k).alias("text"), F.filter(F.slice("all", k + 2, F.lit(19)), lambda x: _has(x, *LOOPS)).alias("near")))))
    indent = _indent(F.col("text"))
    inner = F.get(F.filter("near", lambda x: _indent(x) > indent), F.lit(0))
    found = loops.select("file_id", (F.col("pos") + 1).alias("line_number"), "text", inner.alias("inner")).filter(F.col("inner").isNotNull())
    return found.select("file_id", "line_number", _strip(F.col("text")).alias("outer_loop"), _strip(F.col("inner")).alias("inner_loop"), F.lit(2).alias("nesting_level"))


def python_recursion(files: DataFrame) -> DataFrame:
    """Lines of Python files that name the function they stand in, by carrying the last definition forward."""
    rows = lines(files.filter(performance_language(F.col("content")) == "python"))
    s = _strip(F.col("text"))
    defined = F.startswith(s, F.lit("def "))
    name = F.when(defined, F.trim(F.regexp_extract(F.split_part("text", F.lit("def "), F.lit(2)), r"^([^(]*)", 1)))
    current = F.last(name, ignorenulls=True).over(Window.partitionBy("file_id").orderBy("line_no"))
    carried = rows.withColumn("function_name", current).withColumn("defined", defined)
    calls = carried.filter(~F.col("defined") & (F.col("function_name") != "") & F.contains("text", F.col("function_name")) & F.contains("text", F.lit("(")))
    return calls.select("file_id", "function_name", F.col("line_no").alias("line_number"), _strip(F.col("text")).alias("call_expression"))


#: Types that open a C definition line.
C_TYPES = ("void ", "int ", "bool ", "char ", "double ", "float ")


#: Lines after a definition among which its end is sought.
C_REACH = 50


def c_recursion(files: DataFrame) -> DataFrame:
    """Lines of C and C++ files below a definition that call it, up to two closing lines within 50 lines, else to the end.

    A file's definitions become intervals of lines in one sweep, and their names an automaton that
    reads each line once; a line then meets only the intervals of the names it holds. Null texts
    have no lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for file_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found += [(file_id, *call) for call in _c_calls((text.as_py() or "").split("\n"))]
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["file_id", "function_name", "line_number", "call_expression"])

    chosen = files.filter(performance_language(F.col("content")).isin("c", "cpp")).select(F.col("file_id").cast("long").alias("file_id"), "content")
    return chosen.mapInArrow(run, "file_id long, function_name string, line_number int, call_expression string")


def _c_calls(all_lines: list[str]) -> list[tuple[str, int, str]]:
    """``(name, line number, line)`` of the calls, by line and then by definition."""
    bare = [x.strip() for x in all_lines]
    closing = [k for k in range(1, len(bare)) if bare[k] == bare[k - 1] == "}"]
    scopes: dict[str, list[tuple[int, int]]] = {}
    for k, line in enumerate(all_lines):
        if "(" in line and "{" in line and any(t in line for t in C_TYPES):
            head = line.split("(")[0].strip()
            if " " in head:
                at = bisect_left(closing, k + 1)
                end = closing[at] if at < len(closing) and closing[at] <= k + C_REACH else len(all_lines)
                scopes.setdefault(head.split()[-1], []).append((k, end))
    if not scopes:
        return []
    automaton = ahocorasick.Automaton()
    for name in scopes:
        automaton.add_word(name, name)
    automaton.make_automaton()
    opened: dict[str, list[tuple[int, int]]] = {name: [] for name in scopes}
    later = {name: list(reversed(spans)) for name, spans in scopes.items()}
    out = []
    for k, line in enumerate(all_lines):
        if "(" not in line or ";" not in line:
            continue
        for name in sorted({name for _, name in automaton.iter(line)}):
            waiting = later[name]
            while waiting and waiting[-1][0] < k:
                opened[name].append(waiting.pop())
            opened[name] = [span for span in opened[name] if span[1] > k]
            out += [(name, k + 1, bare[k]) for _ in opened[name]]
    return out


# What marks input and output on a line, in the order tested.
IO_MARKS = {
    "file_io": ("open(", "read(", "write(", "close()"),
    "database_io": ("execute(", "query(", "select", "insert", "update"),
    "network_io": ("requests.", "urllib.", "socket.", "httpx."),
}


def io_operations(files: DataFrame) -> DataFrame:
    """A row per line and type of input or output, with the first mark that matches."""
    low = F.lower("text")
    kinds = []
    for kind, marks in IO_MARKS.items():
        hit = None
        for m in marks:
            hit = F.when(_has(low, m), m) if hit is None else hit.when(_has(low, m), m)
        kinds.append(F.struct(F.lit(kind).alias("io_type"), hit.alias("pattern_matched")))
    rows = lines(files).select("file_id", F.col("line_no").alias("line_number"), "text", F.explode(F.array(*kinds)).alias("k"))
    return rows.filter(F.col("k.pattern_matched").isNotNull()).select("file_id", "line_number", "k.io_type", _strip(F.col("text")).alias("operation"), "k.pattern_matched")


def bottlenecks(files: DataFrame, n: int = 10) -> DataFrame:
    """Loops, recursion and I/O as bottleneck rows, worst first, ``n`` per file; ties in the order found."""
    kinds = (("nested_loop", "medium", 6.0), ("recursion", "medium", 5.0), ("io_operation", "low", 3.0))
    parts = [nested_loops(files), python_recursion(files), io_operations(files).groupBy("file_id", "line_number").agg(F.count("*").alias("n"))]
    rows = None
    for k, (part, (kind, severity, score)) in enumerate(zip(parts, kinds, strict=True)):
        one = part.select("file_id", "line_number", F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(score).alias("severity_score"), F.lit(k).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    return numbered(rows, ["file_id"], [F.desc("severity_score"), "part", "line_number"], "position").filter(F.col("position") <= n).drop("part")


def python_counts(files: DataFrame) -> DataFrame:
    c = F.col("content")
    return files.select(
        "file_id",
        count_of(c, "def ").alias("function_count"),
        count_of(c, "class ").alias("class_count"),
        (count_of(c, "for ") + count_of(c, "while ") + count_of(c, "forEach")).alias("loop_count"),
        _has(c, "async ", "await ").alias("async_patterns"),
        (count_of(c, "[") + count_of(c, "]")).alias("list_comprehensions"),
        (count_of(c, "(") + count_of(c, ")")).alias("generator_expressions"),
        count_of(c, "@").alias("decorator_usage"),
        count_of(c, "with ").alias("context_managers"),
    )


def cpp_counts(files: DataFrame) -> DataFrame:
    c, low = F.col("content"), F.lower("content")
    return files.select(
        "file_id",
        count_of(c, "{").alias("function_count"),
        (count_of(c, "class ") + count_of(c, "struct ")).alias("class_count"),
        (count_of(c, "for ") + count_of(c, "while ") + count_of(c, "do ")).alias("loop_count"),
        _has(c, "malloc", "free", "new", "delete", "alloc").alias("memory_operations"),
        (_has(c, "*") & _has(c, "&")).alias("pointer_usage"),
        _has(low, "template<").alias("template_usage"),
        _has(c, "#").alias("preprocessor_directives"),
        _has(low, "std::").alias("stl_usage"),
        _has(c, "std::unique_ptr", "std::shared_ptr", "std::weak_ptr").alias("smart_pointers"),
    )


def operation_flags(files: DataFrame) -> DataFrame:
    low = F.lower("content")
    return files.select(
        "file_id",
        _has(low, "sql", "select", "insert", "update", "delete", "database", "query").alias("database_operations"),
        _has(low, "open(", "read(", "write(", "file", "io").alias("file_operations"),
        _has(low, "requests", "http", "socket", "urllib", "fetch").alias("network_operations"),
    )


def style_check(files: DataFrame) -> DataFrame:
    """Over-long lines (E501) and one to three leading blanks (E111)."""
    text, n = F.col("text"), F.length("text")
    long = F.when(n > 79, F.struct(F.lit("E501").alias("code"), F.concat(F.lit("Line too long ("), n.cast("string"), F.lit(" > 79 characters)")).alias("message")))
    odd = F.when(F.startswith(text, F.lit(" ")) & ~F.startswith(text, F.lit("    ")) & (_strip(text) != ""), F.struct(F.lit("E111").alias("code"), F.lit("Indentation is not a multiple of four").alias("message")))
    rows = lines(files).select("file_id", F.col("line_no").alias("line"), F.explode(F.array_compact(F.array(long, odd))).alias("i"))
    return rows.select("file_id", "line", "i.code", "i.message", F.lit("low").alias("severity"))


# Words of the security context.
CONTEXT_WORDS = {
    "web_application": ("flask", "django", "fastapi"),
    "authentication_present": ("password", "auth", "jwt", "oauth"),
    "database_usage": ("sql", "database", "sqlite", "mysql", "postgres"),
    "network_operations": ("requests", "http", "socket", "urllib", "aiohttp"),
    "encryption_usage": ("encrypt", "hash", "bcrypt", "sha", "cipher"),
}


def security_context(files: DataFrame, *keys: str, n: int = 5) -> DataFrame:
    """Flags over each key's first ``n`` files by path."""
    first = numbered(files, list(keys), ["path"]).filter(F.col("rn") <= n)
    low = F.lower("content")
    return first.groupBy(*keys).agg(*[F.bool_or(_has(low, *words)).alias(flag) for flag, words in CONTEXT_WORDS.items()])


# Hardening advice by what a file holds, and what must not be there.
HARDENING = (
    ("危险调用", ("exec(", "eval("), (), "high"),
    ("命令执行", ("subprocess",), (), "medium"),
    ("凭据处理", ("password",), ("hash",), "high"),
    ("传输安全", ("http://",), (), "medium"),
    ("调试配置", ("debug",), (), "low"),
)


def hardening(files: DataFrame, most: int = 8) -> DataFrame:
    """Rule-based advice for each file, in the order of the rules."""
    low = F.lower("content")
    rows = F.array_compact(F.array(*[F.when(_has(low, *words) & ~_has(low, *without), F.struct(F.lit(k).alias("position"), F.lit(category).alias("category"), F.lit(priority).alias("priority"))) for k, (category, words, without, priority) in enumerate(HARDENING)]))
    return files.select("file_id", F.inline(F.slice(rows, 1, most)))


#: Files of a batch whose lines are Python objects at a time.
SLICE = 128


def python_functions(files: DataFrame, n: int = 10) -> DataFrame:
    """Texts of each file's first ``n`` Python functions: file_id, position, name, code.

    A definition runs to the next line that is not indented deeper (comments aside).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                ids, texts = (c.to_pylist() for c in batch.slice(at, SLICE).columns)
                out = [(i, k, name, code) for i, text in zip(ids, texts, strict=True) for k, (name, code) in enumerate(_functions(text or "", n), 1)]
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["file_id", "position", "name", "code"])

    return files.select(F.col("file_id").cast("long").alias("file_id"), "content").mapInArrow(run, "file_id long, position int, name string, code string")


def _functions(text: str, most: int) -> list[tuple[str, str]]:
    found: list[list[str]] = []
    depth: int | None = None
    for line in text.split("\n"):
        bare = line.strip()
        indent = len(line) - len(line.lstrip())
        if bare.startswith("def "):
            if len(found) == most:
                break
            depth = indent
            found.append([line])
        elif depth is not None:
            if bare and indent <= depth and not bare.startswith("#"):
                depth = None
            else:
                found[-1].append(line)
    return [(body[0].split("def ")[1].split("(")[0].strip(), "\n".join(body)) for body in found]


def recursive_functions(files: DataFrame) -> DataFrame:
    """Functions that call themselves, with the first such line."""
    rows = python_functions(files).withColumn("rest", F.slice(F.split("code", "\n", -1), F.lit(2), F.greatest(F.size(F.split("code", "\n", -1)) - 1, F.lit(0))))
    call = F.get(F.filter("rest", lambda x: F.contains(x, F.col("name")) & F.contains(x, F.lit("("))), F.lit(0))
    return rows.select("file_id", "position", F.col("name").alias("function_name"), _strip(call).alias("recursive_call_line")).filter("function_name != '' and recursive_call_line is not null")
