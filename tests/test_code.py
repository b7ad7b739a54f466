"""Tool outputs, language detection, structure and chunking."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import chunking, lines, toolparse


def outputs(spark, text):
    return spark.createDataFrame([(1, text), (2, "broken {"), (3, ""), (4, None)], "file_id long, output string")


def rows(df):
    return [r.asDict() for r in df.orderBy("file_id", "pos").collect()]


def test_cppcheck(spark):
    xml = '<results><errors><error id="arrayIndexOutOfBounds" severity="error" msg="bad"><location file="/tmp/demo.c" line="42"/></error><error id="x" msg="y"/></errors></results>'
    got = rows(toolparse.cppcheck(outputs(spark, xml)))
    assert [(r["line"], r["severity"], r["rule_id"], r["file"]) for r in got] == [(42, "high", "arrayIndexOutOfBounds", "/tmp/demo.c"), (0, "low", "x", "")]


def test_semgrep(spark):
    text = '{"results":[{"check_id":"test.rule","start":{"line":7,"col":3},"extra":{"message":"m","severity":"WARNING","metadata":{"cwe":"CWE-119"}}},{"check_id":"b"}]}'
    got = rows(toolparse.semgrep(outputs(spark, text)))
    assert [(r["line"], r["column"], r["severity"], r["rule_id"], r["cwe"]) for r in got] == [(7, 3, "medium", "test.rule", "CWE-119"), (0, 0, "low", "b", "")]


def test_clang_tidy(spark):
    got = rows(toolparse.clang_tidy(outputs(spark, "/tmp/demo.c:10:5: warning: unsafe call detected [cert-msc30-c]\nnote\n/a.c:1:2: note: see here")))
    assert [(r["line"], r["severity"], r["rule_id"], r["message"], r["type"]) for r in got] == [(10, "medium", "cert-msc30-c", "unsafe call detected", "security"), (1, "medium", "", "see here", "style")]


def test_spotbugs(spark):
    xml = '<BugCollection><BugInstance type="NP_NULL_ON_SOME_PATH" priority="2"><ShortMessage>s</ShortMessage><SourceLine start="12" sourcepath="A.java"/></BugInstance></BugCollection>'
    got = rows(toolparse.spotbugs(outputs(spark, xml)))
    assert [(r["line"], r["severity"], r["rule_id"], r["message"]) for r in got] == [(12, "medium", "NP_NULL_ON_SOME_PATH", "s")]


def test_text_and_json_tools(spark):
    assert [(r["line"], r["column"], r["code"], r["message"]) for r in rows(toolparse.flake8(outputs(spark, "a.py:3:x: E501 too: long")))] == [(3, 0, "E501", "E501 too: long")]
    assert [(r["line"], r["message"]) for r in rows(toolparse.mypy(outputs(spark, "a.py:9: error: bad: thing\nok")))] == [(9, "error: bad: thing")]
    assert [(r["severity"], r["message_id"]) for r in rows(toolparse.pylint(outputs(spark, '[{"type":"refactor","message-id":"R1"},{}]')))] == [("low", "R1"), ("low", "")]
    assert [(r["severity"], r["confidence"]) for r in rows(toolparse.bandit(outputs(spark, '{"results":[{"issue_severity":"HIGH"}]}')))] == [("high", "low")]
    assert [(r["name"], r["complexity"]) for r in rows(toolparse.radon(outputs(spark, '{"a.py":[{"name":"f","type":"function","lineno":1,"complexity":4}]}')))] == [("f", 4)]


def files(spark, *contents):
    return spark.createDataFrame(list(enumerate(contents)), "file_id long, content string")


def test_recursion_in_c(spark):
    code = "#include <stdio.h>\nint fact(int n) {\n  if (n) {\n    return n * fact(n - 1);\n}\n}\nint other(int n) {\n  fact(3);\n}\nint fact2() {\n}"
    got = lines.c_recursion(files(spark, code)).collect()
    assert [(r.function_name, r.line_number) for r in got] == [("fact", 4)]


def test_functions_by_indentation(spark):
    code = "def a():\n    x\n# note\n    y\nz = 1\nclass B:\n    def c(self):\n        c()\n    d = 2\n"
    got = {r.name: r.code for r in lines.python_functions(files(spark, code, None, "")).collect()}
    assert got == {"a": "def a():\n    x\n# note\n    y", "c": "    def c(self):\n        c()"}
    assert [(r.function_name, r.recursive_call_line) for r in lines.recursive_functions(files(spark, code)).collect()] == [("c", "c()")]


def test_complexity_stops_at_dedent(spark):
    code = "def f(x):\n    if x:\n        for y in x:\n            pass\n    try:\n        pass\n    except: pass\nif x:\n    pass\nNAME_1 = 3\nname = 4"
    got = {(r.kind, r.name): r.complexity for r in lines.python_structure(files(spark, code)).collect()}
    assert got == {("function", "f"): 5, ("constant", "NAME_1"): None}


TEXTS = [
    "",
    "One. Two! Three? 四。五。",
    "para one\n\npara two " + "long sentence here. " * 20 + "\n\n\nlast",
    "import x\n\n@dec\ndef f():\n    return 1\nclass A:\n    pass\n",
    "line\r\nline2",
    "word " * 50,
]


def test_units_cover_the_text():
    for t in TEXTS:
        squeezed = "".join("".join(chunking.units(t)).split())
        assert squeezed == "".join(t.split())


@pytest.mark.parametrize("budget", [0, 1, 5, 20, 1000])
def test_truncation_and_packing_keep_the_budget(budget):
    for t in TEXTS:
        cut = chunking.truncate(t, budget)
        assert chunking.quarter(cut) <= max(budget, 0) + chunking.quarter("\n\n" * t.count("\n\n"))
    random.seed(1)
    for _ in range(50):
        parts = [random.choice(TEXTS) for _ in range(5)]
        kept = chunking.pack(parts, budget)
        assert sum(map(chunking.quarter, kept)) <= budget + 10 and len(kept) <= len(parts)


def test_line_chunks_rebuild_the_text():
    random.seed(2)
    for _ in range(50):
        t = "\n".join("x" * random.choice([0, 5, 300, 900]) for _ in range(random.randint(1, 20)))
        chunks = chunking.by_lines(t, 800)
        assert "\n".join(chunks) == t
        assert all(len(c.replace("\n", "")) <= 800 or "\n" not in c for c in chunks)


def test_semantic_chunks_against_a_plain_model(spark):
    random.seed(3)
    data = [(k, random.choice("ab"), "s", "high", "t", 1, "x" * random.choice([10, 300, 700, 900, 2000])) for k in range(60)]
    df = spark.createDataFrame(data, "ord long, file string, source string, severity string, tool string, requirement_id long, description string")
    sizes = {r.ord: r.n for r in df.select("ord", F.length(F.to_json(F.struct(*df.columns))).alias("n")).collect()}
    want = {}
    for sig in "ab":
        chunk, used, started = 0, 0, False
        for k, f, *_ in data:
            if f != sig:
                continue
            n = sizes[k]
            if n >= 800:
                if started:
                    chunk += 1
                want[k], started = chunk, False
                chunk, used = chunk + 1, 0
                continue
            if started and used + n > 800:
                chunk, used = chunk + 1, 0
            want[k], started = chunk, True
            used += n
    for n in (1, 6):
        got = {r.ord: r.chunk for r in chunking.semantic_chunks(df.repartition(n), limit=100).collect()}
        assert got == want
