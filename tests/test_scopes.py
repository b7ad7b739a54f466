"""Scopes of C and Python definitions against line-by-line models, and at a size where rest-of-file scans show."""

from __future__ import annotations

import random
import time

from reviewlake.operators import lines

TYPES = ("void ", "int ", "bool ", "char ", "double ", "float ")


def c_model(text):
    """Each definition reads the lines below it, one by one."""
    rows = text.split("\n")
    out = []
    for k, line in enumerate(rows):
        head = line.split("(")[0].strip()
        if not (any(t in line for t in TYPES) and "(" in line and "{" in line and " " in head):
            continue
        name, end = head.split()[-1], len(rows)
        for j in range(k + 1, min(k + 51, len(rows))):
            if rows[j].strip() == "}" and rows[j - 1].strip() == "}":
                end = j
                break
        out += [(name, j + 1, rows[j].strip()) for j in range(k + 1, end) if name in rows[j] and "(" in rows[j] and ";" in rows[j]]
    return out


def c_file(seed, n):
    r = random.Random(seed)
    pool = ["int f(int a) {", "  return f(a - 1);", "}", " }", "void go() {", "  go(); f(2);", "", "// go", "double  ff (x) {", "  ff(1);", "int x = 1;", "  if (f(a)) { go(); }", "for (;;)"]
    return "\n".join(r.choice(pool) for _ in range(n))


def test_c_calls_by_intervals(spark):
    for seed in range(60):
        text = c_file(seed, 150)
        assert sorted(lines._c_calls(text.split("\n"))) == sorted(c_model(text)), seed
    rows = [(k, "#include <vector>\nint main() {\nstd::vector<int> v;\n" + c_file(k, 80)) for k in range(6)] + [(7, None), (8, "")]
    got = lines.c_recursion(spark.createDataFrame(rows, "file_id long, content string")).collect()
    known = {r.file_id for r in got}
    assert known and sorted(map(tuple, got)) == sorted((i, *c) for i, t in rows if i in known for c in c_model(t or ""))


def test_many_definitions_in_linear_time():
    """Ten thousand definitions whose scopes reach to the end of a file of a hundred thousand lines."""
    text = []
    for k in range(10_000):
        text += [f"int name{k}x(int a) {{", "  a = 1;", "  b(a);", "}", "", *["  call(other);"] * 4, f"  name{k}x(2);"]
    began = time.perf_counter()
    found = lines._c_calls(text)
    assert time.perf_counter() - began < 10 and len(found) == 10_000


def test_long_python_file_in_linear_time(spark):
    body = []
    for k in range(10_000):
        body += [f"def name{k}(a):", *["    if a:", "        b = a", "    # note", "", "    x = 1", "    y = 2", "    z = 3", f"    return name{k}(a)"], "top = 1"]
    df = spark.createDataFrame([(1, "\n".join(body))], "file_id long, content string")
    began = time.perf_counter()
    got = lines.recursive_functions(df).collect()
    assert [r.position for r in sorted(got)] == list(range(1, 11)) and time.perf_counter() - began < 30
