"""Whole operators against plain Python models."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from reviewlake.functions import answers
from reviewlake.operators import chunking, reports, secondpass

ISSUES = "ord long, requirement_id long, file string, source string, severity string, line long, description string, tool string, run_id string"


def embedding(text):
    total = sum(map(ord, text))
    return [float(max(len(text), 1)), total % 991 / 991, total % 313 / 313]


def distance(a, b):
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    return round(1 - dot / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 6)


def second_pass(issues, known):
    """Evidence, corrected severities, findings (five a run), and the first of each description, source and line."""
    rows, new = [], []
    for i in issues:
        i = dict(i)
        hits = []
        if (i["description"] or "").strip():
            v = embedding(f"[{(i['source'] or '').strip()}] {i['description'].strip()}")
            near = sorted((distance(v, k["vector"]), k["sqlite_id"]) for k in known)[:5]
            hits = [(1 - d / 2, next(k for k in known if k["sqlite_id"] == n)) for d, n in near]
        best = max(hits, key=lambda h: h[0], default=None)
        old = (i["severity"] or "low").lower()
        severity, source, old_severity = i["severity"], i["source"], None
        if best and best[0] >= 0.78 and best[1]["severity"] and best[1]["severity"].lower() != old:
            severity, source, old_severity = best[1]["severity"].lower(), (i["source"] or "unknown") + "_db_corrected", old
        rows.append((0, i["ord"], 0, i["run_id"], source, severity, i["line"], i["description"], i["tool"], old_severity))
        for n, (similarity, k) in enumerate(hits):
            if similarity >= 0.84 and (k["error_type"] or "潜在已知问题模式命中").lower() not in (i["description"] or "").lower():
                new.append((1, i["ord"], n, i["run_id"], "db_supplemented", k["severity"] or "medium", i["line"], "历史知识命中，可能漏报: " + (k["error_type"] or "潜在已知问题模式命中"), "second_pass_analysis", None))
    for run in sorted({r[3] for r in rows}):
        rows += [f for f in sorted(new) if f[3] == run][:5]
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r[:3]):
        key = ((r[7] or "").strip().lower(), (r[4] or "").strip().lower(), r[6] or "")
        if key not in seen:
            seen.add(key)
            out.append(r)
    return out


def test_second_pass_as_a_whole(spark):
    r = random.Random(4)
    pick = lambda *v: r.choice(v)
    issues = [dict(ord=k, requirement_id=k % 4, file="f", source=pick("click", "view", "a b"), severity=pick("low", "high", "critical", None), line=r.randint(0, 6), description=pick("", None, *(f"{w} {n}" for w in ("error", "leak", "Overflow in x") for n in range(6))), tool="t", run_id=pick("r1", "r2")) for k in range(150)]
    known = [dict(sqlite_id=k, vector=embedding(f"[click] {w} {k}"), error_type=pick("error", "leak", None), severity=pick("high", "medium", "low")) for k, w in enumerate(["error", "leak", "injection of code", "x"] * 5)]
    got = secondpass.second_pass(spark.createDataFrame(issues, ISSUES).repartition(3), spark.createDataFrame(known, "sqlite_id long, vector array<double>, error_type string, severity string"), "run_id")
    rows = [(x.part, x.issue_ord, x.hit_ord, x.run_id, x.source, x.severity, x.line, x.description, x.tool, x.old_severity) for x in got.collect()]
    want = second_pass(issues, known)
    assert sorted(rows, key=lambda x: x[:3]) == want
    assert any(x[9] for x in want) and any(x[0] for x in want) and len(want) < len(issues)


def test_token_chunks_by_a_plain_loop(spark):
    r = random.Random(8)
    words = ["one", "two words", "a, b.", "def f(x):", "    return x", "", "class A:", "The end. Another start! 中文。 And more"]
    texts = [None, "", *("\n".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(40)), "word " * 700]
    for budget, most in ((256, 10), (5, 3), (1, 100)):
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        got = {x.id: x.c for x in df.select("id", chunking.token_chunks(F.col("text"), budget, most).alias("c")).collect()}
        for i, text in enumerate(texts):
            want, used = [], 0
            for unit in chunking.units(text):
                n = len(unit.split())
                if want and used + n <= budget:
                    want[-1].append(unit)
                    used += n
                else:
                    want.append([unit])
                    used = n
            assert got[i] == ["\n\n".join(w) for w in want][:most]


def test_code_blocks_by_a_plain_loop(spark):
    r = random.Random(9)
    pool = ["x = 1", "", "   ", "def f():", "    y = 2", "class B:", "async def g():", "@mark", "    def inner():", "define(x)", "classes = 3"]
    for _ in range(60):
        text = "\n".join(r.choice(pool) for _ in range(r.randint(0, 25)))
        want, block = [], []
        for line in text.split("\n") if text else []:
            starts = line.strip().startswith(("def ", "class ", "async def ", "@"))
            if not line.strip() or starts and block:
                want.append("\n".join(block))
                block = []
            if line.strip():
                block.append(line)
        want.append("\n".join(block))
        assert chunking._blocks(text) == [w.strip() for w in want if w.strip()]


def test_markdown_of_nested_columns(spark):
    rows = [({"a": 1, "b": {"c": [1, None, 3], "d": True}, "e": [{"f": "x", "g": [["p"], []]}, {"f": None, "g": None}]},), ({"a": None, "b": None, "e": []},)]
    df = spark.createDataFrame(rows, "r struct<a:int,b:struct<c:array<int>,d:boolean>,e:array<struct<f:string,g:array<array<string>>>>>")
    got = [x.t for x in df.select(reports.markdown_of(F.col("r"), df.schema["r"].dataType).alias("t")).collect()]
    assert got == [reports.as_markdown(r[0]) for r in rows]


def test_settings_of_each_row(spark):
    r = random.Random(3)

    def settings(depth):
        return {k: settings(depth - 1) if depth and r.random() < 0.5 else r.choice([1, None, "é", [1, 2], {}]) for k in r.sample("abcde", r.randint(0, 4))}

    def plain(default, user):
        out = dict(default)
        for k, v in user.items():
            out[k] = plain(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
        return out

    pairs = [(settings(3), settings(3)) for _ in range(80)]
    rows = [(json.dumps(a), json.dumps(b)) for a, b in pairs] + [(None, "no json"), ("[1]", '{"a": 1}')]
    got = [json.loads(x.m) for x in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(answers.merged_settings(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [plain(a, b) for a, b in pairs] + [{}, {"a": 1}]
