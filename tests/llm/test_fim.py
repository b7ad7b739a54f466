"""Fill-in-the-middle against a plain model, SQL and the exact round trip."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import fim, queries

from ..oracle import connect, duck_rows, spark_rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def model(doc_id, text, rate=100, suffix_first=50, seed=7):
    """(n, form, prefix, middle, suffix, output) in plain Python."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < suffix_first:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def cases():
    r = random.Random(13)
    texts = [None, "", "\n", "\n\n\n", "no end", "end\n", "a\nb", "\n<\n<S\nS>\nP>\n<M\n", "x<P>y", "<S>", "a\n<M>\n", "é\n日本\n🙂\r\n\x85   \x0b\n", "w " * 60_000, "l\n" * 60_000]
    texts += ["".join(r.choice(["<", "P", "S", "M", ">", "\n", "é", "🙂", "ab"]) for _ in range(r.randint(1, 40))) for _ in range(300)]
    return [(None if k == 5 else k // 2 * 2 - 9, t) for k, t in enumerate(texts)]


def test_equals_a_plain_model(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for kw in ({}, {"rate": 40}, {"suffix_first": 100, "seed": 11}, {"rate": 0}):
        made = fim.transform(df, **kw)
        got = sorted((tuple(r) for r in made.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", "output").collect()), key=repr)
        assert got == sorted(((i, t, *model(i, t, **kw)) for i, t in rows), key=repr)
        assert made.filter(F.coalesce("text", F.lit("")) != fim.restored(F.col("output"), F.col("form"))).count() == 0


def test_digests(spark):
    rows = cases()
    got = sorted(map(tuple, fim.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = []
    for i, t in rows:
        n, form, p, m, _, out = model(i, t)
        want.append((i, n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(t or "")))
    assert got == sorted(want, key=repr)


def test_query_equals_sql(spark, sf):
    df = queries.queries()["op13_fill_in_middle"](spark, sf)
    names, rows = duck_rows(connect(sf), queries.oracle_sql()["op13_fill_in_middle"])
    assert sorted(df.columns) == names and spark_rows(df) == rows


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a\nb\n", 5, "x", 7, "kept")], "doc_id long, text string, n int, Form string, whole int, cut string")
    row = fim.transform(df).first().asDict()
    assert row["whole"] == 7 and row["cut"] == "kept" and row["n"] == 2 and row["form"] in ("psm", "spm") and set(row) == {"doc_id", "text", "whole", "cut", "n", "form", "prefix", "middle", "suffix", "output"}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digests(empty).collect() == [] and fim.transform(empty).collect() == []


def test_own_units_and_sentinels(spark):
    text = "one two  three\nfour"
    df = spark.createDataFrame([(k, text) for k in range(50)], "doc_id long, text string")
    signs = ("‹pre›", "‹suf›", "‹mid›")
    made = fim.transform(df, units=r"\S+\s*|\s+", sentinels=signs)
    rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"), signs)).collect()
    assert {r.n for r in rows} == {4} and {r.back for r in rows} == {text} and len({r.output for r in rows}) > 10
    for bad in (("<P>", "<P>", "<M>"), ("<P<", "<S>", "<M>"), ("<P>", "[S]", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(df, sentinels=bad)


def test_no_python_in_the_plan(spark, sf):
    plan = queries.queries()["op13_fill_in_middle"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
