"""Many needles in many texts against containment tried one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import evidence, secondpass


def material(seed=5):
    r = random.Random(seed)
    signs = ["a", "b", "ab", "é", "🙂", " ", "日"]
    word = lambda n: "".join(r.choice(signs) for _ in range(n))
    needles = [(word(r.randint(1, 4)), r.randint(1, 40)) for _ in range(120)] + [("", 1), (None, 2), ("same", 3), ("same", 4), ("same", 3)]
    texts = [(k, word(r.randint(0, 25))) for k in range(80)] + [(80, None), (81, ""), (82, "same" * 3), (83, "ab" * 20_000)]
    return needles, texts


@pytest.mark.parametrize("limit", [8 << 20, 200])
@pytest.mark.parametrize("k", [None, 1, 3])
def test_occurring(spark, monkeypatch, limit, k):
    monkeypatch.setattr(evidence, "SHARD_BYTES", limit)
    needles, texts = material()
    got = evidence.occurring(spark.createDataFrame(texts, "text_id long, text string").repartition(3), spark.createDataFrame(needles, "needle string, id int"), k)
    want = []
    for i, text in texts:
        ids = sorted({j for n, j in needles if n and text and n in text})
        want += [(i, j) for j in (ids[:k] if k else ids)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.schema["id"].dataType.simpleString() == "int"


def test_nothing_to_seek(spark):
    texts = spark.createDataFrame([(1, "a")], "text_id long, text string")
    needles = spark.createDataFrame([("a", "x")], "needle string, id string")
    assert [tuple(r) for r in evidence.occurring(texts, needles).collect()] == [(1, "x")]
    assert evidence.occurring(texts, needles.limit(0)).collect() == [] and evidence.occurring(texts.limit(0), needles).collect() == []


def known(spark):
    r = random.Random(9)
    pick = lambda *values: r.choice(values)
    rows = [(k, pick("XSS", " sql ", None, "", "a"), pick("Ab start of a much longer text than that", "b", None, " é "), pick("low", None), "fix", pick("active", "active", "deprecated")) for k in range(60)]
    patterns = spark.createDataFrame(rows, "id long, error_type string, error_description string, severity string, solution string, status string")
    words = ["xss", "SQL", "ab start of a much longer text th", "b", "É", "nothing", "🙂"]
    issues = [(k, " ".join(r.choices(words, k=r.randint(0, 3))) or None, pick("sql scan", "XSS", None, "tool")) for k in range(90)]
    return patterns, spark.createDataFrame(issues, "ord long, description string, source string").repartition(3)


@pytest.mark.parametrize("limit", [8 << 20, 20])
def test_counts_and_evidence_equal_the_plain_rule(spark, monkeypatch, limit):
    monkeypatch.setattr(evidence, "SHARD_BYTES", limit)
    patterns, issues = known(spark)
    hit = secondpass.matches(F.col("error_type"), F.col("error_description"), F.col("description"), F.col("source"))
    pairs = [tuple(r) for r in issues.crossJoin(patterns).filter(hit).select("ord", "id", "status", "severity").collect()]
    counts = {r.id: r.n for r in secondpass.match_counts(patterns, issues).collect()}
    assert counts == {i: sum(j == i for _, j, *_ in pairs) for i in {j for _, j, *_ in pairs}}
    for k, most in ((5, 200), (2, 7), (3, None)):
        active = sorted({j for _, j, status, _ in pairs if status == "active"} | {r.id for r in patterns.filter("status = 'active'").collect()})[:most]
        want = []
        for i in {p[0] for p in pairs}:
            ids = sorted(p[1] for p in pairs if p[0] == i and p[1] in active)[:k]
            want += [(i, n, j) for n, j in enumerate(ids)]
        got = secondpass.text_evidence(issues, patterns, k, most)
        assert sorted((r.issue_ord, r.hit_ord, r.id) for r in got.collect()) == sorted(want)


def test_no_nested_loop(spark, sf):
    from reviewlake import plans

    for name in ("f10_pattern_match", "j01_text_evidence", "r01_evidence"):
        plan = plans.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
