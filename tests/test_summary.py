"""Category results, ranking, trends, plans and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.operators import aggregate, dedupe, ranking, reports

ITEM = "array<struct<type:string,severity:string,count:bigint>>"


def results(spark):
    rows = [
        ("code_quality", 85.0, [("naming", "medium", 3), ("complexity", "high", 1)], None, None),
        ("security", 78.0, None, [("sql_injection", "high", 1), ("hardcoded_secrets", "medium", 2)], None),
        ("performance", 72.0, None, None, [("algorithm", "high", 2), ("memory", "low", 3)]),
    ]
    return spark.createDataFrame(rows, f"category string, score double, issues {ITEM}, vulnerabilities {ITEM}, bottlenecks {ITEM}")


def test_category_results(spark):
    got = {r.category: r for r in aggregate.aggregate_categories(results(spark)).collect()}
    assert {r.overall_score for r in got.values()} == {78.33}
    assert [got[c].issue_count for c in ("code_quality", "security", "performance")] == [4, 3, 5]
    assert [c for c, r in got.items() if r.recommendation] == ["performance"]


def test_priority_order_is_stable(spark):
    rows = [(k, s) for k, s in enumerate(["critical", "high", "medium", "low", "critical", "odd", None])]
    got = ranking.prioritize(spark.createDataFrame(rows, "ord long, severity string").repartition(3)).collect()
    assert [(r.ord, r.severity) for r in got] == [(0, "critical"), (4, "critical"), (1, "high"), (2, "medium"), (3, "low"), (6, None), (5, "odd")]


def test_trend(spark):
    rows = [(1, k, s, i) for k, (s, i) in enumerate([(70, 20), (75, 18), (78, 15), (82, 12)])] + [(2, 0, 0, 3)]
    got = {r.g: r for r in aggregate.trends(spark.createDataFrame(rows, "g long, ord long, overall_score long, issues long"), "g").collect()}
    assert (got[1].score_trend, got[1].issues_trend, got[1].improvement_rate) == ("improving", "decreasing", 17.14)
    assert (got[2].score_trend, got[2].issues_trend, got[2].improvement_rate) == ("stable", "stable", 0.0)


def test_correlations(spark):
    wide = spark.createDataFrame([(1, 5, "high", 3, 75), (2, 0, "high", 3, 90), (3, None, None, None, None)], "id long, complexity_issues long, memory_usage string, vulnerabilities long, maintainability_score long")
    assert [(r.id, r.impact) for r in aggregate.correlations(wide).orderBy("id", "impact").collect()] == [(1, "high"), (1, "medium")]


def test_action_plan_takes_five_of_each(spark):
    rows = [(k, s) for k, s in enumerate(["high"] * 4 + ["critical"] * 3 + ["medium"] * 6 + ["info", "low", "odd"])]
    got = ranking.action_plan(spark.createDataFrame(rows, "ord long, severity string")).collect()
    immediate = sorted((r.position, r.ord) for r in got if r.bucket == "immediate_actions")
    assert immediate == [(1, 4), (2, 5), (3, 6), (4, 0), (5, 1)]
    assert sorted(r.ord for r in got if r.bucket == "long_term_improvements") == [13, 14]


def test_caps_and_report(spark):
    rows = [(k, "quality" if k % 2 else "style", None, f"m{k}", "r1", 1) for k in range(120)]
    issues = spark.createDataFrame(rows, "ord long, source string, severity string, description string, run_id string, requirement_id long")
    kept = ranking.capped(issues, "requirement_id")
    assert {r.source: r["count"] for r in kept.groupBy("source").count().collect()} == {"quality": 50, "style": 30}
    report = reports.consolidated(kept, "requirement_id").first()
    assert report.issue_count == 80 and report.severity_stats == {"low": 80}
    assert [i.ord for i in report.issues] == sorted(i.ord for i in report.issues)


def test_dedupe_first_wins_whatever_the_partitions(spark):
    rows = [(k, d, s, n) for k, (d, s, n) in enumerate([("A", "x", 1), (" a ", "X", 1), ("a", "x", 2), ("a", "x", None), ("A", "x", 0), (None, None, None)])]
    for n in (1, 8):
        got = dedupe.dedupe_issues(spark.createDataFrame(rows, "ord long, description string, source string, line long").repartition(n)).collect()
        assert sorted(r.ord for r in got) == [0, 2, 3, 5]


def test_vulnerabilities_most_severe_wins_and_keeps_its_place(spark):
    rows = [(0, "x", "l", "d", "low"), (1, "y", "l", "d", "critical"), (2, "X", "l", " d", "high"), (3, "y", "L", "D", "critical")]
    got = dedupe.dedupe_vulnerabilities(spark.createDataFrame(rows, "ord long, type string, location string, description string, severity string")).collect()
    # " d" keeps its inner blank: another key
    assert [r.ord for r in got] == [1, 2, 0]


def test_merge_plans_against_a_plain_model(spark):
    import random
    import re

    random.seed(4)
    ranks = dedupe.VULNERABILITY_RANK
    cats = dedupe.PLAN_CATEGORIES
    rows = [(p, random.choice(cats), k, random.choice("ab"), random.choice(["d", "D ", "e"]), "r", random.choice(list(ranks)), random.choice(["", "x"]), random.choice(["", "l"]), "") for p in range(3) for k in range(30)]
    columns = ["plan_id", "category", "pos", *dedupe.PLAN_FIELDS]

    def model(items):
        seen = {}
        for it in sorted(items, key=lambda r: (cats.index(r["category"]), r["pos"])):
            key = re.sub(r"\s+", " ", f"{it['type']}|{it['description']}|{it['recommendation']}".strip().lower())
            old = seen.get(key)
            if old is None:
                seen[key] = dict(it)
                continue
            win, lose = (it, old) if ranks[it["priority"]] > ranks[old["priority"]] else (old, it)
            seen[key] = {**win, **{f: win[f] or lose[f] for f in ("expected_effect", "location", "reason")}}
        out = []
        for c in cats:
            mine = sorted((x for x in seen.values() if x["category"] == c), key=lambda x: -ranks[x["priority"]])[:5]
            out += [(x["plan_id"], c, n + 1, x["type"], x["description"], x["priority"], x["expected_effect"], x["location"]) for n, x in enumerate(mine)]
        return out

    dicts = [dict(zip(columns, r, strict=True)) for r in rows]
    want = sorted(x for p in range(3) for x in model([d for d in dicts if d["plan_id"] == p]))
    for n in (1, 5):
        df = spark.createDataFrame(rows, "plan_id long, category string, pos long, " + ", ".join(f"{f} string" for f in dedupe.PLAN_FIELDS)).repartition(n)
        got = sorted((r.plan_id, r.category, r.position, r.type, r.description, r.priority, r.expected_effect, r.location) for r in dedupe.merge_plans(df).collect())
        assert got == want


def test_remediation_once_across_buckets(spark):
    fixes = spark.createDataFrame([(1, 0, "short_term_fixes", "Fix A"), (1, 1, "immediate_actions", "fix  a"), (1, 2, "long_term_improvements", "b"), (1, 3, "long_term_improvements", "")], "plan_id long, ord long, bucket string, fix string")
    hard = spark.createDataFrame([(1, 0, "c", "FIX A"), (1, 1, "c", "new"), (1, 2, "c", "New")], "plan_id long, ord long, category string, recommendation string")
    kept, advice = dedupe.dedupe_remediation(fixes, hard)
    assert sorted(r.ord for r in kept.collect()) == [1, 2]
    assert [r.ord for r in advice.collect()] == [1]


def test_csv_and_json_exports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "target string, z long, c string")
    reports.export_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/target=a")).columns == ["c", "z"]
    reports.export_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    reports.write_run_reports(rows.withColumn("run_id", F.lit("r1")), str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs/run_id=r1")).count() == 2
    assert reports.as_markdown({"a": {"b": 1, "c": [1, 2]}}).splitlines() == ["# a", "- **b**: 1", "## c", "- 1", "- 2"]
    assert "| z" in reports.table_text(rows, "other")
    assert sorted((r.part, r.line) for r in reports.table_lines(rows, "other").select("part", "line").collect()) == [(min(k, 2), line) for k, line in enumerate(reports.table_text(rows, "other").splitlines())]
    assert reports.table_lines(rows.limit(0), "other").count() == 2


def test_pages_of_a_bulk_delete(spark):
    from reviewlake.operators import store

    for n, want in ((0, []), (1, [1]), (100, [100]), (101, [100, 1]), (250, [100, 100, 50])):
        assert [r.n for r in store.delete_pages(spark.range(n)).orderBy("page").collect()] == want


def test_merge_plans_runs_without_python_groups(spark):
    df = spark.createDataFrame([(1, dedupe.PLAN_CATEGORIES[0], 0, *["x"] * len(dedupe.PLAN_FIELDS))], "plan_id long, category string, pos long, " + ", ".join(f"{f} string" for f in dedupe.PLAN_FIELDS))
    assert "InPandas" not in dedupe.merge_plans(df)._jdf.queryExecution().executedPlan().toString()
