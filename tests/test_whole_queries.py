"""Queries over whole tables, against plain Python."""

from __future__ import annotations

from collections import Counter, defaultdict

from reviewlake import plans
from reviewlake.operators import ingest, lines, tasks, toolparse
from reviewlake.plans.code import tool_outputs
from reviewlake.plans.knowledge import raw_tasks
from reviewlake.sources import tables

Q = plans.queries()


def test_every_bottleneck_in_order(spark, sf):
    files = tables.files(spark, sf)
    found = defaultdict(set)
    for rank, (score, part) in enumerate(((6.0, lines.nested_loops(files)), (5.0, lines.python_recursion(files)), (3.0, lines.io_operations(files)))):
        for r in part.select("file_id", "line_number").collect():
            found[r.file_id].add((-score, rank, r.line_number))
    # a line may hold several loops or recursions, which are rows of their own
    got = defaultdict(list)
    for r in Q["t04_bottleneck_order"](spark, sf).orderBy("file_id", "position").collect():
        rank = ("nested_loop", "recursion", "io_operation").index(r.type)
        got[r.file_id].append((-r.severity_score, rank, r.line_number))
    assert got.keys() == found.keys() and len({i % 5 for i in got}) > 1
    for i, rows in got.items():
        assert rows == sorted(rows) and len(rows) <= 10
        assert list(dict.fromkeys(rows)) == sorted(found[i])[: len(set(rows))] and (len(rows) == 10 or set(rows) == found[i])


def test_whole_static_scan(spark, sf):
    count, tools = defaultdict(Counter), set()
    for r in lines.style_check(tables.files(spark, sf)).select("file_id", "severity").collect():
        count[r.file_id][r.severity] += 1
    for r in toolparse.all_issues(tool_outputs(spark, sf)).select("file_id", "severity").collect():
        count[r.file_id][r.severity] += 1
        tools.add(r.file_id)
    got = {r.file_id: r for r in Q["c31_static_scan"](spark, sf).collect()}
    assert got.keys() == count.keys() and tools and len({i % 5 for i in got}) == 5
    for i, r in got.items():
        assert r.total_issues == sum(count[i].values()) and r.has_security_issues == (i in tools)
        assert all(r[s] == count[i][s] for s in ("critical", "high", "medium", "low"))


def test_every_pattern_matches(spark, sf):
    texts = [(r.text or "").strip().lower() for r in tables.table(spark, sf, "documents").select("text").collect()]
    want = {}
    for r in tables.table(spark, sf, "benchmark").select("item_id", "text").collect():
        start = (r.text or "").strip(" ").lower()[:32]
        want[r.item_id] = sum((start != "" and start in t) or "the and" in t for t in texts)
    assert {r.item_id: r.n for r in Q["f10_pattern_match"](spark, sf).collect()} == {k: n for k, n in want.items() if n}


def test_fields_of_every_task(spark, sf):
    raw = {r.ord: r for r in raw_tasks(spark, sf).collect()}
    got = {r.ord: r for r in Q["f08_field_whitelist"](spark, sf).collect()}
    assert got.keys() == raw.keys()
    for i, r in got.items():
        kept = set(raw[i].data)
        if r.target in tasks.FIELDS:
            kept &= {*tasks.FIELDS[r.target], *tasks.CONTROL}
        if r.target == "review_session" and r.action in ("create", "update", "upsert"):
            kept.add("session_id")
        if r.action == "delete_by_ids":
            assert kept - {"where"} <= set(r["keys"].split(","))
        else:
            assert r["keys"] == ",".join(sorted(kept)), r


def test_every_pattern_task_is_completed(spark, sf):
    n = sum(r.target == "pattern" for r in raw_tasks(spark, sf).collect())
    assert n > 3 and {r.target: r.n for r in Q["u05_complete_tasks"](spark, sf).collect()} == {"issue_pattern": n, "review_session": 1, "curated_issue": 1}


def test_validation_of_every_task(spark, sf):
    rows = tasks.normalize(raw_tasks(spark, sf), "s").collect()
    want = Counter()
    for r in rows:
        at, data = f"task[{r.ord}] ", dict(r.data)
        blank = lambda key: not (data.get(key) or "").strip()  # noqa: B023, E731
        if r.target not in ("issue_pattern", "curated_issue", "review_session"):
            want[r.ord, "error", f"{at}invalid target: {r.target}"] += 1
        if r.action not in ingest.ACTIONS:
            want[r.ord, "error", f"{at}invalid action: {r.action}"] += 1
        if r.target == "issue_pattern":
            want.update((r.ord, "error", f"{at}issue_pattern missing {k}") for k in ingest.REQUIRED if blank(k))
        if r.target == "curated_issue":
            want.update((r.ord, "warning", f"{at}curated_issue weak field {k}") for k in ingest.WEAK if blank(k))
    got = Counter(tuple(r) for r in Q["f12_validation"](spark, sf).select("ord", "level", "message").collect())
    assert got == want and {level for _, level, _ in got} == {"error", "warning"}


def test_every_vector_asks_for_its_neighbours(spark, sf):
    ids = {r.sqlite_id for r in tables.vectors(spark, sf).select("sqlite_id").collect()}
    got = Counter(r.query_id for r in Q["t06_knn"](spark, sf).collect())
    assert got.keys() == ids and set(got.values()) == {10} and any(i % 20 for i in ids)
