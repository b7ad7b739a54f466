"""Ingest, tasks, second pass, answers and run tracking."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from reviewlake.functions import repair, rules, text, vectors
from reviewlake.operators import dedupe, ingest, ranking, search, secondpass, tasks
from reviewlake.sources import files as file_sources
from reviewlake.streaming import runs


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def cve_tree(root):
    for k, files in enumerate([["a.c", "b.c"], [], None]):
        cve = f"CVE-2020-{k}"
        write(root / f"metadata/{cve}/cve_metadata.json", {"cve_id": cve, "summary": "Bad  input. It breaks 2.6.19 things.", "cwe_id": "CWE-20", "vulnerability_classification": "", "score": "9.8" if k == 0 else 5, "lang": "C", "project": "p"})
        if files is not None:
            write(root / f"metadata/{cve}/c1/commit_metadata.json", {"files": [{"local_name": f, "original_path": f"src/{f}"} for f in files]})
        for f in files or []:
            write(root / f"before/{cve}/c1/{f}", "one\ntwo\nthree")
            if f == "a.c":
                write(root / f"after/{cve}/c1/{f}", "one\nTWO\nTWO\nthree")
    write(root / "after/CVE-2020-9/c1/z.c", "z")


def test_ingest_builder(spark, tmp_path):
    cve_tree(tmp_path)
    cves = ingest.cve_metadata(spark, str(tmp_path / "metadata"), 0, 20)
    assert cves.count() == 3 and ingest.cve_metadata(spark, str(tmp_path / "metadata"), 1, 1).first().cve_id == "CVE-2020-1"
    pattern = ingest.pattern_tasks(cves).orderBy("title").first()
    assert (pattern.title, pattern.error_type, pattern.severity, pattern.tags) == ("CVE-2020-0", "input_validation", "critical", "CWE-20")
    assert pattern.problematic_pattern.endswith("Evidence: Bad input. It breaks 2.6.19 things.")
    issues = ingest.issue_tasks(cves, ingest.commit_files(spark, str(tmp_path / "metadata")), ingest.source_texts(spark, str(tmp_path / "before")), ingest.source_texts(spark, str(tmp_path / "after")), "before", 5)
    got = [(r.folder, r.file_path, r.start_line, r.end_line, r.code_snippet, r.problem_phenomenon, r.root_cause) for r in issues.orderBy("folder", "pos").collect()]
    assert got == [
        ("CVE-2020-0", "src/a.c", 2, 2, "one\nt", "Bad input.", "It breaks 2.6.19 things."),
        ("CVE-2020-0", "src/b.c", 1, 3, "one\nt", "Bad input.", "It breaks 2.6.19 things."),
        ("CVE-2020-1", "", 0, 0, "", "Bad input.", "It breaks 2.6.19 things."),
        ("CVE-2020-2", "", 0, 0, "", "Bad input.", "It breaks 2.6.19 things."),
    ]


def test_structured_ingest_and_reload(spark, tmp_path):
    entry = lambda n: {"pattern": {"title": f"T{n}", "error_type": "dos"}, "instances": [{"session_meta": {"session_id": "s1"}, "issue": {"file_path": f"f{n}", "start_line": n}}]}
    write(tmp_path / "in.json", {"version": "1", "data": [entry(1), entry(2), {"pattern": {"title": "alone"}, "instances": []}]})
    rows = ingest.structured(spark, str(tmp_path / "in.json"))
    assert rows.count() == 3 and rows.filter("i is null").count() == 1
    incoming = rows.select(F.col("entry").alias("ord"), "pattern.*").withColumn("fp", dedupe.pattern_fingerprint())
    existing = incoming.limit(0).withColumn("id", F.lit(1))
    first = dedupe.new_rows(incoming, existing, "fp")
    assert first.count() == 3 and dedupe.new_rows(incoming, first, "fp").count() == 0


def test_delete_scoping(spark):
    m = lambda **k: {a: str(b) for a, b in k.items()}
    rows = [(0, "curated_issue", "delete", m(where="id IN (3, 4)")), (1, "curated_issue", "delete", m(ids="3,4")), (2, "curated_issue", "delete", m()), (3, "issues", "delete-all", m()), (4, "issue", "remove", m(confirm="true", scope="all"))]
    df = spark.createDataFrame(rows, "ord long, target string, action string, data map<string,string>")
    got = {r.ord: r for r in tasks.normalize(df, "s").collect()}
    assert (got[0].action, got[0].data["ids"]) == ("delete_by_ids", "3,4") and got[1].action == "delete_by_ids"
    assert [got[k].action for k in (2, 3, 4)] == ["delete", "delete_all", "delete_all"]
    need = lambda *ords: tasks.needs_confirm(tasks.normalize(df.filter(F.col("ord").isin(*ords)), "s")).first().need_confirm
    assert not need(0, 1) and need(2) and need(3) and not need(4)
    assert tasks.confirmed(df.filter("ord = 2")).first().action == "delete_all"
    assert tasks.confirmed(df.filter("ord = 1")).first().action == "delete"


def test_tasks_run_on_tables(spark):
    table = spark.createDataFrame([(k, "open" if k % 2 else "done") for k in range(6)], "id long, status string").withColumn("created_at", F.lit(0).cast("timestamp"))
    df = spark.createDataFrame([(0, "curated_issue", "delete_by_ids", {"ids": "3,4"})], "ord long, target string, action string, data map<string,string>")
    assert sorted(r.id for r in tasks.run_delete(table, df, "curated_issue").collect()) == [0, 1, 2, 5]
    assert tasks.run_delete(table, df, "issue_pattern").count() == 6
    everything = df.withColumn("action", F.lit("delete_all"))
    assert tasks.run_delete(table, everything, "curated_issue").count() == 0
    assert [r.id for r in tasks.run_query(table, {"status": "open", "limit": "2"}, "curated_issue").collect()] == [5, 3]
    assert tasks.run_query(table, {"issue_id": "4"}, "curated_issue").first().id == 4


def test_fill_and_bind(spark):
    df = spark.createDataFrame([(0, "pattern", "create", {"id": "7", "error_type": "x"}), (1, "issue", "query", {"id": "7"}), (2, "curated_issue", "create", {})], "ord long, target string, action string, data map<string,string>")
    got = {r.ord: r.data for r in tasks.fill(df, "words", "cli").collect()}
    assert got[0]["error_type"] == "x" and "id" not in got[0] and got[0]["error_description"] == "words"
    assert got[1] == {"id": "7"} and got[2]["session_id"] == "cli" and got[2]["severity"] == "medium"
    ids = lambda n: spark.createDataFrame([(n,)], "id long")
    bound = {r.ord: r.data for r in tasks.with_ids(tasks.fill(df, "w", "cli"), ids(11), ids(12)).collect()}
    assert (bound[2]["pattern_id"], bound[2]["session_id"]) == ("11", "12") and "pattern_id" not in bound[0]


def test_validation_messages(spark):
    df = spark.createDataFrame([(0, "bad", "upsert", {}), (1, "issue_pattern", "fly", {"error_type": "x", "solution": " "}), (2, "curated_issue", "upsert", None)], "ord long, target string, action string, data map<string,string>")
    got = [(r.level, r.message) for r in ingest.validate(df).collect()]
    assert ("error", "task[0] invalid target: bad") in got and ("error", "task[1] invalid action: fly") in got
    assert ("error", "task[1] issue_pattern missing solution") in got and ("error", "task[2] data must be dict") in got
    assert not any("error_type" in m for _, m in got)


def test_second_pass_thresholds(spark):
    issues = spark.createDataFrame([(k, 1, "f", "s", "low", k, d, "t", "r") for k, d in enumerate(["plain", "has XSS in it", "c", "d"])], "ord long, requirement_id long, file string, source string, severity string, line long, description string, tool string, run_id string")
    hits = [(0, 0, 1, "xss", "high", 0.77), (1, 0, 1, "xss", "high", 0.9), (2, 0, 1, "xss", "low", 0.78), (3, 0, 1, "xss", "high", 0.78 + 0.06), (3, 1, 2, "dos", "high", 0.839)]
    evidence = spark.createDataFrame(hits, "issue_ord long, hit_ord int, sqlite_id long, error_type string, severity string, similarity double")
    fixed = {r.ord: r for r in secondpass.corrections(issues, evidence).collect()}
    assert [fixed[k].severity for k in range(4)] == ["low", "high", "low", "high"]
    assert [fixed[k].old_severity for k in range(4)] == [None, "low", None, "low"] and fixed[1].source == "s_db_corrected"
    assert [(r.ord, r.hit_ord) for r in secondpass.findings(issues, evidence).collect()] == [(3, 0)]


def test_vector_evidence_ranks_by_distance(spark):
    issues = spark.createDataFrame([(0, "s", "abc"), (1, "s", "abc"), (2, "s", None)], "ord long, source string, description string")
    known = spark.createDataFrame([(k, [float(k + 1), 0.5, 0.1], "t", "high") for k in range(8)], "sqlite_id long, vector array<double>, error_type string, severity string")
    got = secondpass.vector_evidence(issues, known, 5)
    assert {r.issue_ord: r["count"] for r in got.groupBy("issue_ord").count().collect()} == {0: 5, 1: 5}
    first = got.filter("issue_ord = 0").orderBy("hit_ord").collect()
    assert [r.distance for r in first] == sorted(r.distance for r in first)


def test_nearest_equals_the_plain_expression(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("sqlite_id"), F.col("embedding").cast("array<double>").alias("vector")).limit(60)
    q = rows.filter("sqlite_id % 7 = 0").withColumnRenamed("sqlite_id", "query_id")
    pairs = q.withColumnRenamed("vector", "a").crossJoin(rows).select("query_id", "sqlite_id", F.round(vectors.cosine_distance(F.col("a"), F.col("vector")), 6).alias("d"))
    want = ranking.first_per(pairs, ["query_id"], ["d", "sqlite_id"], 4)
    key = lambda rows: sorted((r.query_id, r.sqlite_id) for r in rows)
    assert key(search.nearest(q, rows, 4).collect()) == key(want.collect())
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "sqlite_id long, vector array<double>")
    assert search.nearest(zero.withColumnRenamed("sqlite_id", "query_id"), zero, 3).count() == 0


def test_severity_and_text_rules(spark):
    df = spark.createDataFrame([("9.0",), ("8.99",), ("4",), ("x",), (None,), ("NaN",)], "s string")
    assert [r[0] for r in df.select(rules.score_severity(F.col("s"))).collect()] == ["critical", "high", "medium", "medium", "medium", "low"]
    df = spark.createDataFrame([(" a\u3000b\n c ",), (None,), ("src/a b.py",), ("//",)], "s string")
    assert [r[0] for r in df.select(text.normalize_text(F.col("s"))).collect()][:2] == ["a b c", ""]
    assert [r[0] for r in df.select(text.sanitize_path(F.col("s"))).collect()][2:] == ["src_a_b.py", "unknown_file"]


def test_answers(spark):
    ask = lambda t: repair.tasks_in(t)
    assert ask('```json\n[{"a": 1,}]\n```') == [{"a": 1}]
    assert ask('text [{"a": 1}, {"b": 2}] more') == [{"a": 1}, {"b": 2}]
    assert ask('[{"a": [1, 2]}') == [{"a": [1, 2]}]
    assert ask("{'a': 'b'}") == [{"a": "b"}]
    assert ask('say {"a": {"b": 1}') == [{"a": {"b": 1}}] and ask("nothing") == [] and ask("") == []
    plan = repair.plan_in('well {"intent": "code", "code_analysis_tasks": [{"target_path": "/x"}, {}], "explanation": "e"} ok')
    assert plan == {"intent": "code", "targets": ["/x"], "explanation": "e"}
    assert repair.plan_in('{"intent": "db", "code_analysis_tasks": [{"target_path": "/x"}]}')["targets"] == []
    assert repair.plan_in('broken "intent": "DB" here')["intent"] == "db" and repair.plan_in("")["intent"] == ""
    assert repair.path_slashes('{"target_path": "E:\\AAA\\b"}') == '{"target_path": "E:/AAA/b"}'
    df = spark.createDataFrame([('x {"llm_security_score": 8.1, "confidence": 0.78}',), ('{"llm_security_score": 99}',), ("no",), (None,)], "t string")
    got = [tuple(r.r) for r in df.select(repair.rating(F.col("t")).alias("r")).collect()]
    assert got == [(True, 8.1, 0.78), (True, 10.0, 0.0), (False, None, 0.0), (False, None, 0.0)]
    assert [r[0] for r in df.select(F.size(repair.task_list(F.col("t")))).collect()] == [1, 1, 0, 0]


def replay(state, messages):
    """Plain model of the run tracker: messages of one run in order, and what they bring about."""
    out = []
    for m in messages:
        run = m["run_id"]
        if m["message_type"] == "run_init":
            state["expected"] |= set(m["requirement_ids"] or [])
            continue
        key = m["requirement_id"]
        seen = state["requirements"].setdefault(key, {"types": set(), "reported": 0, "issues": 0})
        if m["analysis_type"] == "static_analysis":
            seen["issues"] = m["issue_count"]
        seen["types"].add(m["analysis_type"])
        if "static_analysis" in seen["types"] and len(seen["types"]) > seen["reported"]:
            seen["reported"] = len(seen["types"])
            out.append((run, "report", key, ",".join(sorted(seen["types"])), seen["issues"], None, None, m["ord"]))
            if "ai_analysis" in seen["types"] and key not in state["completed"]:
                state["completed"].add(key)
                state["issues"] += seen["issues"]
                if not state["closed"] and state["expected"] and state["expected"] == state["completed"]:
                    state["closed"] = True
                    out.append((run, "run_completed", None, None, state["issues"], len(state["expected"]), len(state["completed"]), m["ord"]))
    return out


def messages(seed, n=40):
    random.seed(seed)
    out = []
    for k in range(n):
        run = f"r{random.randint(0, 2)}"
        if random.random() < 0.15:
            out.append((run, k, "run_init", None, sorted(random.sample(range(3), random.randint(1, 3))), None, None))
        else:
            out.append((run, k, "analysis_result", random.randint(0, 2), None, random.choice(["static_analysis", "ai_analysis", "security_analysis", "performance_analysis"]), random.randint(0, 5)))
    return out


MESSAGES = "run_id string, ord long, message_type string, requirement_id long, requirement_ids array<long>, analysis_type string, issue_count long"


def replayed(data):
    want = []
    for run in sorted({m[0] for m in data}):
        own = [dict(zip([c.split()[0] for c in MESSAGES.split(", ")], m, strict=True)) for m in data if m[0] == run]
        want += replay({"expected": set(), "completed": set(), "issues": 0, "closed": False, "requirements": {}}, own)
    return sorted(map(str, want))


def test_run_tracking_in_batch(spark):
    for seed in range(4):
        data = messages(seed)
        got = [tuple(r) for r in runs.run_events_batch(spark.createDataFrame(data, MESSAGES).repartition(3)).collect()]
        assert sorted(map(str, got)) == replayed(data), seed


def test_run_tracking_on_a_stream_with_restarts(spark, tmp_path):
    """State outlives micro-batches and restarts; late results renew reports, never the summary."""
    data = messages(12, 80)
    for part in range(5):
        spark.createDataFrame(data[part * 16 : part * 16 + 16][::-1], MESSAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if part in (1, 4):  # two starts of two and three batches
            stream = runs.run_events(spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
            assert runs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"), 120)
    events = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(str(tuple(r)) for r in events.collect()) == replayed(data)
    assert events.filter("event = 'run_completed'").groupBy("run_id").count().filter("count > 1").isEmpty()
    late = runs.late_reports(events).collect()
    closed = {r.run_id: r.ord for r in events.filter("event = 'run_completed'").collect()}
    assert late and all(r.ord > closed[r.run_id] for r in late)


def names_of(df):
    return sorted(r.path.rsplit("/", 1)[1] for r in df.collect())


def test_file_sources(spark, tmp_path):
    for name in ("a/x.py", "a/y.txt", "a/w.rb", "a/q.cs", "a/v.PY", "node_modules/z.py", "env/e.py", "target/t.py", "b/login.md", "b/c.js", "b/h.hxx"):
        write(tmp_path / name, "content " + name)
    found = file_sources.source_tree(spark, str(tmp_path))
    assert names_of(found) == ["c.js", "t.py", "w.rb", "x.py"]
    every = file_sources.read_texts(spark, str(tmp_path))
    assert names_of(file_sources.security_files(every)) == ["c.js", "e.py", "login.md", "t.py", "v.PY", "x.py", "z.py"]
    assert names_of(file_sources.quality_files(every)) == ["c.js", "e.py", "h.hxx", "q.cs", "t.py", "v.PY", "x.py", "z.py"]
    assert file_sources.reports(spark, str(tmp_path), "b").count() == 3
    paths = spark.createDataFrame([("/x/run7/consolidated/consolidated_a.json",), ("/x/consolidated_req_3_run9.json",), ("/x/other.json",)], "path string")
    assert sorted(r.run_id for r in file_sources.consolidated(paths).collect()) == ["run7", "run9"]


def test_readers_look_at_the_first_files_and_try_gbk(spark, tmp_path):
    """Names are judged after the first fifteen files were taken; folders follow until there is enough."""
    for k in range(20):
        write(tmp_path / f"a/f{k:02d}.{'md' if k < 12 else 'py'}", f"# {k}")
        write(tmp_path / f"b/g{k:02d}.c", "int x;")
        write(tmp_path / f"c/h{k:02d}.c", "int y;")
    (tmp_path / "a" / "f12.py").write_bytes("名字 = 1".encode("gbk"))
    (tmp_path / "a" / "f13.py").write_bytes(b"\xff\xff\xff")
    every = file_sources.read_texts(spark, str(tmp_path))
    assert every.filter("path like '%f13.py'").count() == 0
    got = {r.path.rsplit("/", 1)[1]: r.content for r in file_sources.security_files(every).collect()}
    assert sorted(got) == ["f12.py", "f14.py", "f15.py", *(f"g{k:02d}.c" for k in range(15))] and "名字" in got["f12.py"]
    quality = {r.path.rsplit("/", 1)[1]: r.content for r in file_sources.quality_files(every).collect()}
    assert len(quality) == 3 + 15 + 15
    assert quality["f12.py"] == "\n# File: f12.py (.py)\n# Language: python\n名字 = 1\n"
    assert quality["g00.c"].startswith("\n# File: g00.c (.c)\n# Path: file:") and quality["g00.c"].endswith("/b/g00.c\n# Language: c\nint x;\n")
    long = every.withColumn("content", F.repeat("content", F.lit(1000)))
    assert {r.folder[-1] for r in file_sources.quality_files(long).collect()} == {"a", "b"}


def test_cache_replay(spark):
    """Least recently used goes first; a null cache name is a cache, a null key a key; an empty log gives none."""
    keys = ["a", "b", "a", "c", "b", None, None, "a"]
    df = spark.createDataFrame([(name, k, key) for name in ("x", None) for k, key in enumerate(keys)], "cache string, ord long, key string").repartition(3)
    got = runs.cache_replay(df, 2).collect()
    for name in ("x", None):
        assert [r.hit for r in sorted((r for r in got if r.cache == name), key=lambda r: r.ord)] == [False, False, True, False, False, False, True, False]
    assert runs.cache_replay(df.limit(0), 2).count() == 0
