"""Bytes that the tree scan reads."""

from __future__ import annotations

from reviewlake.sources import files


def scan_metrics(df):
    """Metrics of the file scan of an executed query."""
    found = {}

    def walk(plan):
        if plan.nodeName().startswith("Scan"):
            keys = plan.metrics().keysIterator()
            while keys.hasNext():
                k = keys.next()
                found[k] = plan.metrics().apply(k).value()
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_only_kept_files_are_read(spark, tmp_path):
    sizes = {"a/m.py": 10, "b c/n m.c": 20, "node_modules/x/y.js": 100_000, "a/__pycache__/m.py": 50_000, "a/z.bin": 200_000, "env/k.py": 70_000, "a/environment/k.go": 30, "ä/ö.py": 40, "a/M.PY": 5_000}
    for name, size in sizes.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    df = files.source_tree(spark, str(tmp_path))
    rows = df.collect()
    kept = {"a/m.py", "b c/n m.c", "a/environment/k.go", "ä/ö.py"}
    assert {r.path.split(str(tmp_path) + "/")[1] for r in rows} == kept
    metrics = scan_metrics(df)
    assert metrics["numFiles"] == 4 and metrics["filesSize"] == sum(sizes[k] for k in kept)
