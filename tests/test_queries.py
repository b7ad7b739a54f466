"""Every query that SQL can express against DuckDB on the smallest tables; the others must run."""

from __future__ import annotations

import pytest

from reviewlake import plans

from .oracle import connect, duck_rows, spark_rows

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names, rows = duck_rows(duck, SQL[name])
    assert sorted(df.columns) == names
    assert spark_rows(df) == rows


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and [r["severity_rank"] for r in rows] == sorted(r["severity_rank"] for r in rows)
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_import_without_corpus_operators(tmp_path):
    """The entry module must import when the optional subpackage and its pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "reviewlake", tmp_path / "reviewlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a01_severity_counts' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": f"{tmp_path}:{':'.join(p for p in sys.path if 'site-packages' in p or 'pyspark' in p)}"})


def test_nothing_else_imports_corpus_operators():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "reviewlake"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|\bllm import", p.read_text()), p
