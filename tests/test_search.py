"""Exact nearest neighbours: cells and bounds against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.operators import search

VECTORS = "sqlite_id long, vector array<double>"


def brute(queries, rows, k, exclude_self):
    """k nearest by rounded cosine distance, ties by id."""
    kept = [(i, np.array(v)) for i, v in rows if v is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    ids = np.array([i for i, _ in kept])
    m = np.array([v for _, v in kept])
    out = {}
    for i, v in queries:
        if v is None or not np.isfinite(v).all() or not np.linalg.norm(v) > 0:
            continue
        d = np.round(1 - m @ np.array(v) / (np.linalg.norm(m, axis=1) * np.linalg.norm(v)), 6)
        order = [n for n in np.lexsort((ids, d)) if not (exclude_self and ids[n] == i)][:k]
        out[i] = [(round(float(d[n]) + 0.0, 6), int(ids[n])) for n in order]
    return out


def found(df):
    return {r.query_id: [(round(h.distance + 0.0, 6), h.id) for h in r.hits] for r in df.collect()}


def clustered(r, n, dim, groups, spread):
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [(k, [c + r.gauss(0, spread) for c in r.choice(centres)]) for k in range(n)]


@pytest.mark.parametrize(("cell", "cut"), [(512, 4096), (20, 15), (3, 2)])
def test_equals_brute_force(spark, monkeypatch, cell, cut):
    monkeypatch.setattr(search, "CELL_ROWS", cell)
    monkeypatch.setattr(search, "SLICE_ROWS", cut)
    r = random.Random(7)
    shapes = {
        "lattice with ties, zeros and repeats": [(k, [float(r.randint(-2, 2)) for _ in range(4)]) for k in range(400)],
        "clusters": clustered(r, 600, 8, 12, 0.05),
        "nothing alike": clustered(r, 200, 16, 200, 0.0),
        "a third one vector": [(k, [1.0, 2.0, 3.0] if k % 3 == 0 else [r.random(), r.random(), r.random()]) for k in range(300)],
        "nulls and no numbers": [(1, None), (2, [float("nan"), 1.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [float("inf"), 1.0]), (6, [0.0, 2.0])],
    }
    for name, rows in shapes.items():
        vectors = spark.createDataFrame(rows, VECTORS).repartition(5)
        asked = rows[::4] if len(rows) > 10 else rows
        queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
        for k, own in ((5, True), (1, False)):
            got = search.search(queries, vectors, k, exclude_self=own)
            assert found(got) == brute(asked, rows, k, own), (name, k)


def test_bounds_leave_cells_unvisited(spark, monkeypatch):
    monkeypatch.setattr(search, "CELL_ROWS", 20)
    r = random.Random(3)
    rows = clustered(r, 2000, 6, 40, 0.02)
    got = search.search(spark.createDataFrame(rows[::10], "query_id long, vector array<double>"), spark.createDataFrame(rows, VECTORS), 5, exclude_self=True)
    assert found(got) == brute(rows[::10], rows, 5, True)
    work = got.agg(F.avg("visited").alias("visited"), F.max("cells").alias("cells"), F.avg("compared").alias("compared")).first()
    assert work.cells > 50 and work.visited < work.cells / 4 and work.compared < len(rows) / 4


def test_vectors_are_not_moved_again_for_queries(spark, monkeypatch):
    """The packed side of the rounds' join reads the cached cells without another exchange."""
    r = random.Random(1)
    rows = clustered(r, 300, 4, 10, 0.1)
    index = search.Cells.of(spark.createDataFrame(rows, VECTORS))
    asked = spark.createDataFrame([(0, 0, [1], [1.0])], search._VISIT)
    monkeypatch.setattr(search, "SLICE_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = asked.join(index.packed, ["cell", "slice"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan.index("InMemoryTableScan")
    above = plan[:scan].splitlines()[-4:]
    assert not any("Exchange" in line for line in above), plan
    index.packed.unpersist()


def test_visits_are_shuffled_whatever_their_estimated_size(spark, monkeypatch, tmp_path):
    """Each query visits many cells, so the visits outgrow the estimate that Spark makes from the queries."""
    r = random.Random(5)
    spark.createDataFrame(clustered(r, 300, 4, 10, 0.1), VECTORS).write.parquet(f"{tmp_path}/v")
    rows = spark.read.parquet(f"{tmp_path}/v")
    joins, least = [], search._least

    def kept(met, k):
        plan = met._jdf.queryExecution().sparkPlan().toString().splitlines()
        joins.append(next(line for line in plan if "Join" in line))
        return least(met, k)

    monkeypatch.setattr(search, "CELL_ROWS", 20)
    monkeypatch.setattr(search, "_least", kept)
    assert search.nearest(rows.withColumnRenamed("sqlite_id", "query_id"), rows, 3, exclude_self=True).count() == 900
    assert joins and all("SortMergeJoin" in j for j in joins), joins


def test_empty_sides_and_repeated_runs(spark):
    rows = spark.createDataFrame([(k, [float(k + 1), 1.0]) for k in range(30)], VECTORS)
    asked = rows.withColumnRenamed("sqlite_id", "query_id")
    assert search.nearest(asked, rows.limit(0), 5).count() == 0 and search.nearest(asked.limit(0), rows, 5).count() == 0
    one, two = (sorted(map(tuple, search.nearest(asked, rows.repartition(n), 3, exclude_self=True).collect())) for n in (1, 7))
    assert one == two and len(one) == 90


@pytest.mark.parametrize("shape", ["clusters", "nothing alike", "copies"])
def test_cells_travel_in_groups(spark, monkeypatch, shape):
    """Several cells in each of several groups, asked by every row, against brute force; a query's cells of a group are one visit."""
    monkeypatch.setattr(search, "CELL_ROWS", 20)
    monkeypatch.setattr(search, "GROUP_BYTES", 8 * 6 * 100)
    r = random.Random(11)
    rows = clustered(r, 700, 6, {"clusters": 25, "nothing alike": 700, "copies": 3}[shape], {"clusters": 0.1, "nothing alike": 1.0, "copies": 0.0}[shape])
    vectors = spark.createDataFrame(rows, VECTORS).repartition(3)
    index = search.Cells.of(vectors)
    sizes = [index.count[index.group == g].sum() for g in np.unique(index.group[index.group >= 0])]
    assert sum(sizes) == len(rows) and all(n <= 100 or (index.group == g).sum() == 1 for n, g in zip(sizes, np.unique(index.group[index.group >= 0]), strict=True))
    assert shape == "copies" or 5 < len(sizes) < (index.count > 0).sum() / 2
    index.packed.unpersist()
    assert found(search.search(spark.createDataFrame(rows, "query_id long, vector array<double>"), vectors, 10, exclude_self=True)) == brute(rows, rows, 10, True)
