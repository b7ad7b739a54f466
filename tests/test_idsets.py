"""Id sets as bitmaps against Python sets."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from reviewlake.operators import idsets
from reviewlake.streaming import runs


def test_sets_of_ids(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([r.randint(-70_000, 70_000), 0, 32_768, 32_769, None, 1 << 40]), r.random() < 0.5) for _ in range(3000)]
    df = spark.createDataFrame(rows, "run_id string, n long, even boolean").repartition(4)
    maps = idsets.bitmaps(df, ["run_id"], "n", one=F.col("even"), two=~F.col("even"), any=F.lit(True))
    got = {x.run_id: (x.one, x.two, x.any) for x in idsets.sizes(maps, ["run_id"], "one", "two", "any").collect()}
    for run in ("a", "b", None):
        one, two = ({n for g, n, e in rows if g == run and e is want and n is not None} for want in (True, False))
        assert got[run] == (len(one), len(two), len(one | two))
    both = idsets.merged(maps.select("run_id", "bucket", F.col("one").alias("x")).unionByName(maps.select("run_id", "bucket", F.col("two").alias("x"))), ["run_id"], "x")
    assert {x.run_id: x.x for x in idsets.sizes(both, ["run_id"], "x").collect()} == {k: v[2] for k, v in got.items()}
    assert {x.run_id: x.equal for x in idsets.equal_sets(maps, ["run_id"], "any", "any").collect()} == dict.fromkeys(("a", "b", None), True)
    assert not any(x.equal for x in idsets.equal_sets(maps, ["run_id"], "one", "two").collect())


def test_completion_of_a_run_of_a_million_requirements(spark):
    n = 1_000_000
    told = spark.range(1, n + 1).select(F.lit("big").alias("run_id"), F.col("id").alias("requirement_id"))
    told = told.unionByName(spark.createDataFrame([("same", 1), ("same", 1), ("less", 1), ("less", 2), ("none", 5), ("null", None)], "run_id string, requirement_id long"))
    done = told.filter("requirement_id != 777777 and run_id in ('big', 'same')").unionByName(spark.createDataFrame([("less", 1), ("same", 1), ("more", 4)], "run_id string, requirement_id long"))
    assert {r.run_id: r.complete for r in runs.completed_runs(told, done).collect()} == {"big": False, "same": True, "less": False, "none": False}
    assert {r.run_id: r.complete for r in runs.completed_runs(told, told).collect()} == {"big": True, "same": True, "less": True, "none": True}
    plan = runs.completed_runs(told, done)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "Join" not in plan
