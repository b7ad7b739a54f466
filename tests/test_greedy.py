"""Greedy packing of long sequences against a sequential model."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.operators import greedy, ranking


def model(sizes, limit):
    out, chunk, used, alone = [], -1, 0, True
    for size in sizes:
        if alone or size >= limit or used + size > limit:
            chunk, used = chunk + 1, 0
        alone = size >= limit
        used += size
        out.append(chunk)
    return out


def test_ways_follow_each_other():
    r = random.Random(2)
    for _ in range(300):
        limit = r.choice([1, 5, 20])
        sizes = [r.randint(1, r.choice([3, 6, 25])) for _ in range(r.randint(1, 40))]
        cuts = sorted(r.sample(range(1, len(sizes) + 1), min(len(sizes), r.randint(0, 4))))
        chunk, used = -1, greedy._FULL
        for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            if a == b:
                continue
            part = np.array(sizes[a:b])
            way = greedy.stretch_way(part, limit)
            p = sum(s + used <= limit for s in way["sums"]) - 1 if used < limit else 0
            if p >= way["total"]:
                used += way["sums"][-1]
            else:
                chunk, used = chunk + way["chunks"][max(p, 0)], way["used"][max(p, 0)]
            assert chunk == model(sizes[:b], limit)[-1]


@pytest.mark.parametrize("partitions", [1, 3, 11])
def test_chunks_equal_the_model(spark, partitions):
    r = random.Random(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for limit in (1, 30, 1000):
            rows = [(r.choice(["hot", "hot", "hot", "x", None]), k, r.randint(1, r.choice([4, 12, 40])), "extra") for k in range(500)]
            df = spark.createDataFrame(rows, "name string, ord long, size int, chunks string").repartition(4)
            got = {r.ord: r.chunk for r in greedy.greedy_chunks(df, "name", "ord", "size", limit).collect()}
            for name in ("hot", "x", None):
                own = [row for row in rows if row[0] == name]
                assert [got[row[1]] for row in own] == model([row[2] for row in own], limit), (name, limit)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert greedy.greedy_chunks(df.limit(0), "name", "ord", "size", 5).count() == 0


def test_one_key_of_many_rows_is_split(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("hot").alias("name"), F.col("id").alias("ord"), (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).alias("size"))
    got = greedy.greedy_chunks(df, "name", "ord", "size", 1000).orderBy("ord").select("size", "chunk").collect()
    assert [r.chunk for r in got] == model([r.size for r in got], 1000)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select(F.col("id").alias("ord"), (F.col("id") % 7).alias("v"))
    one, two, other = (sorted(map(tuple, ranking.sample_rows(d, 50, seed=s).collect())) for d, s in ((df.repartition(1), 42), (df.repartition(9), 42), (df, 43)))
    assert one == two and one != other and len(one) == 50
    assert ranking.sample_rows(df.limit(3), 50).count() == 3
