"""Session memory: folded stretches and the stream against a replay."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.streaming import runs, sessions


def replay(data):
    """``{session: (remembered ords, pending)}`` by appending and trimming."""
    held, waits = {}, {}
    for s, k, kind, pending in sorted(data, key=lambda d: d[1]):
        own = held.setdefault(s, [])
        if kind == "set":
            waits[s] = pending
        elif kind == "clear":
            waits[s] = None
        else:
            own.append(k)
            if kind == "ai" and len(own) > 20:
                held[s] = own[-15:]
    return {s: (held[s], waits.get(s)) for s in held}


def conversation(seed, n, kinds=("user", "ai"), names=(0, 1, 2, None)):
    r = random.Random(seed)
    lean = {s: r.random() for s in names}
    out = []
    for k in range(n):
        s = r.choice(names)
        kind = kinds[int(r.random() < lean[s])] if len(kinds) == 2 else r.choice(kinds)
        out.append((s, k, kind, f"p{k}" if kind == "set" else None))
    return out


def test_stretch_functions_compose():
    r = np.random.default_rng(3)
    for _ in range(200):
        answers = r.random(r.integers(0, 80)) < r.random()
        cut = int(r.integers(0, len(answers) + 1))
        whole, one, two = (sessions.stretch_function(a) for a in (answers, answers[:cut], answers[cut:]))
        assert (whole[0] == two[0][one[0]]).all()
        later = two[1][one[0]]
        assert (whole[1] == np.where(later > 0, later + cut, one[1])).all()


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_memory_against_replay(spark, partitions):
    for seed in range(3):
        data = conversation(seed, 400)
        df = spark.createDataFrame(data, "session_id long, ord long, type string, pending string").repartition(5)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = sessions.session_memory(df)
            rows = {(r.session_id, r.ord) for r in got.collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert rows == {(s, k) for s, (held, _) in replay(data).items() for k in held} and got.columns == df.columns
    assert sessions.session_memory(df.limit(0)).count() == 0


def test_one_session_of_a_million_messages(spark):
    """One long session is folded by many tasks; none sees it whole."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(7).cast("long").alias("session_id"), F.col("id").alias("ord"), F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, "ai").otherwise("user").alias("type"))
    held = [r.ord for r in sessions.session_memory(df).orderBy("ord").collect()]
    kinds = df.filter(F.col("ord") >= n - 200).orderBy("ord").select("type").collect()
    assert held == list(range(held[0], n)) and 15 <= len(held) and kinds[held[0] + 14 - n + 200].type == "ai"
    # at most 20 after the last answer, and what users added since
    last = max(k for k, r in enumerate(kinds) if r.type == "ai") + n - 200
    assert sum(k <= last for k in held) <= 20


def test_stream_against_replay_with_restarts(spark, tmp_path):
    data = conversation(5, 300, ("user", "ai", "set", "clear", "user"), (0, 1, 2))
    for part in range(6):
        spark.createDataFrame(data[part * 50 : part * 50 + 50][::-1], "session_id long, ord long, type string, pending string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if part in (2, 5):
            stream = spark.readStream.schema("session_id long, ord long, type string, pending string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            assert runs.run_available(sessions.session_events(stream), str(tmp_path / "out"), str(tmp_path / "ck"), 120)
            last = spark.read.parquet(str(tmp_path / "out")).groupBy("session_id").agg(F.max_by(F.struct("remembered", "pending"), "upto").alias("m"))
            assert {r.session_id: (r.m.remembered, r.m.pending) for r in last.collect()} == replay(data[: part * 50 + 50])
