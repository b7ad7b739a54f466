"""Message delivery over restarts."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from reviewlake.sources import files
from reviewlake.streaming import runs

MAIL = "receiver string, ord long, id long, content string"


def test_each_message_once_over_a_death_between_the_sinks(spark, tmp_path, monkeypatch):
    rows = [(f"r{k % 3}" if k % 4 else "hot", k, k, '{"a": 1}' if k % 5 else None if k % 2 else "broken {") for k in range(300)]
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100][::-1], MAIL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start = lambda: runs.deliver(spark.readStream.schema(MAIL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "a int", str(tmp_path / "out"), str(tmp_path / "ck"), 120)
    deaths = []

    def dies(batch, path):
        if path.endswith("batch=1") and len(deaths) < 2:  # the queue of the batch is written, its dead letters are not
            deaths.append(path)
            raise RuntimeError("killed")
        write(batch, path)

    write = runs._write_dead
    monkeypatch.setattr(runs, "_write_dead", dies)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            start()
    assert start() and len(deaths) == 2
    queue = spark.read.parquet(str(tmp_path / "out/queue")).collect()
    dead = spark.read.parquet(str(tmp_path / "out/dead")).collect()
    assert sorted(r.id for r in queue) == [k for k in range(300) if k % 5] and sorted(r.id for r in dead) == [k for k in range(300) if k % 5 == 0]
    for receiver in ("hot", "r0", "r1", "r2"):
        own = [r.ord for r in sorted(queue, key=lambda r: (r.batch, r.ord)) if r.receiver == receiver]
        assert own == sorted(own) == [k for k in range(300) if k % 5 and (f"r{k % 3}" if k % 4 else "hot") == receiver]
    assert {r.batch for r in queue} == {0, 1, 2} and {r.parsed.a for r in queue} == {1}


def test_progress_on_a_stream_equals_the_batch(spark, tmp_path):
    r = random.Random(6)
    rows = [(f"r{r.randint(0, 2)}", k, r.randint(0, 2)) for k in range(200)]
    schema = "run_id string, ord long, completed long"
    for part in range(4):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50][::-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if part in (1, 3):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            assert runs.run_available(runs.progress_events(stream), str(tmp_path / "out"), str(tmp_path / "ck"), 120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, runs.progress_changes(spark.createDataFrame(rows, schema)).select("run_id", "ord", "completed").collect()))


def test_retention_deletes_old_reports(spark, tmp_path):
    for k in range(6):
        path = tmp_path / f"run{k}" / "report one.json"
        path.parent.mkdir()
        path.write_text("{}")
        os.utime(path, (0, 0) if k % 2 else None)
    rows = files.reports(spark, str(tmp_path))
    assert files.delete_expired(rows) == 3
    assert sorted(p.parent.name for p in tmp_path.glob("*/*.json")) == ["run0", "run2", "run4"]
    assert files.delete_expired(files.reports(spark, str(tmp_path))) == 0
    assert files.delete_expired(files.reports(spark, str(tmp_path)), now=F.current_timestamp() + F.expr("interval 31 days")) == 3


def test_positions_of_a_busy_receiver_are_numbered_by_stretches(spark, tmp_path):
    rows = [("a", k % 3, k, k) for k in range(400)] + [("b", 0, 7, 1000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would lay stretches of so few rows together
    try:
        got = runs.positions(spark.createDataFrame(rows, "receiver string, batch int, ord long, id long").repartition(3), f"{tmp_path}/cut").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert spark.read.parquet(f"{tmp_path}/cut").filter("receiver = 'a'").select("stretch").distinct().count() > 1
    order = [r.id for r in sorted(got, key=lambda r: (r.receiver, r.position))]
    assert order == [r[3] for r in sorted(rows)] and sorted(r.position for r in got) == [1, *range(1, 401)]
