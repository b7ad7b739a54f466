"""Greedy packing of long sequences by many tasks.

Rows of a key, in order, fill chunks up to a limit. Where a chunk ends depends on what it began
with, so the rule looks sequential; but what a stretch of rows does is a function of the size
that its first chunk already has: up to where that chunk ends (one of few places, found by
binary search in prefix sums), and from there a chain of starts that no longer depends on it. Keys
are cut into stretches of the range order of (key, order), each stretch becomes its function in
one pass, and the functions of a key, one a stretch, are followed in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import scratch

#: Of a chunk that nothing may join: more than any limit.
_FULL = 1 << 60
_WAY = T.StructType([T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("chunks", T.ArrayType(T.LongType())), T.StructField("used", T.ArrayType(T.LongType())), T.StructField("total", T.LongType())])


def _next_starts(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums before each row, and for each row as a start the row that starts the next chunk."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.searchsorted(sums, sums[:-1] + limit, side="right") - 1  # the first row that no longer fits
    alone = np.flatnonzero(sizes >= limit)
    stop = np.append(alone, len(sizes))[np.searchsorted(alone, np.arange(len(sizes)), side="right")]
    ends = np.minimum(ends, stop)  # a row of the limit or more joins no chunk
    ends[alone] = alone + 1
    return sums, np.maximum(ends, np.arange(len(sizes)) + 1)


def stretch_way(sizes: np.ndarray, limit: int) -> dict[str, list | int]:
    """What a stretch does to an open chunk: by how many of its first rows still fit.

    ``sums[p]`` is the size of the first ``p`` rows; if just those join, ``chunks[p]`` more chunks are
    begun and the last holds ``used[p]``. ``total`` is the size of all rows, none of which may stand alone
    if all join; more rows than the limit allows join no chunk, so the lists are short.
    """
    n = len(sizes)
    sums, ends = _next_starts(sizes, limit)
    big = np.flatnonzero(sizes >= limit)
    most = min(int(np.searchsorted(sums, limit, side="right")) - 1, int(big[0]) if len(big) else n)
    # by the chain from each possible first start; chains merge, so each start is walked once
    chunks, used = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        j = ends[i]
        if j < n:
            chunks[i], used[i] = chunks[j] + 1, used[j]
        else:
            chunks[i], used[i] = 1, _FULL if sizes[i] >= limit else sums[n] - sums[i]
    return {"sums": sums[: most + 1].tolist(), "chunks": chunks[: most + 1].tolist(), "used": used[: most + 1].tolist(), "total": n}


def joined(sums: np.ndarray, n: int, used: int, limit: int) -> int:
    """How many first rows of a stretch join a chunk of size ``used``."""
    return int(np.searchsorted(sums, limit - used, side="right")) - 1 if used < limit else 0


def greedy_chunks(rows: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """``rows`` with ``chunk``: consecutive rows of a key, by ``order``, while their sizes add up to ``limit`` at most.

    A row of the limit or more stands alone. Chunks of a key count from 0. Sizes are whole numbers
    above zero; rows of equal order follow each other in any order; null keys are one key.
    """
    spark = rows.sparkSession
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("__piece", T.IntegerType()), T.StructField("__k", T.LongType()), T.StructField("__way", _WAY)])
    target = to_arrow_schema(schema)
    at_key, at_size = names.index(key), names.index(size)

    def stretches(batches: Iterator[pa.RecordBatch], by: list[int]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray]]:
        """The rows that agree in the columns ``by``, in order, with their sizes."""
        now, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and i < j and keys[i] != now:
                    yield held, np.concatenate([h.column(at_size).to_numpy(zero_copy_only=False) for h in held]).astype(np.int64)
                    held = []
                if j > i:
                    now = keys[i]
                    held.append(batch.slice(i, j - i))
        if held:
            yield held, np.concatenate([h.column(at_size).to_numpy(zero_copy_only=False) for h in held]).astype(np.int64)

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        for held, sizes in stretches(batches, [at_key]):
            way, at = stretch_way(sizes, limit), 0
            for k, part in enumerate(held):
                n = part.num_rows
                last = [None] * (n - 1) + [way if k == len(held) - 1 else None]
                columns = [*part.columns, pa.array([piece] * n, pa.int32()), pa.array(np.arange(at, at + n)), pa.array(last, target.field("__way").type)]
                at += n
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, target, strict=True)], schema=target)

    path = scratch(spark, "greedy")
    rows.repartitionByRange(key, order).sortWithinPartitions(key, order).mapInArrow(ways, schema).write.parquet(path)
    cut = spark.read.schema(schema).parquet(path).withColumn("__key", F.struct(key))
    known = cut.filter("__way is not null").select("__key", F.struct("__piece", "__way").alias("w"))
    # a key has as many stretches as partitions that it reaches into; each is entered with what the one before leaves
    zero = F.struct(F.lit(-1).cast("long").alias("chunk"), F.lit(_FULL).cast("long").alias("used"), F.array().cast("array<struct<piece:int,chunk:bigint,used:bigint>>").alias("entries"))

    def follow(acc, x):
        way = x["__way"]
        p = F.when(acc["used"] >= limit, F.lit(0)).otherwise(F.greatest(F.size(F.filter(way["sums"], lambda s: s + acc["used"] <= limit)) - 1, F.lit(0)))
        all_join = p >= way["total"]
        entry = F.array(F.struct(x["__piece"].alias("piece"), acc["chunk"].alias("chunk"), acc["used"].alias("used")))
        return F.struct(
            F.when(all_join, acc["chunk"]).otherwise(acc["chunk"] + F.get(way["chunks"], p)).alias("chunk"),
            F.when(all_join, acc["used"] + F.element_at(way["sums"], -1)).otherwise(F.get(way["used"], p)).alias("used"),
            F.concat(acc["entries"], entry).alias("entries"),
        )

    entries = known.groupBy("__key").agg(F.array_sort(F.collect_list("w")).alias("ws")).select("__key", F.explode(F.aggregate("ws", zero, follow)["entries"]).alias("e"))
    entered = cut.drop("__way").join(entries.select("__key", F.col("e.piece").alias("__piece"), F.col("e.chunk").alias("__chunk"), F.col("e.used").alias("__used")), ["__key", "__piece"])
    out = T.StructType([*rows.schema.fields, T.StructField("chunk", T.LongType())])
    out_target = to_arrow_schema(out)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, sizes in stretches(batches, [at_key, len(names) + 2]):
            first, used = (held[0].column(len(names) + k)[0].as_py() for k in (0, 1))
            sums, ends = _next_starts(sizes, limit)
            big = np.flatnonzero(sizes >= limit)
            i = min(joined(sums, len(sizes), used, limit), int(big[0]) if len(big) else len(sizes))
            starts = []
            while i < len(sizes):
                starts.append(i)
                i = int(ends[i])
            chunk = first + np.searchsorted(np.array(starts, dtype=np.int64), np.arange(len(sizes)), side="right")
            at = 0
            for part in held:
                columns = [*part.columns[: len(names)], pa.array(chunk[at : at + part.num_rows])]
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, out_target, strict=True)], schema=out_target)

    again = entered.select(*names, "__chunk", "__used", "__piece", "__k")
    return again.repartition(key, "__piece").sortWithinPartitions(key, "__piece", "__k").mapInArrow(place, out)

