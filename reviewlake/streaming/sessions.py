"""Session memory and pending confirmations, in batch and on streams.

Only an answer trims: with more than ``KEEP_ABOVE`` messages a session keeps its last ``KEEP``.
What a stretch of messages does to the number remembered is a function from 21 states (0 to 19,
and 20 or more) to 21 states, and such functions compose in any grouping. In batch, sessions are
therefore cut into stretches of the range order of (session, message), each stretch becomes its
function in one pass, and only functions meet: a long session is folded by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import scratch

KEEP_ABOVE, KEEP = 20, 15

_FOLD = T.StructType([T.StructField("state", T.ArrayType(T.IntegerType())), T.StructField("trim", T.ArrayType(T.LongType()))])


def stretch_function(answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What messages (true: an answer) make of each number remembered, and the last that trims, counted from one; zero for none."""
    state, trim = np.arange(KEEP_ABOVE + 1), np.zeros(KEEP_ABOVE + 1, dtype=np.int64)
    at = 0
    for k in np.append(np.flatnonzero(answers), len(answers)):  # between answers the number only grows
        state = np.minimum(state + (k - at), KEEP_ABOVE)
        if k < len(answers):
            over = state == KEEP_ABOVE
            trim[over] = k + 1
            state = np.where(over, KEEP, state + 1)
        at = k + 1
    return state, trim


def session_memory(messages: DataFrame) -> DataFrame:
    """What each session remembers: messages (session_id, ord, type; any columns) as they stand after the last one.

    ``ord`` orders a session's messages; equal ones follow each other in any order. Null sessions
    are one session; an empty table gives an empty one.
    """
    spark = messages.sparkSession
    names = messages.columns
    schema = T.StructType([*messages.schema.fields, T.StructField("__piece", T.IntegerType()), T.StructField("__k", T.LongType()), T.StructField("__fold", _FOLD)])
    target = to_arrow_schema(schema)
    at_session, at_type = names.index("session_id"), names.index("type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition in order: each gets its number in its session's stretch, the last one the stretch's function."""
        piece = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        answers: list[np.ndarray] = []
        now: tuple | None = None
        count = 0

        def numbered(batch: pa.RecordBatch, first: int, fold: tuple | None) -> pa.RecordBatch:
            n = batch.num_rows
            folds = [None] * (n - 1) + [None if fold is None else {"state": fold[0].tolist(), "trim": fold[1].tolist()}]
            columns = [*batch.columns, pa.array([piece] * n, pa.int32()), pa.array(np.arange(first, first + n)), pa.array(folds, target.field("__fold").type)]
            return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, target, strict=True)], schema=target)

        def ends() -> Iterator[pa.RecordBatch]:
            yield numbered(held[0], count - held[0].num_rows + 1, stretch_function(np.concatenate(answers)))

        for batch in batches:
            keys = batch.column(at_session).to_pylist()
            kinds = np.array([t == "ai" for t in batch.column(at_type).to_pylist()], dtype=bool)
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if held and (keys[i],) != now:
                    yield from ends()
                    held, answers, count = [], [], 0
                elif held:  # the session goes on: what is held is not its end
                    yield numbered(held[0], count - held[0].num_rows + 1, None)
                held, now, count = [batch.slice(i, j - i)], (keys[i],), count + j - i
                answers.append(kinds[i:j])
        if held:
            yield from ends()

    path = scratch(spark, "memory")
    messages.repartitionByRange("session_id", "ord").sortWithinPartitions("session_id", "ord").mapInArrow(run, schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    key = F.struct("session_id")  # so that null sessions meet too
    folds = rows.filter("__fold is not null").select(key.alias("key"), F.struct("__piece", "__k", "__fold").alias("p"))
    order = Window.partitionBy("key").orderBy("p.__piece")
    folds = folds.withColumn("before", F.sum("p.__k").over(order) - F.col("p.__k"))
    # a session has as many stretches as partitions that it reaches into
    pieces = F.array_sort(F.collect_list(F.struct(F.col("p.__piece").alias("piece"), "before", F.col("p.__fold").alias("fold"))))
    zero = F.struct(F.lit(0).alias("state"), F.lit(1).cast("long").alias("start"))

    def follow(acc, x):
        trim = F.get(x["fold"]["trim"], acc["state"])
        return F.struct(F.get(x["fold"]["state"], acc["state"]).alias("state"), F.when(trim > 0, x["before"] + trim - KEEP + 1).otherwise(acc["start"]).alias("start"))

    starts = folds.groupBy("key").agg(pieces.alias("pieces")).select("key", F.explode("pieces").alias("x"), F.aggregate("pieces", zero, follow)["start"].alias("start"))
    least = starts.select("key", F.col("x.piece").alias("__piece"), (F.col("start") - F.col("x.before")).alias("least"))
    return rows.withColumn("key", key).join(least, ["key", "__piece"]).filter(F.col("__k") >= F.col("least")).select(*names)


def pending_state(changes: DataFrame) -> DataFrame:
    """Pending confirmation of each session after its set and clear changes (session_id, ord, op, pending)."""
    last = changes.groupBy("session_id").agg(F.max_by(F.struct("op", "pending"), "ord").alias("l"))
    return last.select("session_id", F.when(F.col("l.op") == "set", F.col("l.pending")).alias("pending"))


MEMORY = "session_id long, remembered array<long>, pending string, upto long"
_MEMORY = Row("session_id", "remembered", "pending", "upto")


class SessionTracker(StatefulProcessor):
    """State of a session: a list of the messages it remembers and the confirmation that waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", "ord long")
        self.pending = handle.getValueState("pending", "pending string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [m[0] for m in self.messages.get()] if self.messages.exists() else []
        waits = self.pending.get()[0] if self.pending.exists() else None
        before, new, trimmed, upto = waits, [], False, None
        for m in sorted(rows, key=lambda m: m["ord"]):
            upto = m["ord"]
            if m["type"] == "set":
                waits = m["pending"]
            elif m["type"] == "clear":
                waits = None
            else:
                held.append(m["ord"])
                new.append(m["ord"])
                if m["type"] == "ai" and len(held) > KEEP_ABOVE:
                    held, trimmed = held[-KEEP:], True
        if trimmed:
            self.messages.put([(n,) for n in held])
        elif new:
            self.messages.appendList([(n,) for n in new])
        if waits is None and before is not None:
            self.pending.clear()
        elif waits != before:
            self.pending.update((waits,))
        yield _MEMORY(key[0], held, waits, upto)

    def close(self) -> None:
        pass


def session_events(messages: DataFrame) -> DataFrame:
    """Streaming: after each micro-batch what its sessions remember and what waits in them.

    Messages: session_id (long), ord, type (``user``, ``ai``, or the changes ``set`` and ``clear``),
    pending. Of a session the row with the largest ``upto`` is its state. Needs the RocksDB state store.
    """
    return messages.groupBy("session_id").transformWithState(SessionTracker(), MEMORY, "append", "none")
