"""Exact nearest neighbours by cells and the triangle inequality on angles.

``Cells`` gives each vector to its nearest pivot and keeps each cell's least and largest angle to
it. A query at angle ``a`` from a pivot is at least ``a - largest`` and ``least - a`` from every
vector of the cell, so cells are visited in order of that bound, a few more each round, until k
vectors are met; one more round visits all others that do not lie beyond the k-th distance. Vectors
are shuffled once, to their cells; each round only queries travel, once to each group of
neighbouring cells, whatever number of its cells they visit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import remove, scratch
from .ranking import first_per

#: Vectors aimed at for a cell, and the most cells; a larger cell is cut into slices of so many vectors.
CELL_ROWS, MOST_CELLS, SLICE_ROWS = 512, 4096, 4096
#: Cells a query visits in the first round; each round visits so many times more.
REACH, GROWTH = 2, 4
#: Bytes of vectors in a group of cells, and in a message of queries to it; the most cells of a group (bits of a number).
GROUP_BYTES, GROUP_CELLS = 8 << 20, 60
#: Queries compared with a cell at once, and most pairs of query and cell ordered at once.
BLOCK_ROWS, ORDERED = 256, 4_000_000
#: Slack of the bounds, in radians and in distance: distances are rounded to six digits.
SLACK = 1e-6

_VECTOR = T.ArrayType(T.DoubleType())
_CELL = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("id", T.LongType()), T.StructField("vector", _VECTOR)])
_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("distance", T.DoubleType())])
_VISIT = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("slice", T.IntegerType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("rows", _VECTOR)])
_ASKED = T.StructType([*_VISIT.fields, T.StructField("wanted", T.ArrayType(T.LongType())), T.StructField("bounds", _VECTOR)])


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a batch as rows."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angle of each row to each pivot (of length one)."""
    return np.arccos(np.clip(rows @ pivots.T / np.linalg.norm(rows, axis=1)[:, None], -1.0, 1.0))


def _some(vectors: DataFrame, name: str) -> DataFrame:
    """``(id, vector)`` of rows that have a direction: no null, zero or non-finite vectors."""
    rows = vectors.select(F.col(name).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return rows.filter((norm > 0) & (norm < float("inf")))


@dataclass
class Cells:
    """Vectors packed by group and slice, and what the driver knows of the cells (``MOST_CELLS`` rows at most).

    ``group`` names a cell's group by its first cell (-1: the cell is empty), ``bit`` its place there.
    """

    packed: DataFrame
    pivots: np.ndarray
    least: np.ndarray
    largest: np.ndarray
    count: np.ndarray
    group: np.ndarray
    bit: np.ndarray

    @staticmethod
    def of(vectors: DataFrame, vector_id: str = "sqlite_id") -> Cells:
        """Pivots are rows of least id hash, as many as give ``CELL_ROWS`` vectors a cell, ``MOST_CELLS`` at most."""
        spark = vectors.sparkSession
        rows = _some(vectors, vector_id)
        total = rows.count()
        wanted = min(MOST_CELLS, -(-total // CELL_ROWS))
        drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, total // (4 * wanted or 1)))) == 0) if wanted else rows
        drawn = drawn.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(max(1, wanted)).collect() or rows.limit(1).collect()
        pivots = np.unique(np.array([r.vector for r in drawn], dtype=np.float64), axis=0) if drawn else np.zeros((0, 0))
        if len(pivots):
            pivots /= np.linalg.norm(pivots, axis=1)[:, None]
        shared = spark.sparkContext.broadcast(pivots)

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    angles = _angles(_matrix(batch.column(1)), shared.value)
                    cell = angles.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell]), *batch.columns], names=_CELL.names)

        assigned = rows.mapInArrow(assign, _CELL).persist()
        known = assigned.groupBy("cell").agg(F.count("*").alias("count"), F.min("angle").alias("least"), F.max("angle").alias("largest")).collect()
        count, least, largest = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for r in known:
            count[r.cell], least[r.cell], largest[r.cell] = r["count"], r.least, r.largest
        group = _groups(pivots, count)
        bit = np.zeros(len(count), np.int64)
        for g in np.unique(group[group >= 0]):
            own = np.flatnonzero(group == g)
            bit[own] = np.arange(len(own))
        places = [(k, int(group[k]), int(bit[k]), -(-int(n) // SLICE_ROWS)) for k, n in enumerate(count) if n]
        placed = spark.createDataFrame(places, "own int, cell int, bit long, slices int")
        cut = assigned.withColumnRenamed("cell", "own").join(F.broadcast(placed), "own").withColumn("slice", F.pmod(F.xxhash64("id", "vector"), F.col("slices")).cast("int"))
        packed = cut.groupBy("cell", "slice").agg(F.collect_list("bit").alias("bits"), F.collect_list("id").alias("other_ids"), F.flatten(F.collect_list("vector")).alias("other_rows")).persist()
        packed.count()
        assigned.unpersist()
        return Cells(packed, pivots, least, largest, count, group, bit)


def _groups(pivots: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each cell's group: neighbours of ``GROUP_BYTES`` together; a cell cut into slices is one of its own."""
    group = np.where(count > SLICE_ROWS, np.arange(len(count)), -1)
    left = np.flatnonzero((count > 0) & (group < 0))
    most = GROUP_BYTES // (8 * max(1, pivots.shape[1]))
    while len(left):
        near = left[np.argsort(_angles(pivots[left[:1]], pivots[left])[0], kind="stable")]
        take = max(1, min(GROUP_CELLS, int(np.searchsorted(np.cumsum(count[near]), most, side="right"))))
        group[near[:take]] = near[0]
        left = np.sort(near[take:])
    return group


def _best(ids: np.ndarray, matrix: np.ndarray, wanted: np.ndarray, bounds: np.ndarray, bits: np.ndarray, others: np.ndarray, m: np.ndarray, k: int, exclude_self: bool) -> pa.RecordBatch:
    """The k nearest of a group for each query, of the cells it wants and not beyond its bound, ties by id."""
    by_cell = np.lexsort((others, bits))
    bits, others, m = bits[by_cell], others[by_cell], m[by_cell]
    length, reach = np.linalg.norm(matrix, axis=1)[:, None], np.linalg.norm(m, axis=1)[None, :]
    distance, nearest = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
    starts = np.flatnonzero(np.diff(bits, prepend=-1))
    for i, j in zip(starts, [*starts[1:], len(bits)], strict=True):
        asked = np.flatnonzero(wanted >> bits[i] & 1)
        for at in range(0, len(asked), BLOCK_ROWS):
            block = asked[at : at + BLOCK_ROWS]
            d = 1.0 - (matrix[block] @ m[i:j].T) / (length[block] * reach[:, i:j])
            if exclude_self:
                d[ids[block][:, None] == others[None, i:j]] = np.inf
            worst, last = distance[block, -1], nearest[block, -1]
            limit = np.minimum(bounds[block], worst)
            free = np.flatnonzero(np.isinf(limit))
            if len(free) and j - i > k:
                limit[free] = np.partition(d[free], k - 1, axis=1)[:, k - 1]
            rows, cols = np.nonzero((d <= limit[:, None] + 2 * SLACK) & (d < np.inf))  # all that round to the limit
            value, other = np.round(d[rows, cols], 6), others[i + cols]
            kept = (value <= bounds[block][rows]) & ((value < worst[rows]) | ((value == worst[rows]) & (other < last[rows])))
            rows, value, other = rows[kept], value[kept], other[kept]
            order = np.lexsort((other, value, rows))
            rows, value, other = rows[order], value[order], other[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, value, other, rank = rows[rank < k], value[rank < k], other[rank < k], rank[rank < k]
            new, which = np.full((len(block), k), np.inf), np.full((len(block), k), np.iinfo(np.int64).max)
            new[rows, rank], which[rows, rank] = value, other
            new, which = np.hstack([distance[block], new]), np.hstack([nearest[block], which])
            order = np.lexsort((which, new), axis=1)[:, :k]
            distance[block], nearest[block] = np.take_along_axis(new, order, axis=1), np.take_along_axis(which, order, axis=1)
    rows, cols = np.nonzero(distance < np.inf)
    return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(nearest[rows, cols]), pa.array(distance[rows, cols])], names=_FOUND.names)


def _one_list(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _reach(number: int) -> tuple[int, int]:
    """Cells of a query's order that round ``number`` visits: from, to."""
    first = REACH * (GROWTH**number - 1) // (GROWTH - 1)
    return first, first + REACH * GROWTH**number


def _order(shared, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells by lower bound of the angle to any of their vectors, and those bounds as distances less the slack."""
    pivots, least, largest, _ = shared.value
    angles = _angles(matrix, pivots)
    bound = np.maximum(0.0, np.maximum(angles - largest, least - angles) - SLACK)
    bound[:, np.isinf(largest)] = np.inf  # a pivot all of whose vectors went elsewhere
    order = np.lexsort((angles, bound), axis=1)
    bound = np.take_along_axis(bound, order, axis=1)
    return order, np.where(np.isinf(bound), np.inf, 1.0 - np.cos(np.minimum(bound, np.pi)) - SLACK)


def _ahead(shared, matrix: np.ndarray, bounds: np.ndarray, number: int):
    """By pieces of a batch: its start, its cells in order, which of them round ``number`` visits, and the bound of the first cell after them.

    Once k vectors are met a query visits all that its bound leaves, else the next few.
    """
    first, last = _reach(number)
    cells = len(shared.value[0])
    piece = max(1, ORDERED // cells)
    for at in range(0, len(matrix), piece):
        order, least = _order(shared, matrix[at : at + piece])
        bound = bounds[at : at + piece, None]
        to = np.where(np.isinf(bound), min(last, cells), cells)
        rank = np.arange(cells)[None, :]
        go = (rank >= first) & (rank < to) & (least <= bound) & (least < np.inf)
        after = np.where(to[:, 0] < cells, least[np.arange(len(least)), np.minimum(to[:, 0], cells - 1)], np.inf)
        yield at, order, go, after


def search(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "sqlite_id", exclude_self: bool = False) -> DataFrame:
    """``(query_id, hits, cells, visited, compared)``: the ``k`` nearest as ``(distance, id)`` in order, and the work done.

    ``cells`` counts the cells there are, ``visited`` those the query was compared with,
    ``compared`` the vectors in them. Query ids are taken as unique. Null, zero and non-finite
    vectors are no queries and no neighbours; all vectors have one dimension.
    """
    spark = queries.sparkSession
    index = Cells.of(vectors, vector_id)
    shared = spark.sparkContext.broadcast((index.pivots, index.least, index.largest, index.count))
    groups, at_group = np.unique(index.group, return_inverse=True)
    slices, bit = np.maximum(1, -(-index.count // SLICE_ROWS)), index.bit
    cells = int((index.count > 0).sum())
    empty = F.array().cast("array<struct<distance:double,id:bigint>>")
    state = _some(queries, query_id).select(F.col("id").alias("query_id"), "vector", empty.alias("hits"), F.lit(0).alias("visited"), F.lit(0).cast("long").alias("compared"), F.lit(float("inf")).alias("bound"), F.lit(0.0).alias("next"))
    ahead_of = (F.col("next") <= F.col("bound")) & (F.col("next") < float("inf"))

    def visits(number: int):
        """Packed queries for each group and slice they visit in this round, with the cells they want there."""

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, matrix, bounds = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy()
                most = max(1, GROUP_BYTES // (8 * matrix.shape[1]))
                for at, order, go, _ in _ahead(shared, matrix, bounds, number):
                    wanted = np.zeros((len(groups), len(go)), np.int64)
                    rows, cols = np.nonzero(go)
                    cell = order[rows, cols]
                    np.add.at(wanted, (at_group[cell], rows), 1 << bit[cell])
                    for g, of in enumerate(wanted):
                        asking = np.flatnonzero(of)
                        for i in range(0, len(asking), most):
                            some = asking[i : i + most]
                            lists = [_one_list(x) for x in (ids[at + some], matrix[at + some].ravel(), of[some], bounds[at + some])]
                            for s in range(int(slices[groups[g]])):
                                yield pa.RecordBatch.from_arrays([pa.array([groups[g]], pa.int32()), pa.array([s], pa.int32()), *lists], names=_ASKED.names)

        return run

    def multiply(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, rows, wanted, bounds, bits, others, m = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in range(7))
                yield _best(ids, rows.reshape(len(ids), -1), wanted, bounds, bits, others, m.reshape(len(others), -1), k, exclude_self)

    looked = T.StructType([*_FOUND.fields[:1], T.StructField("went", T.IntegerType()), T.StructField("more", T.LongType()), T.StructField("next", T.DoubleType())])

    def look(number: int):
        """Cells and vectors a query meets in this round, and the bound of the first cell after it."""

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    for at, order, go, after in _ahead(shared, _matrix(batch.column(1)), batch.column(2).to_numpy(), number):
                        more = (shared.value[3][order] * go).sum(axis=1)
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(go)), pa.array(go.sum(axis=1).astype(np.int32)), pa.array(more.astype(np.int64)), pa.array(after)], names=looked.names)

        return run

    if not cells:
        return state.select("query_id", "hits", F.lit(0).alias("cells"), "visited", "compared")
    before, number = None, 0
    while True:
        asked = state.filter(ahead_of).select("query_id", "vector", "bound")
        # Spark takes the visits to be no larger than the queries, of which each makes many: they are never for broadcast
        visited = asked.mapInArrow(visits(number), _ASKED).hint("merge").join(index.packed, ["cell", "slice"])
        met = visited.select("ids", "rows", "wanted", "bounds", "bits", "other_ids", "other_rows").mapInArrow(multiply, _FOUND)
        new = _least(met, k).withColumnRenamed("hits", "new")
        ahead = asked.mapInArrow(look(number), looked)
        both = F.slice(F.array_sort(F.concat("hits", F.coalesce("new", empty))), 1, k)
        went, more, rest = (F.coalesce(c, F.lit(none)) for c, none in (("went", 0), ("more", 0), ("next", float("inf"))))
        state = state.drop("next").join(new, "query_id", "left").join(ahead, "query_id", "left").select("query_id", "vector", both.alias("hits"), (F.col("visited") + went).alias("visited"), (F.col("compared") + more).alias("compared"), rest.alias("next"))
        bound = F.coalesce(F.get("hits", F.lit(k - 1))["distance"], F.lit(float("inf")))
        path = scratch(spark, f"nearest-{number}")
        state.withColumn("bound", bound).write.parquet(path)
        state = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before, number = path, number + 1
        if _reach(number)[0] >= len(index.pivots) or not state.filter(ahead_of).limit(1).count():
            break
    index.packed.unpersist()
    return state.select("query_id", "hits", F.lit(cells).alias("cells"), "visited", "compared")


def _least(found: DataFrame, k: int) -> DataFrame:
    """``(query_id, hits)``: the k least of each query, cut before the shuffle too."""
    kept = first_per(found, ["query_id"], ["distance", "id"], k)
    return kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("hits"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "sqlite_id", exclude_self: bool = False) -> DataFrame:
    """``(query_id, vector_id, distance)``: the ``k`` nearest by cosine distance (six digits), ties by id; see ``search``."""
    hit: Column = F.col("hit")
    rows = search(queries, vectors, k, query_id, vector_id, exclude_self).select(F.col("query_id").alias(query_id), F.explode("hits").alias("hit"))
    return rows.select(query_id, hit["id"].alias(vector_id), hit["distance"].alias("distance"))
