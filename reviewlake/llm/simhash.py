"""Near-duplicates by SimHash fingerprints, with pivot distance tables as the candidate filter.

Fingerprints at most ``RADIUS`` bits apart are linked. Candidates are grouped by exact
blocking: 64 bits in five blocks, of which three differing bits leave two untouched, so
linked fingerprints share one of ten two-block keys. Inside a group a table of Hamming
distances to reference fingerprints (the pivots) is computed once; by the triangle
inequality a link's coordinates differ by at most the radius, so pairs are discarded by
their largest coordinate difference and only survivors are verified on all 64 bits.

Copies share one fingerprint and are folded before any of this. A group emits a spanning
forest of its links (fewer rows than it has members), never its pairs; a group above
``GROUP_ROWS`` is dealt out as pairs of hashed blocks, so no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, fresh, map_batches, settle, spread, texts_of, utf8
from .components import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Widths of the blocks of a fingerprint, from bit 0.
BLOCKS = (13, 13, 13, 13, 12)
#: Rows of a blocking group that one task handles at once.
GROUP_ROWS = 4096
#: Reference fingerprints: XXH64 of their number.
PIVOTS = np.array([xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(16)], dtype=np.uint64)


def fingerprint(text: str) -> int:
    """Majority bits of the shingle hashes, as an unsigned integer; no words give zero."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of each whole text as a signed long; null text counts as empty."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.array([fingerprint(t) for t in texts_of(batch.column(1))], dtype=np.uint64)
        yield batch_of(schema, [batch.column(0), pa.array(fps.view(np.int64))])

    return map_batches(spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), schema, run)


def _block_keys(fp: F.Column) -> F.Column:
    parts, at = [], 0
    for width in BLOCKS:
        parts.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        at += width
    keys = [F.shiftleft(F.lit(k).cast("long"), 40).bitwiseOR(F.shiftleft(parts[i], 13)).bitwiseOR(parts[j]) for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    return F.array(*keys)


def forest(fps: np.ndarray, table: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of ``fps`` (unsigned) within the radius; ``table`` holds pivot distances."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    left, links = np.arange(len(fps)), []
    while len(left) > 1:
        ahead, left = [left[0]], left[1:]
        while ahead and len(left):
            i = ahead.pop()
            first = table[left, 0]
            lo, hi = np.searchsorted(first, int(table[i, 0]) - RADIUS), np.searchsorted(first, int(table[i, 0]) + RADIUS, side="right")
            near = left[lo:hi]
            near = near[np.abs(table[near] - table[i]).max(axis=1, initial=0) <= RADIUS]
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= RADIUS]
            if len(near):
                links += [(int(fps[i]), int(fps[j])) for j in near]
                ahead += near.tolist()
                left = left[~np.isin(left, near, assume_unique=True)]
    return links


def links(distinct: DataFrame) -> DataFrame:
    """``(a, b)``: links between the distinct fingerprints ``fp`` that keep its components whole."""
    keyed = distinct.select("fp", F.explode(_block_keys(F.col("fp"))).alias("key"))
    crowded = keyed.groupBy("key").count().filter(F.col("count") > GROUP_ROWS).select("key", F.ceil(F.col("count") / (GROUP_ROWS // 2)).cast("int").alias("blocks"))
    crowded = settle(crowded)
    if crowded.isEmpty():
        dealt = keyed.select("key", F.lit(0).alias("cell"), "fp")
    else:
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.greatest(j, block) * F.col("blocks") + F.least(j, block))
        dealt = keyed.join(crowded, "key", "left").select("key", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(other)).alias("cell"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_group, rest_fp = np.empty((0, 2), np.int64), np.empty(0, np.uint64)

        def found(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            if len(fps):
                table = np.bitwise_count(fps[:, None] ^ PIVOTS).astype(np.int8)
                cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
                starts, ends = np.r_[0, cuts], np.r_[cuts, len(fps)]
                for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                    out += forest(fps[s:e], table[s:e])
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return batch_of(schema, [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])])

        for batch in batches:
            group = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]).astype(np.int64)
            group = np.concatenate([rest_group, group])
            fps = np.concatenate([rest_fp, batch.column(2).to_numpy().view(np.uint64)])
            if not len(fps):
                continue
            last = int(np.flatnonzero((group == group[-1]).all(axis=1))[0])
            yield found(group[:last], fps[:last])
            rest_group, rest_fp = group[last:], fps[last:]
        yield found(rest_group, rest_fp)

    return dealt.repartition("key", "cell").sortWithinPartitions("key", "cell").select("key", "cell", "fp").mapInArrow(run, schema)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``.

    component_id is the smallest doc_id of the rows reachable over links. Null and empty
    texts have fingerprint zero and are linked like any other. A row with a null id gets
    the component of its fingerprint (null if no member has an id) and never names one.
    Repeated rows come back repeated; an empty table gives an empty result; other columns
    of ``docs`` are not read.
    """
    rows = settle(fingerprints(docs, id_col, text_col))
    groups = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = connected_components(links(groups.select("fp"))).withColumnRenamed("node", "fp")
    rooted = groups.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Digest of ``classes``: doc_id, fingerprint as 16 hex digits, component_id."""
    return classes(docs).select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Keep one row of each component: that of its smallest doc_id, with all columns.

    Rows that repeat that id are reduced to the first by text; rows without an id are kept,
    because nothing names them. Null and empty texts are near copies of each other. Other columns
    may have any names; an empty table gives an empty one.
    """
    gone, twice, row = (fresh(name, docs.columns) for name in ("gone", "twice", "row"))
    others = classes(docs).filter("doc_id != component_id").select(F.col("doc_id").alias(gone)).distinct()
    kept = docs.join(others, F.col("doc_id") == F.col(gone), "left_anti")
    ids = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias(twice)).agg(F.count("*").alias(row)).filter(F.col(row) > 1).select(twice)
    ids = settle(ids)
    if ids.isEmpty():
        return kept
    single = kept.join(ids, F.col("doc_id") == F.col(twice), "left_anti")
    first = kept.join(ids, F.col("doc_id") == F.col(twice), "left_semi")
    rest = [c for c in docs.columns if c != "doc_id"]
    picked = first.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.struct("text")).alias(row))
    return single.unionByName(picked.select("doc_id", *[F.col(row)[c].alias(c) for c in rest]).select(*docs.columns))
