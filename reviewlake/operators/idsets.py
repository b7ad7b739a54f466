"""Sets of ids as bitmaps in buckets of 32,768 ids: union, size and equality without collecting a set.

Ids are numbered densely (keys of tables), so a bitmap of 4 KB stands for thousands of them. A
group's bitmaps are made before the shuffle in each task and merged bucket by bucket, so that a
group of any size is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmaps(rows: DataFrame, keys: list[str], id_col: str, **sets: Column) -> DataFrame:
    """``(keys, bucket)`` and for each named condition the bitmap of the ids that meet it; null ids are in no set."""
    bucket, at = F.bitmap_bucket_number(id_col), F.bitmap_bit_position(id_col)
    marked = rows.filter(F.col(id_col).isNotNull()).select(*keys, bucket.alias("bucket"), *(F.when(condition, at).alias(name) for name, condition in sets.items()))
    return marked.groupBy(*keys, "bucket").agg(*(F.bitmap_construct_agg(name).alias(name) for name in sets))


def merged(maps: DataFrame, keys: list[str], *names: str) -> DataFrame:
    """Bitmaps of several tables (``unionByName``) as one: the union of their sets."""
    return maps.groupBy(*keys, "bucket").agg(*(F.bitmap_or_agg(name).alias(name) for name in names))


def sizes(maps: DataFrame, keys: list[str], *names: str) -> DataFrame:
    """How many ids each set has."""
    return maps.groupBy(*keys).agg(*(F.sum(F.bitmap_count(name)).alias(name) for name in names))


def equal_sets(maps: DataFrame, keys: list[str], one: str, other: str, name: str = "equal") -> DataFrame:
    """Whether two sets hold the same ids."""
    return maps.groupBy(*keys).agg(F.bool_and(F.col(one) == F.col(other)).alias(name))
