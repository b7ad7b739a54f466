"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return ``(node, root)`` for every node of ``links``; root is the smallest node reachable.

    Nodes are longs. Self links and nulls are ignored; an empty table gives an empty result.
    Links stay distributed: each round is two aggregations with partial combine and two
    equi-joins, written to the checkpoint folder. Rounds grow with the logarithm of the
    largest component, and a hub's many links are split by adaptive skew joins.
    """
    edges = settle(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct()
    )
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = settle(small.filter("u != v").distinct())
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
