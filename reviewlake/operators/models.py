"""Model registry: version compatibility and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_number(version: Column) -> Column:
    """Major times 100 plus minor; zero where it cannot be read."""
    major, minor = F.split_part(version, F.lit("."), F.lit(1)).try_cast("int"), F.coalesce(F.nullif(F.split_part(version, F.lit("."), F.lit(2)), F.lit("")), F.lit("0")).try_cast("int")
    return F.coalesce(major * 100 + minor, F.lit(0))


def compatible(models: DataFrame, version: str | Column) -> DataFrame:
    """Models whose range (no upper bound: open) holds the version."""
    v = version_number(F.lit(version) if isinstance(version, str) else version)
    upper = F.when(F.coalesce("max_version", F.lit("")) == "", F.lit(2**31 - 1)).otherwise(version_number(F.col("max_version")))
    return models.filter(v.between(version_number(F.col("min_version")), upper))


def problematic(models: DataFrame, version: str) -> DataFrame:
    return models.join(compatible(models, version).select("name").distinct(), "name", "left_anti")


def by_type(models: DataFrame, kind: str) -> DataFrame:
    return models.filter(F.col("type") == kind)


def summary(models: DataFrame) -> DataFrame:
    span = F.concat_ws(" - ", "min_version", F.coalesce(F.nullif("max_version", F.lit("")), F.lit("latest")))
    return models.select("name", "type", span.alias("transformers_range"), F.coalesce(F.size("known_issues"), F.lit(0)).alias("known_issues_count"))
