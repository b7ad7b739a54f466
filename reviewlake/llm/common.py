"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, as the session names it.

    Where none is named a local master (tests) gets a temporary folder, removed at exit; other
    masters have no folder that all machines see, and raise.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="reviewlake-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        sc.setCheckpointDir(root)
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this job wrote, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows once to the shared checkpoint folder and read them from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan has fewer partitions than there are cores; else ``df`` as it is.

    Large tables have many partitions and are never moved. Only plain scans are looked at:
    counting the partitions of other plans could run them.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution()
    if re.search("Aggregate|Join|Window|Sort|Limit|Repartition|Exchange|Generate", plan.sparkPlan().toString()):
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def map_batches(df: DataFrame, schema: T.StructType, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]) -> DataFrame:
    """Stream Arrow batches through ``f``, batch by batch, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from f(batch)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def batch_of(schema: T.StructType, columns: list) -> pa.RecordBatch:
    """A batch of ``schema`` from Python lists, numpy arrays or Arrow arrays."""
    target = arrow_schema(schema)
    arrays = [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, type=f.type) for c, f in zip(columns, target, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that clashes with none of ``taken``, whatever its case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts, null as empty."""
    return [t or "" for t in column.to_pylist()]


def ascii_lower(text: str) -> str:
    """A-Z only; other letters stay."""
    return text.translate(_ASCII_LOWER)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def utf8(text: str) -> bytes:
    """UTF-8 bytes; lone surrogates, which no Parquet string holds, become '?'."""
    return text.encode("utf-8", "replace")


def held_out(doc_id: F.Column, folds: int, remainder: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``, is ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == remainder, F.lit(False))
