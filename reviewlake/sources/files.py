"""File and report scans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lines

# What the source scan keeps and skips, and what the quality and security readers keep.
SOURCE_EXTENSIONS = (".py", ".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".js", ".ts", ".java", ".go", ".rs", ".rb", ".php")
SKIPPED_FOLDERS = (".git", ".svn", "node_modules", "__pycache__", "venv", "env", ".venv", "dist", "build", ".idea", ".vscode")
QUALITY_EXTENSIONS = (".py", ".cpp", ".cxx", ".cc", ".c", ".h", ".hpp", ".hxx", ".js", ".java", ".cs", ".go", ".rs")
SECURITY_EXTENSIONS = (".py", ".cpp", ".cxx", ".cc", ".c", ".h", ".hpp", ".js", ".java", ".php")
SECURITY_WORDS = ("auth", "login", "password", "security", "crypto", "hash")
#: Files of a folder that the readers look at, before they look at the names.
PER_FOLDER = 15


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def _suffix(path: Column) -> Column:
    """The extension in small letters; none for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(path, r"[^./][^/]*?(\.[^./]*)$", 1))


def is_source(path: Column) -> Column:
    """Known extension, in small letters as it stands, and no skipped folder on the way."""
    known = F.regexp_extract(path, r"(\.[^./]*)$", 1).isin(*SOURCE_EXTENSIONS)
    return known & ~F.arrays_overlap(F.split(_folder(path), "/"), F.array(*map(F.lit, SKIPPED_FOLDERS)))


def _scan(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content)`` of source files below ``root``; undecodable bytes are dropped.

    The filter is on the file's own metadata, so files that it leaves out are struck from the
    scan's listing and their bytes are never read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(is_source(F.col("_metadata.file_path"))).select("path", "content")
    return rows.select("path", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")).alias("content"))


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content, gbk)`` of all files below ``root``: UTF-8, else GBK (marked so), else left out."""
    rows = _scan(spark, root)
    text = F.col("content").cast("string")

    def second(contents: pd.Series) -> pd.Series:
        return contents.map(_from_gbk)

    good = rows.filter(F.is_valid_utf8(text)).select("path", text.alias("content"), F.lit(False).alias("gbk"))
    others = rows.filter(~F.is_valid_utf8(text)).select("path", F.pandas_udf(second, "string")("content").alias("content"), F.lit(True).alias("gbk"))
    return good.unionByName(others.filter(F.col("content").isNotNull()))


def _from_gbk(data: bytes) -> str | None:
    try:
        return bytes(data).decode("gbk")
    except UnicodeDecodeError:
        return None


def _looked_at(files: DataFrame) -> DataFrame:
    """The first files of each folder by path, whatever they are, with their folder."""
    order = Window.partitionBy("folder").orderBy("path")
    return files.withColumn("folder", _folder(F.col("path"))).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= PER_FOLDER).drop("rn")


def _until(kept: DataFrame, size: Column, least: int, open_while: Column, most: int) -> DataFrame:
    """Rows of the folders, in order, before which ``open_while`` holds for the running ``before``.

    Each folder adds at least ``least``, so only the first few folders can matter: the running
    total is taken over those alone, and never over all folders in one task.
    """
    sizes = kept.groupBy("folder").agg(F.sum(size).alias("n")).orderBy("folder").limit(most // least + 2)
    before = F.coalesce(F.sum("n").over(Window.orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.join(F.broadcast(sizes.withColumn("before", before).filter(open_while).select("folder")), "folder", "left_semi")


def quality_files(files: DataFrame, most_chars: int = 15_000) -> DataFrame:
    """``(folder, path, content)``: files with a header, folders in order until the total passes the limit.

    Of each folder the first files are looked at and those with a known extension kept; the folder
    that passes the limit is still read whole. A file read as GBK (column ``gbk``) names no path.
    """
    path, suffix = F.col("path"), _suffix(F.col("path"))
    kept = _looked_at(files).filter(suffix.isin(*QUALITY_EXTENSIONS))
    where = F.concat(F.lit("# Path: "), path, F.lit("\n"))
    where = F.when(F.col("gbk"), "").otherwise(where) if "gbk" in files.columns else where
    language = lines.quality_language(F.col("content"), suffix)
    text = F.concat(F.lit("\n# File: "), _name(path), F.lit(" ("), suffix, F.lit(")\n"), where, F.lit("# Language: "), language, F.lit("\n"), F.col("content"), F.lit("\n"))
    texts = kept.select("folder", "path", text.alias("content"))
    return _until(texts, F.length("content"), 20, F.col("before") <= most_chars, most_chars)


def security_files(files: DataFrame, enough: int = 10) -> DataFrame:
    """``(folder, path, content)``: of each folder's first files those with a known extension or a telling name, until enough are found."""
    path, suffix = F.col("path"), _suffix(F.col("path"))
    telling = F.exists(F.array(*map(F.lit, SECURITY_WORDS)), lambda w: F.contains(F.lower(_name(path)), w))
    kept = _looked_at(files).filter(suffix.isin(*SECURITY_EXTENSIONS) | telling)
    text = F.concat(F.lit("// File: "), _name(path), F.lit(" ("), suffix, F.lit(")\n// Path: "), path, F.lit("\n"), F.col("content"))
    return _until(kept.select("folder", "path", text.alias("content")), F.lit(1), 1, F.col("before") < enough, enough)


def safe_texts(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of the wanted paths; a missing one is empty."""
    return wanted.join(texts, "path", "left").withColumn("content", F.coalesce("content", F.lit("")))


def csv(spark: SparkSession, path: str, required: tuple[str, ...] = (), schema: str | None = None) -> DataFrame:
    """CSV with a header; rows without the required columns are dropped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.dropna(subset=list(required)) if required else rows


def reports(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """Names, sizes and times of report files, optionally of one kind (the folder's name)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    rows = rows.withColumn("kind", F.element_at(F.split("path", "/"), -2))
    return rows if kind is None else rows.filter(F.col("kind") == kind)


def consolidated(paths: DataFrame) -> DataFrame:
    """Paths of consolidated reports of either naming, with the run they belong to."""
    new, old = r"/([^/]+)/consolidated/consolidated_[^/]+\.json$", r"/consolidated_req_(\d+)_([^/]+)\.json$"
    run = F.coalesce(F.nullif(F.regexp_extract("path", new, 1), F.lit("")), F.nullif(F.regexp_extract("path", old, 2), F.lit("")))
    return paths.withColumn("run_id", run).filter(F.col("run_id").isNotNull())


def expired(files: DataFrame, days: int = 30, now: Column | None = None) -> DataFrame:
    """Files older than the retention time."""
    now = F.current_timestamp() if now is None else now
    return files.filter(F.col("modificationTime") < now - F.make_dt_interval(F.lit(days)))


def delete_expired(files: DataFrame, days: int = 30, now: Column | None = None) -> int:
    """Delete files (path, modificationTime) older than the retention time; how many there were.

    Paths pass the driver one partition at a time. A file that is gone already is not counted.
    """
    jvm = files.sparkSession._jvm
    conf = files.sparkSession.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for row in expired(files, days, now).select("path").toLocalIterator():
        where = jvm.org.apache.hadoop.fs.Path(row.path)
        removed += bool(where.getFileSystem(conf).delete(where, False))
    return removed
