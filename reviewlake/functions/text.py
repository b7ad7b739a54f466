"""String rules of the issue model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(value: Column) -> Column:
    """Null as empty, trimmed, every run of white space one space."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)\s+", " "))


def norm_key(value: Column) -> Column:
    """Lower-case normalised text for comparisons."""
    return F.lower(normalize_text(value))


def split_summary(summary: Column) -> Column:
    """``struct(phenomenon, root_cause)``: first sentence; second, else the whole text."""
    text = normalize_text(summary)
    parts = F.filter(F.split(text, r"(?<=\.)\s+"), lambda p: p != "")
    return F.struct(
        F.coalesce(F.get(parts, F.lit(0)), text).alias("phenomenon"),
        F.when(text == "", "").otherwise(F.coalesce(F.get(parts, F.lit(1)), text)).alias("root_cause"),
    )


def sanitize_path(path: Column) -> Column:
    """File name form of a relative path: other characters than letters, digits, ``_`` and ``.`` become one ``_``."""
    safe = F.regexp_replace(path, r"[^\p{L}\p{N}_.]", "_")
    safe = F.regexp_replace(F.regexp_replace(safe, "_{2,}", "_"), "^_+|_+$", "")
    return F.when(safe == "", "unknown_file").otherwise(safe)


def relative_path(path: Column, root: Column) -> Column:
    """The path below ``root``, or its last part where it lies elsewhere."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))


# Tag and field of each line of a vector layer.
LAYERS = {
    "semantic": (("error_type", "error_type"), ("severity", "severity"), ("language", "language"), ("framework", "framework"), ("description", "error_description")),
    "code_pattern": (("problematic_pattern", "problematic_pattern"), ("file_pattern", "file_pattern"), ("class_pattern", "class_pattern"), ("language", "language")),
    "solution": (("solution", "solution"), ("error_description", "error_description"), ("severity", "severity")),
    "full": (
        ("error_type", "error_type"), ("severity", "severity"), ("language", "language"), ("framework", "framework"), ("description", "error_description"),
        ("pattern", "problematic_pattern"), ("solution", "solution"), ("file_pattern", "file_pattern"), ("class_pattern", "class_pattern"),
    ),
}


def layer_text(layer: str, fields: dict[str, Column] | None = None) -> Column:
    """Tagged lines of one vector layer; null or missing values leave the tag alone. An unknown layer is an error."""
    if layer not in LAYERS:
        raise ValueError(f"unknown vector layer: {layer}")
    value = lambda f: F.coalesce(F.col(f).cast("string") if fields is None else fields.get(f, F.lit(None)), F.lit(""))
    return F.concat_ws("\n", *[F.concat(F.lit(f"[{tag}] "), value(field)) for tag, field in LAYERS[layer]])


def cell(value: Column, width: int) -> Column:
    """One table cell: line breaks as spaces, cut to ``width`` with an ellipsis."""
    flat = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


def count_of(text: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("long")
