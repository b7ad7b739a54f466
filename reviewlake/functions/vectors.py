"""Vector expressions: code-point embeddings and cosine distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Moduli of the fallback embeddings: of ingested texts and of search texts.
MODULI = {"A": (997, 389), "B": (991, 313)}


def code_point_sum(text: Column) -> Column:
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda s, c: s + F.ascii(c))


def embed(text: Column, variant: str = "B") -> Column:
    """``[length or 1, sum mod m1 / m1, sum mod m2 / m2]`` of a text's code points; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    total = code_point_sum(text)
    return F.array(F.greatest(F.char_length(text), F.lit(1)).cast("double"), *[(total % m).cast("double") / float(m) for m in MODULI[variant]])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1.0 - dot(a, b) / norm)


def similarity(distance: Column) -> Column:
    return 1.0 - distance / 2.0


def vector_or_embedding(vector: Column, text: Column, variant: str = "B") -> Column:
    """The given vector, else the text's embedding; neither is an error."""
    return F.when(vector.isNotNull(), vector).when(text.isNotNull(), embed(text, variant)).otherwise(F.raise_error(F.lit("neither vector nor text")).cast("array<double>"))
