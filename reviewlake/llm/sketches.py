"""Threshold-scaled document fingerprints with built-in functions only.

A sketch holds every five-word shingle hash below a fixed fraction of the hash space, one in
``SCALE``, so its size follows the text, sketches merge by union, and containment can be estimated
between very unequal documents. A text of at most ``WHOLE`` different shingles keeps them all: its
sketch is whole, its fraction one. Two whole sketches are compared as they are, without error;
otherwise what lies below the bound is compared, which either kind holds.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, spread

SHINGLE = 5
#: One hash in so many is kept, but all of a text of at most so many different ones.
SCALE, WHOLE = 4, 512
#: Rows of a stretch of the id order, which is sorted by itself; the most stretches, beyond which they grow; rows sampled for each.
STRETCH, MOST_STRETCHES, SAMPLED = 1024, 1 << 16, 4


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(tokens: Column) -> Column:
    """XXH64 of each run of ``SHINGLE`` words, the whole sequence where there are fewer, none without words."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, runs).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", tokens)))).otherwise(F.array().cast("array<bigint>"))


def _low(hashes: Column) -> Column:
    """The hashes below the bound."""
    return F.filter(hashes, lambda h: h < F.lit(-(1 << 63) + (1 << 64) // SCALE))


def _sketch(distinct: Column) -> Column:
    """Sketch of different hashes, sorted: its scale (1: whole) and the hashes that it keeps."""
    whole = F.size(distinct) <= WHOLE
    return F.struct(F.when(whole, 1).otherwise(SCALE).alias("scale"), F.when(whole, distinct).otherwise(_low(distinct)).alias("hashes"))


def with_sketch(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with the sketch of a whole text, ``struct<scale, hashes>`` of sorted longs; null counts as empty and has none.

    The stages are separate columns so that words and hashes are computed once a row.
    """
    tokens, hashes = fresh("tokens", [*df.columns, name]), fresh("hashes", [*df.columns, name])
    staged = df.withColumn(tokens, words(F.coalesce(F.col(text_col), F.lit(""))))
    staged = staged.withColumn(hashes, F.sort_array(F.array_distinct(shingle_hashes(F.col(tokens))))).drop(tokens)
    return staged.withColumn(name, _sketch(F.col(hashes))).drop(hashes)


def merged(a: Column, b: Column) -> Column:
    """Sketch of two documents taken together: as if made of both, but whole sketches of a longer union become scaled."""
    both = F.sort_array(F.array_union(a["hashes"], b["hashes"]))
    scaled = F.struct(F.lit(SCALE).alias("scale"), _low(both).alias("hashes"))
    return F.when((a["scale"] == 1) & (b["scale"] == 1), _sketch(both)).otherwise(scaled)


def _comparable(a: Column, b: Column) -> tuple[Column, Column]:
    """The hashes of two sketches at a common fraction."""
    whole = (a["scale"] == 1) & (b["scale"] == 1)
    return tuple(F.when(whole | (s["scale"] != 1), s["hashes"]).otherwise(_low(s["hashes"])) for s in (a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; two sketches without hashes are alike, one is unlike any other."""
    x, y = _comparable(a, b)
    return F.when(a == b, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document's shingles that the second holds; 1 for a document without any.

    A short document against a long one is compared by the few of its hashes that lie below the
    bound; where none does nothing is known, and the share is null.
    """
    x, y = _comparable(a, b)
    return F.when(F.size(a["hashes"]) == 0, 1.0).when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))


def as_text(sketch: Column) -> Column:
    """The scale and the hashes in hexadecimal; empty without any."""
    return F.when(F.size(sketch["hashes"]) == 0, "").otherwise(F.concat(sketch["scale"].cast("string"), F.lit(":"), F.array_join(F.transform(sketch["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")))


def _openings(keyed: DataFrame, rows: int) -> list[tuple[int, int]]:
    """``(id, tie)`` of the rows that open a stretch: the least one and, from a bounded sample, about one in ``rows``.

    All are rows of the table, and whole numbers throughout, so that ids of any size open a stretch.
    """
    count, least = keyed.agg(F.count("*"), F.min(F.struct("id", "tie"))).first()
    if not count:
        return []
    parts = min(MOST_STRETCHES, max(1, count // rows))
    share = SAMPLED * parts / count
    drawn = sorted(map(tuple, (keyed if share >= 1 else keyed.sample(share, 7)).collect())) if parts > 1 else []
    step = max(1, round(len(drawn) / parts))
    return sorted({tuple(least), *drawn[step::step]})


def _stretch_of(key: Column, table: Column, size: int) -> Column:
    """Binary search of a key among the opening ones: the number of the last that is not above it."""
    zero = F.struct(F.lit(0).alias("lo"), F.lit(size).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        right = F.get(table, middle) <= key
        return F.when(acc["hi"] - acc["lo"] <= 1, acc).otherwise(F.struct(F.when(right, middle).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(middle).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(size.bit_length() + 1)), zero, halve)["lo"]


def with_next(docs: DataFrame, columns: list[str], rows: int = STRETCH) -> DataFrame:
    """``docs`` with ``next_<column>``: the values of the row after it by doc_id, of the first row after the last.

    The id order is cut into stretches, each sorted by itself; the row that opens a stretch also
    closes the one before, so one shuffle on the stretch does. Rows of equal id follow each other
    by text hash and are dealt to several stretches by it; rows without an id come first. Rows
    alike in both are repeats, which follow each other in any order.
    """
    part, guest, role, key = (fresh(name, [*docs.columns, *(f"next_{c}" for c in columns)]) for name in ("part", "guest", "role", "key"))
    pair = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("tie"))
    opens = _openings(docs.select(pair.alias("key")).select("key.*"), rows)
    if not opens:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    table = F.from_json(F.lit(json.dumps([{"id": i, "tie": t} for i, t in opens])), "array<struct<id:bigint,tie:bigint>>")
    at = docs.withColumn(key, pair)
    at = at.withColumn(part, _stretch_of(F.col(key), table, len(opens)))
    own = F.struct(F.col(part).alias(part), F.lit(False).alias(guest))
    before = F.struct(F.pmod(F.col(part) - 1, F.lit(len(opens))).alias(part), F.lit(True).alias(guest))
    dealt = at.withColumn(role, F.explode(F.when(F.col(key) == F.get(table, F.col(part)), F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select(*docs.columns, key, f"{role}.{part}", f"{role}.{guest}")
    order = Window.partitionBy(part).orderBy(guest, key)
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return dealt.select(*docs.columns, guest, *nexts).filter(~F.col(guest)).drop(guest)


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter of code points replaced by the start of the following text."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Digest per document: doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next.

    A row for every row of ``docs``, repeats and null ids too, in the order that ``with_next`` names;
    null and empty texts have no shingles. A single row is its own next. Other columns are not read.
    """
    texts = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    # only texts are moved: sketches of all hashes are larger than they and made again after the shuffle
    ahead = with_sketch(with_sketch(with_next(texts, ["text"]), "text", "sketch"), "next_text", "next_sketch")
    changed = ahead.withColumn("edited", edited(F.col("text"), F.col("next_text"))).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "sketch", "next_sketch", "edited")
    both = with_sketch(changed, "edited", "edited_sketch")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"),
    )
