"""Many known strings sought in many texts at once.

The strings (needles) become an Aho-Corasick automaton, so a text is read once whatever their
number. An automaton holds ``SHARD_BYTES`` of needles; more of them are split by hash into shards,
one broadcast and one pass over the texts each, whose hits are written before the next shard
is sent. Texts are never shuffled and pairs of texts and needles never listed unless they meet.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import scratch
from .ranking import first_per

#: Bytes of needles and of their ids, written out, in one shard.
SHARD_BYTES = 8 << 20


def _scan(shared, k: int | None, kinds: list[pa.DataType]):
    """Ids of the needles that occur in each text, each once, the ``k`` least where ``k`` is given."""

    def run(batches):
        automaton = ahocorasick.Automaton()
        for needle, ids in shared.value:
            automaton.add_word(needle, ids)
        automaton.make_automaton()
        for batch in batches:
            texts, found = [], []
            for text_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = {id(ids): ids for _, ids in automaton.iter(text.as_py() or "")} if len(automaton) else {}
                hits = {i for ids in held.values() for i in ids}
                hits = sorted(hits)[:k] if k else hits
                texts += [text_id] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([pa.array(texts, kinds[0]), pa.array(found, kinds[1])], names=["text_id", "id"])

    return run


def occurring(texts: DataFrame, needles: DataFrame, k: int | None = None) -> DataFrame:
    """``(text_id, id)`` of ``texts`` (text_id, text) and ``needles`` (needle, id): each id once a text that holds its needle.

    With ``k`` only the ``k`` least ids of each text. Comparison is by exact characters. Empty and
    null needles occur nowhere; null texts hold nothing; repeated needles and ids count once;
    a repeated text_id must carry the same text.
    """
    spark = texts.sparkSession
    kept = needles.filter("needle != ''").select("needle", "id").distinct()
    kept = kept if k is None else first_per(kept, ["needle"], ["id"], k)
    grouped = kept.groupBy("needle").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    size = grouped.agg(F.sum(F.octet_length("needle") + F.octet_length(F.array_join(F.col("ids").cast("array<string>"), " "))).alias("n")).first().n or 0
    shards = max(1, -(-size // SHARD_BYTES))
    rows = texts.select("text_id", "text")
    schema = T.StructType([rows.schema["text_id"], needles.schema["id"]])
    kinds = to_arrow_schema(schema).types
    path = scratch(spark, "needles") if shards > 1 else None
    for shard in range(shards):
        held = spark.sparkContext.broadcast([tuple(r) for r in grouped.filter(F.pmod(F.xxhash64("needle"), F.lit(shards)) == shard).collect()])
        hits = rows.mapInArrow(_scan(held, k, kinds), schema)
        if path is None:
            return hits
        hits.write.parquet(f"{path}/shard={shard}")
        held.destroy()
    hits = spark.read.schema(schema).parquet(*(f"{path}/shard={n}" for n in range(shards))).distinct()
    return hits if k is None else first_per(hits, ["text_id"], ["id"], k)


def pattern_counts(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """``(id, n)``: how many texts match each pattern that any does.

    ``patterns``: id, kind, start; ``texts``: text_id, text, source, one row a text. A text matches
    where it holds ``kind`` or ``start``, or its source holds ``kind``; empty pieces match nothing.
    Counted as texts with the one, plus texts with the other, less those with both, so that a
    kind which all texts hold does not pair every text with every pattern.
    """
    pieces = patterns.select("id", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("start", F.lit("")).alias("start"))
    needle = lambda *names: pieces.select(F.explode(F.array(*names)).alias("needle")).distinct().withColumn("id", F.col("needle"))
    in_text = occurring(texts.select("text_id", "text"), needle("kind", "start")).withColumnRenamed("id", "piece")
    by_source = occurring(texts.select("text_id", F.col("source").alias("text")), needle("kind")).withColumnRenamed("id", "piece")
    pairs = pieces.select("id", F.nullif("kind", F.lit("")).alias("kind"), F.nullif("start", F.lit("")).alias("start"))
    kinds = in_text.join(pairs.select(F.col("kind").alias("piece")).distinct(), "piece", "left_semi").select("text_id", "piece").unionByName(by_source).distinct()
    starts = in_text.join(pairs.select(F.col("start").alias("piece")).distinct(), "piece", "left_semi")
    of_kind = kinds.groupBy(F.col("piece").alias("kind")).agg(F.count("*").alias("by_kind"))
    of_start = starts.groupBy(F.col("piece").alias("start")).agg(F.count("*").alias("by_start"))
    named = pairs.select("kind", "start").distinct().filter("kind is not null and start is not null")
    both = starts.withColumnRenamed("piece", "start").join(named, "start").join(kinds.withColumnRenamed("piece", "kind"), ["text_id", "kind"]).groupBy("kind", "start").agg(F.count("*").alias("by_both"))
    counted = pairs.join(of_kind, "kind", "left").join(of_start, "start", "left").join(both, ["kind", "start"], "left")
    n = F.coalesce("by_kind", F.lit(0)) + F.coalesce("by_start", F.lit(0)) - F.coalesce("by_both", F.lit(0))
    return counted.select("id", n.alias("n")).filter("n > 0")
