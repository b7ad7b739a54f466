"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised test items is built on the driver from a bounded number of
item words and broadcast; every document streams its words through it in one pass, tracking
the longest match that ends at each word. Benchmarks above the bound are split by item into
shards, one pass over the texts each, so what is broadcast never grows with the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, ascii_lower, fresh, settle, spread, texts_of, utf8

WINDOW = 13
#: A document is contaminated from one hit word in this many.
COVERAGE = 20
#: Item words that one broadcast automaton may hold.
SHARD_WORDS = 250_000

#: Every byte that ends a word as a space, A-Z as a-z.
_TABLE = bytes(c if chr(c).isdigit() and c < 128 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same words before A-Z are made small.
_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[bytes]:
    return utf8(text).translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows of each item marked.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(number[name], [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        short: dict[int, set[int]] = {}
        self.items: dict[int, set[int]] = {}
        self.least = window
        for n, seq in coded:
            seen: set[int] = set()
            state = 0
            for c in seq:
                state = self.next[state][c]
                at = state
                while at > 0 and at not in seen:
                    seen.add(at)
                    if self.length[self.link[at]] < window <= self.length[at]:
                        self.items.setdefault(at, set()).add(n)
                    at = self.link[at]
            if len(seq) < window:
                short.setdefault(state, set()).add(n)
                self.least = min(self.least, len(seq))
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: For each state of a window or more, its suffix state that holds the last window alone; zero for the others.
        self.top = [0] * len(self.link)
        for v in by_length:
            if self.length[v] >= window:
                self.top[v] = self.top[self.link[v]] or v
        #: Short items that end at a state, shortest first: those of its proper suffixes and its own.
        self.short: dict[int, list[tuple[int, set[int]]]] = {}
        if short:
            for v in by_length:
                found = self.short.get(self.link[v], [])
                if v in short:
                    found = [*found, (self.length[v], short[v])]
                if found:
                    self.short[v] = found

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        cur = self._state(self.length[last] + 1, {})
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = cur
            last = self.link[last]
        if last < 0:
            self.link[cur] = 0
        else:
            q = self.next[last][c]
            self.link[cur] = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        return cur

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans ``[start, end)`` of the words inside an item's windows, and the items' numbers."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        tops: set[int] = set()
        if len(words) < self.least or not self.words:
            return spans, items
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        known = np.r_[False, ids >= 0, False]
        edges = np.flatnonzero(known[1:] != known[:-1])
        starts, ends = edges[::2], edges[1::2]
        long_enough = ends - starts >= self.least
        next_, link, length, top, window = self.next, self.link, self.length, self.top, self.window
        for start, end in zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True):
            state = matched = 0
            for i, c in enumerate(ids[start:end].tolist(), start):
                while state and c not in next_[state]:
                    state = link[state]
                    matched = length[state]
                if c not in next_[state]:
                    continue
                state = next_[state][c]
                matched += 1
                back = 0
                if matched >= window:
                    tops.add(top[state])
                    back = matched
                for n, who in self.short.get(state, ()):
                    if n <= matched:
                        items |= who
                        back = max(back, n)
                if back:
                    first = i + 1 - back
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i + 1))
        return spans, items.union(*map(self.items.__getitem__, tops))


#: What a pass finds besides the columns it passes on, under names of its own.
_FOUND = T.StructType(
    [
        T.StructField("words", T.LongType()),
        T.StructField("hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """``(item, piece)``: the words of each item, long items in stretches that overlap by a window less one word.

    A stretch starts only where a whole window is left, so every window lies inside one.
    """
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(_WORD.pattern), F.lit(0))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words.alias("w")).filter(F.size("w") > 0)
    n = F.size("w")
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(most)), lambda i: (i == 0) | (n - i >= window))
    return rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(most + window - 1)))).alias("piece"))


def _automata(benchmark: DataFrame, window: int, shard_words: int) -> Iterator[Automaton]:
    """One automaton for each shard of items, about ``shard_words`` words each; longer items go to several."""
    pieces = _pieces(benchmark, window, max(window, shard_words // 4))
    total = pieces.agg(F.sum(F.size("piece"))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    for k in range(shards):
        rows = pieces.filter(F.pmod(F.xxhash64("item", "piece"), F.lit(shards)) == k).collect()
        yield Automaton([(r["item"], [utf8(w) for w in r["piece"]]) for r in rows], window)


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, Column]:
    """``docs`` with one more column, a struct: words, hit words, hit spans (flat word positions), items.

    Returns the rows and that column; its name clashes with none of ``docs``. Null and empty texts
    have no words and no hits. Items without words have no windows; an item whose id is null counts
    under the name "null"; items that repeat an id are one item. All columns and rows of ``docs``
    come back, repeated rows too. With several shards the documents are written once, with a row
    number; each shard reads only their texts and gives rows for those that it hits.
    """
    spark = docs.sparkSession
    name = fresh("found", docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, _FOUND)])
    automata = _automata(benchmark, window, shard_words)
    first, second = next(automata), next(automata, None)
    if second is None:
        return spread(docs).mapInArrow(_pass(spark.sparkContext.broadcast(first), docs.columns.index("text"), len(docs.columns), arrow_schema(schema)), schema), F.col(name)
    row = fresh("row", docs.columns)
    kept = settle(spread(docs).withColumn(row, F.monotonically_increasing_id()))
    found = T.StructType([T.StructField("row", T.LongType()), T.StructField("f", _FOUND)])
    hits = None
    for automaton in chain((first, second), automata):
        shared = spark.sparkContext.broadcast(automaton)
        here = settle(kept.select(F.col(row).alias("row"), "text").mapInArrow(_pass(shared, 1, 1, arrow_schema(found)), found).filter("f.hit > 0").select("row", "f.spans", "f.items"))
        shared.destroy()
        hits = here if hits is None else hits.unionByName(here)
    whole = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    whole = whole.select(F.col("row").alias(row), F.struct(_union_of_spans(F.col("spans")).alias("spans"), "items").alias(name))
    covered = F.aggregate(F.sequence(F.lit(0), F.size(F.col(name)["spans"]) - 2, F.lit(2)), F.lit(0).cast("long"), lambda a, i: a + F.get(F.col(name)["spans"], i + 1) - F.get(F.col(name)["spans"], i))
    none = F.struct(F.lit(0).cast("long").alias("hit"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
    count = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_ANY_WORD), F.lit(0))).cast("long")
    rest = F.when(F.col(name).isNull(), none).otherwise(F.struct(covered.alias("hit"), F.col(name)["spans"].alias("spans"), F.col(name)["items"].alias("items")))
    out = kept.join(whole, row, "left").withColumn(name, F.struct(count.alias("words"), rest["hit"].alias("hit"), rest["spans"].alias("spans"), rest["items"].alias("items")))
    return out.select(*docs.columns, name), F.col(name)


def _flat_union(spans) -> list[int]:
    """Merged spans of flat, possibly overlapping ones."""
    flat = list(map(int, spans))
    return [x for s in _merged(list(zip(flat[::2], flat[1::2], strict=True))) for x in s]


def _union_of_spans(spans: Column) -> Column:
    def run(column: pd.Series) -> pd.Series:
        return column.map(_flat_union)

    return F.pandas_udf(run, T.ArrayType(T.LongType()))(spans)


def _pass(shared, where: int, passed: int, schema: pa.Schema):
    """Function of batches: their first ``passed`` columns, and what the automaton finds in the texts of column ``where``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        kind = schema.field(len(schema) - 1).type
        for batch in batches:
            found = []
            for text in texts_of(batch.column(where)):
                words = words_of(text)
                spans, items = automaton.hits(words)
                found.append({"words": len(words), "hit": sum(e - s for s, e in spans), "spans": [x for s in spans for x in s], "items": sorted(automaton.names[i] for i in items)})
            yield pa.RecordBatch.from_arrays([*batch.columns[:passed], pa.array(found, type=kind)], schema=schema)

    return run


def is_contaminated(found: Column, coverage: int = COVERAGE) -> Column:
    return (found["hit"] > 0) & (found["hit"] * coverage >= found["words"])


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A row for every row of ``docs``, repeats and null ids too; other columns are not read.
    """
    rows, found = match(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return rows.select(
        "doc_id",
        found["words"].alias("n_words"),
        found["hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", found["items"]), 256).alias("items_sha256"),
        is_contaminated(found).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[int]) -> str:
    """The text without the characters from each span's first to its last word."""
    at = [m.span() for m in _WORD.finditer(ascii_lower(text))]
    out, done = [], 0
    for s, e in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[done : at[s][0]])
        done = at[e - 1][1]
    return "".join([*out, text[done:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """Drop documents above the coverage limit and cut the matched spans from the others' texts.

    Columns as in ``docs``; ``n_chars``, if there, follows the new text.
    """
    schema = docs.schema
    target, n = arrow_schema(schema), len(docs.columns)
    where = docs.columns.index("text")
    rows, found = match(docs, benchmark, window)
    kept = rows.filter(~is_contaminated(found, coverage)).select(*docs.columns, found["spans"].alias(fresh("spans", docs.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).to_pylist()
            new = [cut_spans(t, s) if s else t for t, s in zip(texts, batch.column(n).to_pylist(), strict=True)]
            columns = list(batch.columns[:n])
            columns[where] = pa.array(new, type=target.field(where).type)
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    cut = kept.mapInArrow(run, schema)
    return cut.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """Documents below the coverage limit, unchanged; the others go whole."""
    rows, found = match(docs, benchmark, window)
    return rows.filter(~is_contaminated(found, coverage)).select(*docs.columns)


SCAN_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, i, spots.n, item FROM spots JOIN windows ON spots.s = windows.s AND spots.n = windows.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit ON words.doc_id = hit.doc_id LEFT JOIN named ON words.doc_id = named.doc_id
"""
