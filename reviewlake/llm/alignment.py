"""Alignment of two tokenizers' tokens by byte offsets, and corpus-wide counts of linked ids.

Token ends are running sums of token bytes. Offsets where tokens of both sides end cut a text into
groups; inside them tokens whose byte ranges overlap are linked. All of it is array arithmetic over
many texts laid end to end, as ends of texts are common ends too.

Tasks count pairs of ids in blocks of texts before anything is shuffled, so that a pair costs a row
a block, however often it occurs. Blocks are written once to the checkpoint folder; the counts are
summed in two stages, salted by block first, joined back to the blocks' pairs, and meet their
documents there. Links themselves never leave their task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .common import arrow_schema, settle, spread, texts_of, utf8

#: Bytes of text that are aligned at once, and whose pairs are counted together; what a text weighs beside its own.
CHUNK, BLOCK, EACH = 1 << 18, 4 << 20, 16
#: Pairs of a row in a block's table; salts of the first summing stage.
ROW_PAIRS, SALTS = 1 << 16, 16
#: What splits a text before the merges of a byte-level vocabulary; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space that the rank encoder's pattern engine may not get through.
_LONG_SPACE = re.compile(r"\s{200}")

COUNTS = T.StructType([T.StructField(name, T.LongType()) for name in ("n_a", "n_b", "n_groups", "n_links")])


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Encoders:
    """Ids and token bytes of a byte-level BPE file (A) and a sentence-piece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in texts are plain text
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        size = max(self.a.get_vocab().values()) + 1
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.ranks = self._ranked(spec)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(t) for t in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        n, m = len(self.bytes_a), len(self.bytes_b)
        #: Decimal ids with the sign that follows them: in a group, at the end of its A side, of its B side.
        self.signs = [*(f"{i}," for i in range(n)), *(f"{i}|" for i in range(n)), *(f"{i}," for i in range(m)), *(f"{i};" for i in range(m))]

    def _ranked(self, spec: dict) -> tiktoken.Encoding | None:
        """A faster encoder with the same ids, if ids follow the order of merges and nothing else is configured; else none."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        plain = plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {self.bytes_a[i]: i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else utf8(piece.replace("▁", " "))

    def encode_a(self, text: str) -> list[int]:
        if self.ranks is None or _LONG_SPACE.search(text):
            return self.a.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides of each text; none where a side does not spell space and text exactly."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            whole = utf8(" " + text)
            a = self.encode_a(" " + text) if text else []
            same = text and b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            out.append((a, b) if same else ([], []))
        return out


@lru_cache(maxsize=2)
def encoders(path_a: str, path_b: str) -> Encoders:
    return Encoders(path_a, path_b)


def aligned(coder: Encoders, texts: list[str]) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts (n_a, n_b, n_groups, n_links) and groups of each text, and its distinct pairs.

    Pairs come as three arrays: the text's place, the key ``a * size_b + b`` and how often it is
    linked there, sorted by place and key.
    """
    ids = coder.encode(texts)
    size_b = len(coder.bytes_b)
    n_a, n_b = (np.array([len(x[side]) for x in ids], dtype=np.int64) for side in (0, 1))
    a, b = (np.concatenate([np.zeros(0, np.int64), *(np.array(x[side], dtype=np.int64) for x in ids)]) for side in (0, 1))
    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)  # tokens up to each text's end
    ends_a, ends_b = coder.length_a[a].cumsum(), coder.length_b[b].cumsum()
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    text_ends = np.concatenate([[0], ends_a])[last_a]
    n_groups = np.diff(np.searchsorted(cuts, text_ends, side="right"), prepend=0)
    # each A token overlaps the B tokens from the first that ends after its start to the first that does not end before its end
    first = np.searchsorted(ends_b, ends_a - coder.length_a[a], side="right")
    each = np.searchsorted(ends_b, ends_a) - first + 1
    before = np.cumsum(each) - each
    link_a = np.repeat(np.arange(len(a)), each)
    link_b = np.arange(len(link_a)) - np.repeat(before - first, each)
    n_links = np.diff(np.concatenate([[0], np.cumsum(each)])[last_a], prepend=0)
    keys = a[link_a] * size_b + b[link_b]
    every = len(coder.bytes_a) * size_b
    found, times = np.unique(np.repeat(np.arange(len(texts)), n_links) * every + keys, return_counts=True)
    # written form: A tokens of a group stand before its B tokens
    signs = np.empty(len(a) + len(b), dtype=np.int64)
    closes_a, closes_b = (np.diff(g, append=len(cuts)) > 0 for g in (group_a, group_b))
    signs[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + len(coder.bytes_a) * closes_a
    signs[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * len(coder.bytes_a) + b + size_b * closes_b
    bounds = [0, *(last_a + last_b).tolist()]
    groups = ["".join(map(coder.signs.__getitem__, signs[i:j].tolist()))[:-1] for i, j in pairwise(bounds)]
    return np.stack([n_a, n_b, n_groups, n_links]), groups, (found // every, found % every, times)


def _pack(*arrays: np.ndarray) -> bytes:
    """Equally long arrays as one compressed value, the first as differences."""
    n = len(arrays[0])
    raw = b"".join([np.diff(arrays[0], prepend=0).astype("<i8").tobytes(), *(x.astype("<i8").tobytes() for x in arrays[1:])])
    return n.to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(packed[:8], "little")
    raw = np.frombuffer(pa.decompress(packed[8:], decompressed_size=8 * n * columns, codec="zstd"), dtype="<i8").reshape(columns, n)
    return [raw[0].cumsum(), *raw[1:]]


def blocks(docs: DataFrame, paths: tuple[str, str] | None = None, with_groups: bool = False) -> DataFrame:
    """Aligned documents in blocks, written once: rows of documents (``seen``) and of block tables (``pairs``).

    ``seen`` packs the places of a document's pairs in its block's table and their counts;
    ``pairs`` packs keys and counts of a stretch of that table from place ``start``.
    """
    path_a, path_b = paths or default_paths()
    fields = [T.StructField("block", T.LongType()), T.StructField("start", T.LongType()), T.StructField("pairs", T.BinaryType()), docs.schema["doc_id"], *COUNTS.fields]
    fields += [T.StructField("groups_sha256", T.StringType()), T.StructField("seen", T.BinaryType()), *([T.StructField("groups", T.StringType())] if with_groups else [])]
    target = arrow_schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]))

    def table(block: int, doc_ids: list, counts: list[np.ndarray], digests: list[str], groups: list[str], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The rows of one block."""
        keys, place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        times = np.concatenate([p[2] for p in parts])
        sums = np.bincount(place, weights=times, minlength=len(keys)).astype(np.int64)
        starts = list(range(0, len(keys), ROW_PAIRS))
        packed = [_pack(keys[k : k + ROW_PAIRS], sums[k : k + ROW_PAIRS]) for k in starts]
        shifts = np.cumsum([0, *(c.shape[1] for c in counts)])
        owner = np.concatenate([p[0] + s for p, s in zip(parts, shifts, strict=False)])
        bounds = np.searchsorted(owner, np.arange(len(doc_ids) + 1))
        seen = [_pack(place[i:j], times[i:j]) for i, j in pairwise(bounds.tolist())]
        n, m = len(packed), len(doc_ids)
        each = np.concatenate(counts, axis=1)
        columns = [
            pa.array([block] * (n + m)),
            pa.array([*starts, *[None] * m], pa.int64()),
            pa.array([*packed, *[None] * m]),
            pa.array([*[None] * n, *doc_ids], target[3].type),
            *(pa.array([*[None] * n, *c.tolist()], pa.int64()) for c in each),
            pa.array([*[None] * n, *digests], pa.string()),
            pa.array([*[None] * n, *seen]),
        ]
        if with_groups:
            columns.append(pa.array([*[None] * n, *groups], pa.string()))
        yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoders(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        held: tuple[list, ...] = ([], [], [], [], [])
        size = 0
        for batch in batches:
            weights = (pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False) + EACH).tolist()
            at = 0
            while at < len(weights):
                end, chunk = at, 0
                while end < len(weights) and (end == at or chunk + weights[end] <= CHUNK):
                    chunk += weights[end]
                    end += 1
                if size and size + chunk > BLOCK:
                    yield from table(block, *held)
                    block, held, size = block + 1, ([], [], [], [], []), 0
                counts, groups, pairs = aligned(coder, texts_of(batch.column(1).slice(at, end - at)))
                held[0].extend(batch.column(0).slice(at, end - at).to_pylist())
                held[1].append(counts)
                held[2].extend(hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups)
                held[3].extend(groups if with_groups else [])
                held[4].append(pairs)
                size, at = size + chunk, end
        if held[0]:
            yield from table(block, *held)

    return settle(spread(docs.select("doc_id", "text")).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])))


def _block_pairs(held: DataFrame) -> DataFrame:
    """``(block, place, key, n)``: a row for each pair of a block's table."""
    schema = T.StructType([T.StructField(name, T.LongType()) for name in ("block", "place", "key", "n")])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, start, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, sums = _unpack(packed, 2)
                places = np.arange(start, start + len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(keys), block), places, keys, sums)], schema=target)

    return held.filter(F.col("pairs").isNotNull()).select("block", "start", "pairs").mapInArrow(run, schema)


def _totals(pairs: DataFrame) -> DataFrame:
    """``(key, total)``: salted sums by block first, so that a pair of all blocks is summed by several tasks."""
    salted = pairs.groupBy("key", F.pmod("block", F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    return salted.groupBy("key").agg(F.sum("n").alias("total"))


def pair_counts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """``(a_id, b_id, n)``: how many links of the corpus hold each pair of ids.

    Null and empty texts, and texts that a side does not spell exactly, have no links; repeated
    rows count each time.
    """
    size_b = len(encoders(*(paths or default_paths())).bytes_b)
    totals = _totals(_block_pairs(blocks(docs, paths)))
    return totals.select(F.expr(f"key div {size_b}").cast("int").alias("a_id"), (F.col("key") % size_b).cast("int").alias("b_id"), F.col("total").alias("n"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text.

    ``n_best`` counts links whose pair is the commonest of its B id in the whole corpus (ties
    included), ``count_sum`` adds the pairs' corpus counts over the links; ``with_groups`` adds the
    groups as ``a1,a2|b1;a3|b2``. Null and empty texts, and texts whose tokens of either side do
    not spell space and text exactly, have zeros and ''. A row for every row of ``docs``, repeats
    and null ids too; other columns are not read. ``paths`` must be readable on every executor.
    """
    size_b = len(encoders(*(paths or default_paths())).bytes_b)
    held = blocks(docs, paths, with_groups)
    pairs = _block_pairs(held)
    totals = settle(_totals(pairs))
    most = totals.groupBy((F.col("key") % size_b).alias("b")).agg(F.max("total").alias("most"))
    # one row for each B id at most, so the vocabulary's size bounds what is sent
    judged = totals.join(F.broadcast(most), F.col("key") % size_b == F.col("b")).select("key", "total", (F.col("total") == F.col("most")).alias("best"))
    counted = pairs.select("block", "place", "key").join(judged, "key").select("block", "place", "total", "best")
    names = ["doc_id", *COUNTS.names, "groups_sha256", *(["groups"] if with_groups else [])]
    rows = held.filter(F.col("pairs").isNull()).select("block", *names, "seen")
    ordered = ["doc_id", *COUNTS.names, "n_best", "count_sum", *names[len(COUNTS) + 1 :]]
    kinds = {f.name: f for f in held.schema.fields} | {name: T.StructField(name, T.LongType()) for name in ("n_best", "count_sum")}
    schema = T.StructType([kinds[name] for name in ordered])
    target = arrow_schema(schema)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right["place"].to_numpy()
        total, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        total[place], best[place] = right["total"].to_numpy(), right["best"].to_numpy()
        n_best, count_sum = [], []
        for packed in left["seen"].to_pylist():
            at, times = _unpack(packed, 2)
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * total[at]).sum()))
        made = {"n_best": pa.chunked_array([pa.array(n_best, pa.int64())]), "count_sum": pa.chunked_array([pa.array(count_sum, pa.int64())])}
        return pa.Table.from_arrays([made[name] if name in made else left[name].cast(target.field(name).type) for name in ordered], schema=target)

    return rows.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(judge, schema)
