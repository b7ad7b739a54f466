"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a log scale: an n-gram of level q is stored
as the q keys (n-gram, 1) .. (n-gram, q). A reader probes levels in turn until one misses and
so recovers the quantised count; probabilities are the pair's count smoothed towards the
word's. A pair counts no more often than either of its words, and the mass that false hits are
expected to add to a history is part of its total, so that the probabilities of the words after
it add up to one whatever the vocabulary's size. Counting is exact and distributed by n-gram hash; each hash group builds its own part
of the filter, sized by its keys, so the filter grows with the corpus. It is broadcast up to
``FILTER_BYTES``; of a larger one each task holds a range of parts, the texts' hashes are sent
there to be probed, and the levels sent back: memory is bounded and the error rate does not rise.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, held_out, settle, spread, texts_of, utf8

FOLDS, HELD = 7, 2
#: The token after a text's last word; no word holds a line feed.
END = b"\n"
#: Bits that a filter part aims at for each stored key, probes of each, and the bound on a filter that is broadcast, or on the parts that a task holds.
BITS_PER_KEY, PROBES, FILTER_BYTES = 10, 4, 64 << 20
#: Ranges of a filter too large to be broadcast for each shuffle partition.
RANGES_A_TASK = 4
#: Levels per doubling of a count, and the largest level.
PER_DOUBLING, TOP_LEVEL = 1, 40
#: Tokens of training text for each hash group, and the bounds on their number.
GROUP_TOKENS, LEAST_GROUPS, MOST_GROUPS = 1 << 20, 16, 1 << 20
#: Weights that the word model may have in a pair's probability; the one that suits all training texts best is taken, each
#: token judged by the other occurrences of its pair.
PRIORS = (5.0, 20.0, 100.0, 300.0, 1000.0, 3000.0, 10000.0)
#: Most frequent tokens whose exact counts are broadcast; the others are joined.
HEAD_TOKENS = 200_000
#: Distinct tokens, and word pairs, that a task holds before it passes their counts on.
FLUSH, FLUSH_PAIRS = 400_000, 3_000_000


def tokens_of(text: str) -> list[bytes]:
    return [*utf8(text).lower().split(), END]


def level_of(count: np.ndarray) -> np.ndarray:
    """1 for a count of one, one more for each doubling."""
    return np.minimum(1 + np.floor(PER_DOUBLING * np.log2(count) + 1e-9).astype(np.int64), TOP_LEVEL)


def _values() -> np.ndarray:
    """Count that each level stands for, none for level zero: the mean of its counts, where a count ``c`` is as frequent as ``1 / c^2``."""
    out = [0.0]
    for level in range(1, TOP_LEVEL + 1):
        low, high = math.ceil(2 ** ((level - 1) / PER_DOUBLING)), math.ceil(2 ** (level / PER_DOUBLING))
        if high > 1 << 16:
            out.append(math.log(high / low) / (1 / low - 1 / high))
            continue
        c = np.arange(low, max(high, low + 1), dtype=np.float64)
        out.append(float((1 / c).sum() / (1 / c**2).sum()))
    return np.array(out)


_VALUES = _values()


def value_of(level: np.ndarray) -> np.ndarray:
    return _VALUES[level]


_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


#: Bytes of a hash that count; the others are zero, so that pieces of counts travel small.
HASH_BYTES = 6
_KEPT = np.uint64((1 << 64) - (1 << (64 - 8 * HASH_BYTES)))


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it."""
    return mix(words[:-1] * _M3 + words[1:]) & _KEPT


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens)) & _KEPT


def pack_hashes(hashes: np.ndarray) -> bytes:
    """Sorted hashes byte plane by byte plane, so that their like leading bytes compress."""
    return np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].T).tobytes()


def unpack_hashes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(HASH_BYTES, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :HASH_BYTES] = planes.T
    return out.view(">u8").ravel().astype(np.uint64)


def _positions(hashes: np.ndarray, level: int | np.ndarray, bits: np.ndarray | int) -> list[np.ndarray]:
    """Bit numbers of a key in a part of a power of two bits."""
    base = mix(hashes ^ (np.asarray(level, dtype=np.uint64) * _M3))
    step = (base >> np.uint64(32)) | np.uint64(1)
    mask = np.asarray(bits, dtype=np.uint64) - np.uint64(1)
    return [(base + np.uint64(k) * step) & mask for k in range(PROBES)]


def false_hits(part: np.ndarray) -> float:
    """Share of absent keys that a part, as packed bits, answers as present."""
    return float((np.bitwise_count(part).sum(dtype=np.int64) / (8 * len(part))) ** PROBES)


def build_part(hashes: np.ndarray, counts: np.ndarray, most_bits: int = 1 << 62) -> bytes:
    """Filter part of a hash group, sized by its keys, as packed bits."""
    levels = level_of(counts)
    keys = int(levels.sum())
    bits = 1 << max(6, min(most_bits.bit_length() - 1, math.ceil(math.log2(max(1, keys * BITS_PER_KEY)))))
    if bits > 64 and keys * BITS_PER_KEY < 0.75 * bits:  # nearer to the size below
        bits >>= 1
    part = np.zeros(bits, dtype=bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        for at in _positions(hashes[levels >= q], q, bits):
            part[at.astype(np.int64)] = True
    return np.packbits(part, bitorder="little").tobytes()


class LogBloom:
    """Parts of the filter, from group ``first`` of ``groups``, laid end to end; the top bits of a hash name its group."""

    def __init__(self, parts: list[bytes] | list[np.ndarray], first: int = 0, groups: int | None = None, data: np.ndarray | None = None):
        self.first, self.groups = first, groups or len(parts)
        self.shift = np.uint64(64 - (self.groups.bit_length() - 1))
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.bits = (sizes * 8).astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.data = np.frombuffer(b"".join(parts), dtype=np.uint8) if data is None else data

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Probe level after level until one misses; zero for hashes of groups that are not here."""
        out = np.zeros(len(hashes), dtype=np.int64)
        group = (hashes >> self.shift).astype(np.int64) - self.first if self.groups > 1 else np.zeros(len(hashes), dtype=np.int64)
        alive = np.flatnonzero((group >= 0) & (group < len(self.starts)))
        group = np.clip(group, 0, len(self.starts) - 1)
        start, bits = self.starts[group], self.bits[group]
        for q in range(1, TOP_LEVEL + 1):
            hit = np.ones(len(alive), dtype=bool)
            for at in _positions(hashes[alive], q, bits[alive]):
                byte = self.data[start[alive] + (at >> np.uint64(3)).astype(np.int64)]
                hit &= (byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            if not len(alive):
                break
            out[alive] = q
        return out


class Model:
    """Smoothed log10 probabilities from the filter and the two totals."""

    def __init__(self, bloom: LogBloom, n: int, v: int, wrong: float, whole: bool = False):
        self.bloom, self.n, self.v = bloom, n, v
        #: Whether every token's count is known exactly, so that none needs the filter's.
        self.whole = whole
        #: Count that false hits are expected to give the words after a history, all together.
        self.extra = wrong / (1.0 - min(wrong, 0.5)) * v

    def levels_of(self, texts: list[np.ndarray], found: list[bytes | None] | None = None) -> np.ndarray:
        """Two rows of levels over all tokens: of each token, and of each with the one before it.

        ``found`` holds what other ranges of the filter gave for each text, as ``pack_levels`` made it.
        """
        flat = np.concatenate(texts)
        out = np.zeros((2, len(flat)), dtype=np.uint8)
        unique, back = np.unique(flat, return_inverse=True)
        out[0] = self.bloom.levels(unique)[back]
        if len(flat) > 1:
            pairs, where = np.unique(pair_hashes(flat), return_inverse=True)
            out[1, 1:] = self.bloom.levels(pairs)[where]
        if found and found[0] is not None:
            out = np.maximum(out, np.concatenate([np.frombuffer(f, dtype=np.uint8).reshape(2, -1) for f in found], axis=1))
        return out

    def _counts(self, texts: list[np.ndarray], exact: np.ndarray, found: list[bytes | None] | None) -> tuple[np.ndarray, ...]:
        """Over all tokens: its count, that of its pair and of the token before, and whether it opens a text.

        ``exact`` holds counts of tokens that are known exactly, zero for others, whose counts the filter gives.
        """
        levels = value_of(self.levels_of(texts, found))
        first = np.zeros(levels.shape[1], dtype=bool)
        first[np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])] = True
        own = exact if self.whole else np.where(exact > 0, exact, levels[0])
        before = np.r_[0.0, own[:-1]]
        return own, np.minimum(levels[1], np.minimum(own, before)), before, first

    def _pair(self, word: np.ndarray, seen: np.ndarray, before: np.ndarray, prior: float) -> np.ndarray:
        """Probability of a token after another: its pair's share of what the history counts, false hits included, and the word model's."""
        weight = before / (before + prior)
        return weight * seen / np.maximum(before + self.extra, 1.0) + (1.0 - weight) * word

    def score_all(self, texts: list[np.ndarray], exact: np.ndarray, prior: float, found: list[bytes | None] | None = None) -> np.ndarray:
        """log10 probability of each text, given the hashes of its tokens and their exact counts where known."""
        return self._scores(*self._counts(texts, exact, found), prior) if texts else np.zeros(0)

    def _scores(self, own: np.ndarray, seen: np.ndarray, before: np.ndarray, first: np.ndarray, prior: float) -> np.ndarray:
        word = (own + 1.0) / (self.n + self.v + 1.0)
        p = np.where(first, word, self._pair(word, seen, before, prior))
        return np.add.reduceat(np.log10(np.minimum(p, 1.0)), np.flatnonzero(first))

    def score_each(self, texts: list[np.ndarray], exact: np.ndarray, training: np.ndarray, found: list[bytes | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``PRIORS`` a column: ``score_all`` of each text, and the left-out likelihood of those that are training texts.

        Left out: the log10 likelihood of a text's tokens after its first, each without its own occurrence; zero for other texts.
        """
        if not texts:
            return np.zeros((0, len(PRIORS))), np.zeros((0, len(PRIORS)))
        counts = own, seen, before, first = self._counts(texts, exact, found)
        scores = np.stack([self._scores(*counts, prior) for prior in PRIORS], axis=1)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        judged = ~first & training[row]
        row = row[judged]
        own, seen, before = (np.maximum(x[judged] - 1.0, 0.0) for x in (own, seen, before))
        word = (own + 1.0) / (self.n + self.v + 1.0)
        left = [np.bincount(row, weights=np.log10(self._pair(word, seen, before, prior)), minlength=len(texts)) for prior in PRIORS]
        return scores, np.stack(left, axis=1)


def exact_counts(head: dict[bytes, int], tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(head.get, tokens, repeat(0)), dtype=np.float64, count=len(tokens))


def pack_levels(levels: np.ndarray, texts: list[np.ndarray]) -> list[bytes]:
    """Levels of each text, to carry from one range of the filter to the next."""
    cuts = np.cumsum([0, *map(len, texts)])
    return [levels[:, a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def token_counts(training: DataFrame) -> DataFrame:
    """``(token, n)``: exact counts, combined within each task before the shuffle."""
    schema = T.StructType([T.StructField("token", T.BinaryType()), T.StructField("n", T.LongType())])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=target)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                counts.update(tokens_of(text))
                if len(counts) > FLUSH:
                    yield flush()
                    counts.clear()
        yield flush()

    return training.select("text").mapInArrow(run, schema).groupBy("token").agg(F.sum("n").alias("n"))


def _groups(tokens: int) -> int:
    return max(LEAST_GROUPS, min(MOST_GROUPS, 1 << math.ceil(math.log2(max(1, tokens / GROUP_TOKENS)))))


def filter_parts(training: DataFrame, counted: DataFrame, tokens: int) -> tuple[DataFrame, int]:
    """``(part, bits, false_hits)``, the filter over all words and word pairs of the training texts by hash group, and the number of groups."""
    groups = _groups(tokens)
    shift = np.uint64(64 - (groups.bit_length() - 1))
    packed = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("hashes", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    packed_schema = arrow_schema(packed)

    def dealt(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """Sorted hashes cut at group borders, a row for each group."""
        part = (hashes >> shift).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(groups + 1))
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        c = counts.astype("<u4")
        rows = [(int(k), pack_hashes(hashes[cuts[k] : cuts[k + 1]]), c[cuts[k] : cuts[k + 1]].tobytes()) for k in full]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], packed_schema.field(i).type) for i in range(3)], schema=packed_schema)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in texts_of(batch.column(0)):
                h = word_hashes(tokens_of(text))
                if len(h) > 1:
                    held.append(pair_hashes(h))
                    size += len(h) - 1
                if size > FLUSH_PAIRS:
                    yield dealt(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if held:
            yield dealt(*np.unique(np.concatenate(held), return_counts=True))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = word_hashes(batch.column(0).to_pylist())
            order = np.argsort(h, kind="stable")
            yield dealt(h[order], np.minimum(batch.column(1).to_numpy(), 2**32 - 1)[order])

    built = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("bits", T.BinaryType()), T.StructField("false_hits", T.DoubleType())])
    built_schema = arrow_schema(built)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group's pieces are merged whenever they outgrow what is merged already."""
        part, hashes, counts, merged = -1, [], [], 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            h, where = np.unique(np.concatenate(hashes), return_inverse=True)
            return h, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)

        def out() -> pa.RecordBatch:
            bits = build_part(*fold())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits], pa.binary()), pa.array([false_hits(np.frombuffer(bits, np.uint8))])], schema=built_schema)

        for batch in batches:
            for k, h, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != part and part >= 0:
                    yield out()
                    hashes, counts, merged = [], [], 0
                part = k
                hashes.append(unpack_hashes(h))
                counts.append(np.frombuffer(c, dtype="<u4").astype(np.int64))
                if sum(map(len, hashes)) > 2 * merged + (1 << 22):
                    a, b = fold()
                    hashes, counts, merged = [a], [b], len(a)
        if part >= 0:
            yield out()

    pieces = training.select("text").mapInArrow(pairs, packed).unionByName(counted.select("token", "n").mapInArrow(words, packed))
    return settle(pieces.repartition("part").sortWithinPartitions("part").mapInArrow(build, built)), groups


def ranges_of(kept: DataFrame, groups: int) -> tuple[list[int], dict[int, int], float]:
    """First group of each range of at most ``FILTER_BYTES``, the bytes of each group, and the share of false hits over all.

    Groups without keys have eight bytes. Where there is more than one range they are cut smaller,
    into several for each shuffle partition, so that all cores probe.
    """
    known = kept.select("part", F.length("bits"), "false_hits").collect()  # three numbers for each group
    sizes = {r[0]: r[1] for r in known}
    wrong = sum(r[2] for r in known) / groups
    total = sum(sizes.get(k, 8) for k in range(groups))
    tasks = RANGES_A_TASK * int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = FILTER_BYTES if total <= FILTER_BYTES else min(FILTER_BYTES, -(-total // tasks))
    opens, held = [0], 0
    for k in range(groups):
        held += (size := sizes.get(k, 8))
        if held > most and k > opens[-1]:
            opens.append(k)
            held = size
    return opens, sizes, wrong


def whole_filter(kept: DataFrame, groups: int, sizes: dict[int, int]) -> LogBloom:
    """The filter in one piece, on the driver."""
    ends = np.cumsum([0, *(sizes.get(k, 8) for k in range(groups))])
    data = np.zeros(int(ends[-1]), dtype=np.uint8)
    parts = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    for k, bits in kept.select("part", "bits").toLocalIterator():  # so that the driver holds it once
        parts[k][:] = np.frombuffer(bits, dtype=np.uint8)
    return LogBloom(parts, 0, groups, data)


def train(docs: DataFrame) -> tuple[DataFrame, int, DataFrame, int, int]:
    """Filter parts and their number, the table of exact token counts, and the two totals, from the training rows."""
    training = spread(docs.select("doc_id", "text")).filter(~held_out(F.col("doc_id"), FOLDS, HELD)).select(F.coalesce("text", F.lit("")).alias("text"))
    counted = settle(token_counts(training))
    n, v = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return *filter_parts(training, counted, n), counted, n, v


#: Rows of a batch whose hashes are probed together where the filter is not broadcast, as a power of two.
BATCH_BITS = 11


def _keys_of(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Token hashes of each text, and the sorted hashes of all its tokens and pairs."""
    hashes = [word_hashes(tokens_of(t)) for t in texts]
    return hashes, np.unique(np.concatenate([*hashes, *(pair_hashes(h) for h in hashes)]))


def _each(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch one by one, so that no second copy of it is held."""
    for k in range(batch.num_rows):
        yield tuple(column[k].as_py() for column in batch.columns)


def probed(texts: DataFrame, kept: DataFrame, opens: list[int], groups: int) -> DataFrame:
    """``texts`` (row, doc_id, held_out, text, levels; settled) with all levels, where the filter is too large to be broadcast.

    Batches of texts send the hashes they need to the range of the filter that holds them, once
    each; a task holds one range of parts while its probes stream past, and the levels go back to
    the batch, in the hashes' order. Work and what is moved grow with the texts, whatever the filter's size.
    """
    shift = np.uint64(64 - (groups.bit_length() - 1))
    starts = np.array(opens, dtype=np.int64)
    sent = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("data", T.BinaryType())])
    sent_schema = arrow_schema(sent)
    back = T.StructType([T.StructField("batch", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("levels", T.BinaryType())])
    back_schema = arrow_schema(back)
    out_schema = arrow_schema(texts.schema)

    def rows_of(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            where = np.searchsorted(starts, keys, side="right") - 1
            yield rows_of([where.tolist(), [0] * len(keys), keys.tolist(), batch.column(1).to_pylist()], sent_schema)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            _, keys = _keys_of(held)
            where = np.searchsorted(starts, (keys >> shift).astype(np.int64), side="right") - 1
            cuts = np.searchsorted(where, np.arange(len(starts) + 1))
            full = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            return rows_of([full, [1] * len(full), [now] * len(full), [pack_hashes(keys[cuts[k] : cuts[k + 1]]) for k in full]], sent_schema)

        now, held = None, []
        for batch in batches:
            for row, text in _each(batch):
                if held and row >> BATCH_BITS != now:
                    yield out()
                    held = []
                now = row >> BATCH_BITS
                held.append(text or "")
        if held:
            yield out()

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, bloom = None, {}, None
        for batch in batches:
            for where, kind, key, data in _each(batch):
                if where != now:
                    now, held, bloom = where, {}, None
                if kind == 0:
                    held[key] = data
                    continue
                if bloom is None:
                    end = opens[where + 1] if where + 1 < len(opens) else groups
                    bloom = LogBloom([held.get(k, bytes(8)) for k in range(opens[where], end)], opens[where], groups)
                    held = {}
                yield rows_of([[key], [0], [where], [bloom.levels(unpack_hashes(data)).astype(np.uint8).tobytes()]], back_schema)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            hashes, keys = _keys_of([t or "" for t in rows[3]])
            levels = np.frombuffer(b"".join(found), dtype=np.uint8)
            packed = []
            for h in hashes:
                both = np.zeros((2, len(h)), dtype=np.uint8)
                both[0], both[1, 1:] = levels[np.searchsorted(keys, h)], levels[np.searchsorted(keys, pair_hashes(h))]
                packed.append(both.tobytes())
            return rows_of([*rows, packed], out_schema)

        now, found, rows = None, [], [[], [], [], []]
        for batch in batches:
            for number, kind, _, levels, *row in _each(batch):
                if number != now and rows[0]:
                    yield out()
                if number != now:
                    now, found, rows = number, [], [[], [], [], []]
                if kind == 0:
                    found.append(levels)
                else:
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
        if rows[0]:
            yield out()

    asked = kept.select("part", "bits").mapInArrow(parts, sent).unionByName(texts.select("row", "text").mapInArrow(probes, sent))
    told = asked.repartition("range").sortWithinPartitions("range", "kind", "key").mapInArrow(answers, back)
    mine = texts.select(F.shiftright("row", BATCH_BITS).alias("batch"), F.lit(1).alias("kind"), F.col("row").alias("at"), F.lit(None).cast("binary").alias("levels"), "row", "doc_id", "held_out", "text")
    both = mine.unionByName(told, allowMissingColumns=True)
    return both.repartition("batch").sortWithinPartitions("batch", "kind", "at").mapInArrow(gathered, texts.schema)


def head_count(counted: DataFrame, most: int = HEAD_TOKENS) -> int:
    """Count above which at most ``most`` tokens lie; zero if all do.

    Read off a histogram of counts on a log scale, which is small whatever the vocabulary.
    """
    level = F.floor(F.log2("n") * 16)
    steps = counted.groupBy(level.alias("level")).agg(F.count("*").alias("tokens"), F.min("n").alias("low"), F.max("n").alias("high")).orderBy(F.desc("level")).collect()
    total, least = 0, steps[0]["high"] if steps else 0
    for row in steps:
        total += row["tokens"]
        if total > most:
            return least
        least = row["low"] - 1
    return 0


def best_prior(rows: DataFrame) -> int:
    """Place of the prior of best left-out likelihood over all training texts, from rows with ``left``; the first of equals."""
    sums = rows.agg(*[F.sum(F.col("left")[k]) for k in range(len(PRIORS))]).first()
    return max(range(len(PRIORS)), key=lambda k: (sums[k] or 0.0, -k))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Null and empty texts are their end token alone. A row whose id is null is training text.
    Without training rows every count is zero. Rows are scored one by one, so repeats agree.
    Exact counts of the most frequent tokens, a bounded number, are broadcast; the others are
    joined on the token, and the sums brought back to their rows by a row number. The filter is
    broadcast up to ``FILTER_BYTES``; the parts of a larger one stay where they are (``probed``).
    """
    spark = docs.sparkSession
    kept, groups, counted, n, v = train(docs)
    opens, sizes, wrong = ranges_of(kept, groups)
    broadcast = len(opens) == 1
    texts = spread(docs.select("doc_id", "text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "text", F.lit(None).cast("binary").alias("levels"))
    texts = texts if broadcast else settle(texts)
    least = head_count(counted)
    whole = least == 0
    # a filter that answers nothing where the levels come with the texts
    model = Model(whole_filter(kept, groups, sizes) if broadcast else LogBloom([bytes(8)], groups, groups), n, v, wrong, whole)
    head = dict(map(tuple, counted.filter(F.col("n") > least).collect()))
    head = {bytes(k): c for k, c in head.items()}
    shared = spark.sparkContext.broadcast((model, head))
    if not broadcast:
        texts = probed(texts, kept, opens, groups)
    unseen = -math.log10(n + v + 1.0)
    rare = T.StructType([T.StructField("token", T.BinaryType()), T.StructField("n", T.IntegerType())])
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            docs.schema["doc_id"],
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("known", T.LongType()),
            T.StructField("base", T.DoubleType()),
            T.StructField("scores", T.ArrayType(T.DoubleType())),
            T.StructField("left", T.ArrayType(T.DoubleType())),
            T.StructField("rare", T.ArrayType(rare)),
        ]
    )
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                sizes, known, base, tails, hashes, exact = [], [], [], [], [], []
                for text in texts_of(piece.column(3)):
                    tokens = tokens_of(text)
                    hashes.append(word_hashes(tokens))
                    counts = exact_counts(head, tokens)
                    exact.append(counts)
                    found = counts > 0
                    sizes.append(len(tokens))
                    known.append(int(found.sum()))
                    base.append(float(np.log10(counts[found] + 1.0).sum()) + unseen * len(tokens))
                    tails.append([] if whole else list(Counter(tokens[i] for i in np.flatnonzero(~found).tolist()).items()))
                flat = [p for t in tails for p in t]
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in tails])]).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.binary()), pa.array([p[1] for p in flat], pa.int32())], names=["token", "n"])
                lists = pa.ListArray.from_arrays(pa.array(offsets), structs).cast(target.field("rare").type)
                training = ~np.array(piece.column(2).to_pylist(), dtype=bool)
                scores, left = (pa.array(list(x), target.field("left").type) for x in model.score_each(hashes, np.concatenate(exact), training, piece.column(4).to_pylist()))
                columns = [piece.column(0), piece.column(1), piece.column(2), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), scores, left, lists]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    # scores by each prior in one pass over the texts; all training texts then tell which prior it is
    rows = settle(texts.mapInArrow(run, schema))
    rows = rows.withColumn("score", F.col("scores")[best_prior(rows)]).drop("scores", "left")
    fixed = [F.col("doc_id"), F.col("held_out"), F.col("n_tokens")]
    if whole:
        return rows.select(*fixed, F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
    tail = rows.select("row", F.explode("rare").alias("r")).select("row", "r.token", F.col("r.n").alias("times"))
    sums = tail.join(counted.filter(F.col("n") <= least), "token").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("add"))
    return rows.drop("rare").join(sums, "row", "left").select(
        *fixed,
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("add", F.lit(0.0))).alias("base_score"),
        "score",
    )
