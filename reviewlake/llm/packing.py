"""Best-fit packing of token sequences with a local search that empties bins by moves and swaps.

Documents become pieces of at most ``CAPACITY`` tokens (``pieces``), pieces share sequences of that
size (``pack``). Pieces are dealt evenly into shards. A shard is packed best fit, longest first;
then the emptiest bin gives pieces to other underfull bins: one moves, one is exchanged for one,
one for two or two for one, each step raising the sum of squared fills, until the bin is empty.
The emptiest bins of all shards are dealt again into an eighth of the shards, round after round
down to one, so that what is left over meets whatever the number of shards, and no task ever
holds more than a shard.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import default_path, encoder
from .common import arrow_schema, settle, spread

CAPACITY = 2048
#: Closes each document.
END = 0
#: Pieces of a shard, which one task packs at a time; one bin in so many goes on to the next round.
SHARD, CARRIED = 16_384, 8

PIECE = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
_PLACE = ("sequence_id", "offset")
_IDS = T.StructField("token_ids", T.ArrayType(T.IntegerType()))
#: Bytes of ids that one batch of pieces may carry.
BATCH_BYTES = 32 << 20


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of every whole text; ``with_ids`` adds token_ids.

    A document is its ids and ``END``; only longer ones are cut, into pieces of ``capacity`` ids and
    a last one of the rest. Null and empty texts are the end alone. Rows are independent: repeats
    give repeated pieces, null ids stay null, other columns are not read.
    """
    path = path or default_path()
    schema = T.StructType([docs.schema["doc_id"], *PIECE.fields, *([_IDS] if with_ids else [])])
    target = arrow_schema(schema)
    end, width = END.to_bytes(4, "little"), 4 * capacity

    def flushed(doc_ids: list, rows: list[tuple[int, int, int, int]], packed: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array(doc_ids, target[0].type), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(target)[1:5], strict=True))]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))).cast(target[5].type))
        return pa.RecordBatch.from_arrays(columns, schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            doc_ids, rows, packed, size = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    doc_ids.append(doc_id)
                    rows.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        packed.append(part)
                        size += len(part)
                    if size > BATCH_BYTES:
                        yield flushed(doc_ids, rows, packed)
                        doc_ids, rows, packed, size = [], [], [], 0
            if rows:
                yield flushed(doc_ids, rows, packed)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of lengths, longest first, each into the bin that it leaves fullest."""
    bins: list[list[int]] = []
    open_bins: dict[int, list[int]] = defaultdict(list)  # by room left
    rooms = 0  # bit r: a bin with room r is open
    for length in sorted(lengths, reverse=True):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            k = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(length)
        if room > length:
            open_bins[room - length].append(k)
            rooms |= 1 << (room - length)
    return bins


def fewest(lengths: list[int], capacity: int) -> int:
    """A bound below which no packing gets: by total length, and by pieces too long to share a bin with others."""
    by_length = np.bincount(np.asarray(lengths, dtype=np.int64), minlength=capacity + 1)
    sizes = np.arange(capacity + 1)
    count, total = np.cumsum(by_length), np.cumsum(by_length * sizes)
    best = -(-int(total[-1]) // capacity)
    for least in range(1, capacity // 2 + 1):  # pieces of at least this length; longer than the rest of a bin: alone
        alone = int(count[-1] - count[capacity - least])
        halves = int(count[capacity - least] - count[capacity // 2])
        room = halves * capacity - int(total[capacity - least] - total[capacity // 2])
        small = int(total[capacity // 2] - total[least - 1])
        best = max(best, alone + halves + max(0, -(-(small - room) // capacity)))
    return best


def _choices(items: list[int], gives: bool) -> list[tuple[int, tuple[int, ...]]]:
    """What a bin can part with in one exchange: a piece or two (by length, once each), or nothing where it only takes."""
    have = Counter(items)
    sizes = sorted(have)
    pairs = [(a + b, (a, b)) for k, a in enumerate(sizes) for b in sizes[k:] if a != b or have[a] > 1]
    return [*([] if gives else [(0, ())]), *((a, (a,)) for a in sizes), *pairs]


def improve(bins: list[list[int]], capacity: int, floor: int) -> list[list[int]]:
    """Empty bins by moves and exchanges between underfull ones, until ``floor`` bins are left or no step helps.

    The emptiest bin gives one or two pieces and takes none, one or two (never two for two), so
    that the other bin stays within ``capacity`` and grows: with ``d`` more in a bin of fill ``f``
    and ``d`` less in one of fill ``e`` the squares rise by ``2 d (f - e + d)``, and of all steps
    the one that raises them most is taken. A bin that cannot be emptied is set aside as it then is.
    """
    bins = [list(b) for b in bins]
    fill = [sum(b) for b in bins]
    left = sum(map(bool, bins))
    waiting = sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: -fill[k])
    offers: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    table: dict[int, np.ndarray] = {}  # per underfull bin: size given back, pieces in it, room, fill, bin

    def listed(k: int) -> None:
        offers.pop(k, None)
        table.pop(k, None)
        if 0 < fill[k] < capacity:
            offers[k] = _choices(bins[k], gives=False)
            n = len(offers[k])
            table[k] = np.stack([np.array([s for s, _ in offers[k]]), np.array([len(c) for _, c in offers[k]]), np.full(n, capacity - fill[k]), np.full(n, fill[k]), np.full(n, k), np.arange(n)])

    if left > floor:
        for k in waiting:
            listed(k)
    while left > floor and waiting:
        giver = min(waiting, key=lambda k: fill[k])
        while bins[giver]:
            others = [v for k, v in table.items() if k != giver]
            if not others:
                break
            back, pieces_back, room, held, owner, which = np.concatenate(others, axis=1)
            best, step = 0, None
            for size, given in _choices(bins[giver], gives=True):
                more = size - back
                fits = (more > 0) & (more <= room) & (len(given) + pieces_back <= 3)
                gain = np.where(fits, more * (held - fill[giver] + more), 0)
                at = int(gain.argmax())
                if gain[at] > best:
                    best, step = int(gain[at]), (given, int(owner[at]), int(which[at]))
            if step is None:
                break
            given, taker, k = step
            for length in given:
                bins[giver].remove(length)
                bins[taker].append(length)
            for length in offers[taker][k][1]:
                bins[taker].remove(length)
                bins[giver].append(length)
            fill[giver], fill[taker] = sum(bins[giver]), sum(bins[taker])
            listed(giver)
            listed(taker)
        left -= not bins[giver]
        waiting = [k for k in waiting if k != giver and 0 < fill[k] < capacity]
    return [b for b in bins if b]


def packed(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins, as positions in ``lengths``; each length from 1 to ``capacity`` lies in exactly one."""
    bins = improve(best_fit(lengths, capacity), capacity, fewest(lengths, capacity)) if lengths else []
    of_length: dict[int, list[int]] = defaultdict(list)
    for k in range(len(lengths) - 1, -1, -1):
        of_length[lengths[k]].append(k)
    return [[of_length[length].pop() for length in b] for b in bins]


def _round(rows: DataFrame, number: int, shards: int, capacity: int) -> DataFrame:
    """One round: sequence_id and offset of the pieces it places, null for those that go on; the last round places all."""
    names = [c for c in rows.columns if c.lower() not in _PLACE]
    base = rows.select(*names)
    schema = T.StructType([*base.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    target = arrow_schema(schema)
    at_length = names.index("length")

    def shard(batches: list[pa.RecordBatch], first: int) -> tuple[pa.RecordBatch, int]:
        whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        lengths = whole.column(at_length).to_pylist()
        bins = packed(lengths, capacity)
        if shards > 1:
            fill = [sum(lengths[i] for i in b) for b in bins]
            order = sorted(range(len(bins)), key=lambda k: fill[k])
            on = {k for k in order[: -(-len(bins) // CARRIED)] if fill[k] < capacity}
        else:
            on = set()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        goes_on = np.zeros(len(lengths), bool)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i], goes_on[i] = first + k, at, k in on
                at += lengths[i]
        columns = [*whole.columns, pa.array(sequence, mask=goes_on), pa.array(offset, mask=goes_on)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, target, strict=True)], schema=target), len(bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = number << 58 | TaskContext.get().partitionId() << 33
        held, rows_held = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, SHARD):
                held.append(part := batch.slice(k, SHARD))
                rows_held += part.num_rows
                if rows_held >= 2 * SHARD and shards > 1:
                    out, used = shard(held, first)
                    yield out
                    first, held, rows_held = first + used, [], 0
        if rows_held:
            yield shard(held, first)[0]

    return base.repartition(shards).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, with length from 1 to ``capacity``) with sequence_id and offset.

    The pieces of a sequence lie one after the other from offset 0 and fit its ``capacity``. Full
    pieces are sequences by themselves. Repeated rows are packed each for itself; null ids are
    packed like others; an empty table gives an empty one; columns sequence_id and offset are
    replaced. Each round is written to the checkpoint folder, so ids stay what they are.
    """
    pieces = settle(pieces.select(*(c for c in pieces.columns if c.lower() not in _PLACE)))
    # round 0; rounds after it count from 1 << 58
    placed = pieces.filter(F.col("length") == capacity).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity)
    number = 0
    while count := rest.count():
        number += 1
        shards = -(-count // SHARD)
        done = settle(_round(rest, number, shards, capacity))
        placed = placed.unionByName(done.filter(F.col("sequence_id").isNotNull()))
        if shards == 1:
            break
        rest = done.filter(F.col("sequence_id").isNull())
    return placed


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, token_ids)`` of packed pieces that carry their token_ids; a group is at most one capacity."""
    held = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "token_ids"))).alias("parts"))
    return held.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["token_ids"])).alias("token_ids"))


def sequence_table(docs: DataFrame) -> DataFrame:
    """Digest per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
