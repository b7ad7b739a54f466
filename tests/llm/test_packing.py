"""Packing against the tokenizers library, exact optima of small cases, and its bounds."""

from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from tokenizers import Tokenizer

from reviewlake.llm import bpe, packing, queries

DOCS = "doc_id long, text string"


def check(rows, capacity=packing.CAPACITY):
    """Each piece lies in one sequence, gapless from 0 and within capacity; the number of sequences."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(held)


def test_query_on_whole_documents(spark):
    where = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    rows = queries.queries()["op12_best_fit_packing"](spark, where).collect()
    library = Tokenizer.from_file(bpe.default_path())
    want = []
    for d in docs.select("doc_id", "text").collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((d.doc_id, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    lengths = [w[3] for w in want]
    assert check(rows) == sum(n == 2048 for n in lengths) + packing.fewest([n for n in lengths if n < 2048], 2048)


def test_ids_of_odd_texts():
    coder, library = bpe.encoder(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    r = random.Random(5)
    texts = ["", " ", "a\x1cb\x1f c\x1d", "<|endoftext|> x<|startoftext|>", "İstanbul ΣΑΣ é ﬁ", "don't  we'LL　日本 x\x85y\xa0z", "x" * 5000, "word " * 3000, "🙂" * 70 + " 🙂"]
    texts += ["".join(r.choice(["a", "B", " ", "'s", "\x1e", "\t", "9", "é", "!", "日", "​", "<|endoftext|>"]) for _ in range(60)) for _ in range(500)]
    for t in [*texts, *texts]:
        assert list(struct.unpack(f"<{len(coder.ids(t)) // 4}I", coder.ids(t))) == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("bound", [0, 200, 1 << 20])
def test_ids_while_memory_is_forgotten(monkeypatch, bound):
    monkeypatch.setattr(bpe, "CACHE_BYTES", bound)
    coder, library = bpe.Encoder(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    for k in range(30):
        t = f"some words, {k} and others: {k * 7919}"
        assert list(struct.unpack(f"<{len(coder.ids(t)) // 4}I", coder.ids(t))) == library.encode(t, add_special_tokens=False).ids


def optimum(lengths, capacity):
    """Fewest bins, by trying all fillings."""
    lengths = tuple(sorted(lengths, reverse=True))

    @lru_cache(None)
    def least(rest):
        if not rest:
            return 0
        best = len(rest)

        def fill(k, room, kept):
            nonlocal best
            if k == len(rest):
                best = min(best, 1 + least(kept))
                return
            if rest[k] <= room:
                fill(k + 1, room - rest[k], kept)
            fill(k + 1, room, (*kept, rest[k]))

        fill(1, capacity - rest[0], ())
        return best

    return least(lengths)


def test_small_cases_against_the_optimum():
    r = random.Random(12)
    wrong = searched = 0
    for _ in range(150):
        capacity = r.choice([10, 17, 30])
        lengths = [r.randint(1, r.choice([capacity, capacity // 2])) for _ in range(r.randint(1, 9))]
        bins = packing.packed(lengths, capacity)
        assert sorted(k for b in bins for k in b) == list(range(len(lengths))) and all(0 < sum(lengths[k] for k in b) <= capacity for b in bins)
        best = optimum(lengths, capacity)
        assert packing.fewest(lengths, capacity) <= best <= len(bins) <= best + 1
        wrong += len(bins) > best
        searched += len(packing.best_fit(lengths, capacity)) > len(bins)
    assert wrong <= 3


def test_search_empties_bins_that_best_fit_leaves():
    cases = {
        "move": (10, [[6], [4]], [[6, 4]]),
        "one for one, then a move": (10, [[6, 3], [4], [7]], [[6, 4], [7, 3]]),
        "one for two": (12, [[6, 2, 2], [5]], [[6, 5], [2, 2]]),
        "two for one": (12, [[4, 7], [3, 2]], [[7, 3, 2], [4]]),
    }
    for name, (capacity, bins, want) in cases.items():
        assert [sorted(b) for b in packing.improve(bins, capacity, 0)] == [sorted(b) for b in want], name
    r = random.Random(3)
    for capacity, low, high, n in ((100, 20, 60, 800), (2048, 300, 900, 1500), (1000, 150, 420, 1500)):
        lengths = [r.randint(low, high) for _ in range(n)]
        first = packing.best_fit(lengths, capacity)
        out = packing.improve(first, capacity, packing.fewest(lengths, capacity))
        assert len(out) < len(first) and sorted(x for b in out for x in b) == sorted(lengths) and max(map(sum, out)) <= capacity
    assert len(packing.improve([[51]] * 40, 100, 40)) == 40 and packing.fewest([51] * 40, 100) == 40


def test_rounds_pack_as_well_as_one_shard(spark, monkeypatch):
    r = random.Random(7)
    rows = [(k, 0, "x", r.choice([r.randint(1, 2047), r.randint(1, 300), 700, 2048])) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, Offset string, length long").repartition(7)
    one = packing.pack(df).collect()
    monkeypatch.setattr(packing, "SHARD", 300)
    many = packing.pack(df).collect()
    for out in (one, many):
        assert sorted((x.doc_id, x.length) for x in out) == sorted((a, d) for a, _, _, d in rows)
    assert check(one) <= check(many) <= check(one) * 1.01 + 1


def test_ids_travel_with_the_pieces(spark):
    texts = [(1, None), (2, ""), (3, "two words"), (3, "two words"), (None, "a b c " * 1500), (5, "日本 " * 100)]
    df = spark.createDataFrame([(*t, 9) for t in texts], DOCS + ", sequence_id int")
    placed = packing.pack(packing.pieces(df, with_ids=True, capacity=1000), capacity=1000)
    coder = bpe.encoder(bpe.default_path())
    rows = placed.collect()
    check(rows, 1000)
    assert sorted((repr(r.doc_id), r.length) for r in rows if r.doc_id != None) == sorted([("1", 1), ("2", 1), ("3", 3), ("3", 3), ("5", len(coder.ids("日本 " * 100)) // 4 + 1)])  # noqa: E711
    assert sum(r.length for r in rows if r.doc_id is None) == 4501 and all(len(r.token_ids) == r.length and zlib.crc32(struct.pack(f"<{r.length}I", *r.token_ids)) == r.ids_crc32 for r in rows)
    whole = {s.sequence_id: s.token_ids for s in packing.sequences(placed).collect()}
    assert all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.token_ids for r in rows) and sum(map(len, whole.values())) == sum(r.length for r in rows)


def test_empty_table(spark):
    assert packing.sequence_table(spark.createDataFrame([], DOCS)).collect() == []


def test_long_documents_in_linear_time(spark):
    df = spark.createDataFrame([(1, "word " * 400_000), (2, "x" * 1_000_000)], DOCS)
    rows = packing.sequence_table(df).collect()
    check(rows)
    assert sum(r.length for r in rows if r.doc_id == 1) == 400_001
