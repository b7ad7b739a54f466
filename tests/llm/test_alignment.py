"""Cross-tokenizer alignment against a token-by-token model with the libraries' own encoders."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reviewlake.llm import alignment, bpe, queries

DOCS = "doc_id long, text string"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTE = {c: b for b, c in enumerate(bpe.byte_symbols())}
NAMES = {i: bytes(BYTE[c] for c in t) for t, i in A.get_vocab().items()}


def piece(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def spans(ids, of):
    at, out = 0, []
    for i in ids:
        out.append((i, at, at + len(of(i))))
        at += len(of(i))
    return out


def model(text):
    """(n_a, n_b, groups, links) of one text by walking its tokens."""
    if not text:
        return 0, 0, [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    whole = (" " + text).encode()
    if b"".join(NAMES[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
        return 0, 0, [], []
    sa, sb = spans(a, NAMES.__getitem__), spans(b, piece)
    cuts = sorted({e for *_, e in sa} & {e for *_, e in sb})
    groups, start = [], 0
    for cut in cuts:
        groups.append(([i for i, _, e in sa if start < e <= cut], [i for i, _, e in sb if start < e <= cut]))
        start = cut
    links = [(i, j) for i, s, e in sa for j, u, v in sb if max(s, u) < min(e, v)]
    return len(a), len(b), groups, links


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(rows):
    made = [(i, *model(t)) for i, t in rows]
    total = Counter(pair for *_, links in made for pair in links)
    most = defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    out = []
    for i, n_a, n_b, groups, links in made:
        best = sum(total[p] == most[p[1]] for p in links)
        out.append((i, n_a, n_b, len(groups), len(links), best, sum(total[p] for p in links), hashlib.sha256(written(groups).encode()).hexdigest() if n_a else ""))
    return out, total


def texts():
    r = random.Random(11)
    fixed = [None, "", " ", "a", "▁ is no space", "tabs\tand\nlines  and   runs", "<|endoftext|> and <s> </s> <unk> <0x0A>", "日本語 🙂 ẞ ﬁ é", "x" * 300, " " * 900, "\x00 \x1c \x85\xa0", "don't we'll 12345", "same text", "same text", "same text"]
    return fixed + ["".join(r.choice(["the ", "un", "believ", "able", " ", "\n", "é", "日", "42", "'s", "Token", "ization", "🙂"]) for _ in range(r.randint(1, 30))) for _ in range(120)]


@pytest.mark.parametrize(("chunk", "block"), [(1 << 20, 16 << 20), (200, 700), (1, 1)])
def test_equals_a_token_by_token_model(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "BLOCK", block)
    rows = [(None if k == 7 else k // 2, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame([(*row, 1, "x") for row in rows], DOCS + ", n_a int, Block string").repartition(3)
    want, total = expected(rows)
    made = alignment.align(df, with_groups=True).collect()
    assert sorted((tuple(r)[:8] for r in made), key=repr) == sorted(want, key=repr)
    assert sorted(r.groups for r in made) == sorted(written(model(t)[2]) for _, t in rows)
    if block == 700:
        assert {(r.a_id, r.b_id): r.n for r in alignment.pair_counts(df).collect()} == total


def test_block_tables_of_several_rows(spark, monkeypatch):
    monkeypatch.setattr(alignment, "ROW_PAIRS", 7)
    rows = list(enumerate(texts()[:40]))
    assert sorted(map(tuple, alignment.align(spark.createDataFrame(rows, DOCS)).collect())) == sorted(expected(rows)[0])


def test_query_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    few = [(i, t[:2000] if t else t) for i, t in rows]  # the model is quadratic
    got = alignment.align(spark.createDataFrame(few, DOCS))
    assert sorted(map(tuple, got.collect())) == sorted(expected(few)[0])
    whole = queries.queries()["op11_token_alignment"](spark, sf)
    assert whole.columns == got.columns and whole.count() == len(rows)
    ids = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links) for r in whole.collect()}
    for i, t in rows:
        n_a, n_b, n_groups, n_links = ids[i]
        assert n_links == n_a + n_b - n_groups and n_a in (0, len(A.encode(" " + t, add_special_tokens=False).ids) if t else 0) and n_b in (0, len(B.encode(t)) if t else 0)


def test_library_and_ranks_give_equal_ids():
    coder = alignment.encoders(*alignment.default_paths())
    assert coder.ranks is not None
    for t in [*filter(None, texts()), " " * 5000 + "x", "\n" * 300, "　" * 250 + " end"]:
        assert coder.encode_a(" " + t) == A.encode(" " + t, add_special_tokens=False).ids, t


def test_other_vocabularies_use_the_library(tmp_path):
    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    merges = spec["model"]["merges"]
    merges[10], merges[11] = merges[11], merges[10]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    coder = alignment.Encoders(str(path), alignment.default_paths()[1])
    assert coder.ranks is None and coder.encode_a(" the end") == Tokenizer.from_file(str(path)).encode(" the end").ids


def test_empty_table_and_nothing_to_link(spark):
    assert alignment.align(spark.createDataFrame([], DOCS)).collect() == []
    got = alignment.align(spark.createDataFrame([(1, None), (1, None), (None, "")], DOCS)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 0, 0, 0, 0, 0, 0, "")] * 2 + [(None, 0, 0, 0, 0, 0, 0, "")], key=repr)


def test_long_texts_in_linear_time(spark):
    r = random.Random(1)
    rows = [(1, "word and more " * 70_000), (2, "".join(r.choice("abcdefgh \n") for _ in range(1_000_000))), (3, " " * 400_000)]
    got = {x.doc_id: x for x in alignment.align(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].n_a > 200_000 and all(x.n_links == x.n_a + x.n_b - x.n_groups for x in got.values())
