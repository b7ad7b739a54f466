"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so every
word is cut there for certain; so is every word end. The fragments are encoded each for
itself, once per worker, and their ids concatenated: the result equals encoding whole.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .common import arrow_schema, spread

#: Words, and fragments, whose encoding a worker remembers, and bytes of them; it forgets all when either is full.
CACHE_WORDS, CACHE_BYTES = 150_000, 16 << 20


#: Bytes of ids that one batch may carry.
BATCH_BYTES = 32 << 20
#: Stands for the end of a word where words are encoded by ranks; white space, so no word holds it.
WORD_END = "\n"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Encoder:
    """Encoder and decoder for a byte-level BPE file with word ends, as the tokenizers library reads it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        pieces = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pieces.replace(r"\s", r"\p{White_Space}"))
        self.symbols = byte_symbols()
        self.path = path
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Ids that the merges make, in their order.
        self._made = [self.vocab.get(a + b, -1) for a, b in merges]
        inside = {(a, b) for t in self.vocab for s in [t.removesuffix(self.end)] for a, b in zip(s, s[1:], strict=False)}
        back = {c: b for b, c in enumerate(self.symbols)}
        #: joined[a, b]: some token holds byte a right before byte b.
        self.joined = np.zeros((256, 256), dtype=bool)
        for a, b in inside:
            if a in back and b in back:
                self.joined[back[a], back[b]] = True
        self.allowed = [frozenset(np.flatnonzero(r).tolist()) for r in self.joined]
        self._words: dict[str, tuple[bytes, bytes]] = {}
        self._fragments: dict[tuple[bytes, bool], tuple[bytes, bytes]] = {}
        self._size = 0

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def fragments(self, word: bytes) -> list[bytes]:
        """The word cut at every byte pair that no token holds."""
        allowed = self.allowed
        cuts = [0, *(i for i in range(1, len(word)) if word[i] not in allowed[word[i - 1]]), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merge(self, fragment: bytes, ends_word: bool) -> list[int]:
        """Ids of a fragment by the merge table; only a fragment at a word's end takes the end mark."""
        text = "".join([self.symbols[b] for b in fragment])
        return [t.id for t in (self.last if ends_word else self.inner).tokenize(text)]

    def packed(self, fragment: bytes, ends_word: bool) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers and the tokens joined by spaces."""
        ids = self.merge(fragment, ends_word)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.tokens[i] for i in ids]).encode()

    def word(self, word: str) -> tuple[bytes, bytes]:
        """Packed ids and joined tokens of a word: those of its fragments, one after the other."""
        cut = self.fragments(word.encode("utf-8", "replace"))
        if len(cut) == 1:
            out = self.packed(cut[0], True)
        else:
            parts = []
            for k, fragment in enumerate(cut):
                key = (fragment, k == len(cut) - 1)
                found = self._fragments.get(key)
                if found is None:
                    found = self._fragments[key] = self.packed(*key)
                    self._size += len(fragment) + len(found[0]) + len(found[1])
                parts.append(found)
            out = (b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts]))
        self._size += len(word) + len(out[0]) + len(out[1])
        if len(self._words) + len(self._fragments) >= 2 * CACHE_WORDS or self._size > CACHE_BYTES:
            self._words.clear()
            self._fragments.clear()
            self._size = 0
        self._words[word] = out
        return out

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """``(ids, decoded)`` of a whole text: packed ids and the UTF-8 of decoding them."""
        ids: list[bytes] = []
        decoded: list[bytes] = []
        get, new = self._words.get, self.word
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                ids.append(self.added[part].to_bytes(4, "little"))
                decoded.append(part.encode())
                continue
            for w in self.pieces.findall(self.normalise(part)):
                a, b = get(w) or new(w)
                ids.append(a)
                decoded.append(b)
        return b"".join(ids), b" ".join(decoded)

    @cached_property
    def last(self) -> BPE:
        """The library's merging of a fragment that ends a word."""
        return Tokenizer.from_file(self.path).model

    @cached_property
    def inner(self) -> BPE:
        """Its merging of a fragment that does not."""
        with open(self.path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        return BPE(vocab=self.vocab, merges=[tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges])

    @cached_property
    def ranks(self) -> tiktoken.Encoding | None:
        """An encoder of words, each closed by ``WORD_END``, with the same ids; none where they do not follow the order of merges."""
        made = self._made
        back = {c: b for b, c in enumerate(self.symbols)}
        plain = {t: i for t, i in self.vocab.items() if t not in self.added}
        named = {bytes(back[c] for c in t.removesuffix(self.end)) + WORD_END.encode() * t.endswith(self.end): i for t, i in plain.items()} if self.end else {}
        singles = [i for t, i in plain.items() if len(t.removesuffix(self.end)) == 1]
        if len(named) < len(plain) or len(singles) != 512 or max(singles) > min(made) or made != sorted(made):
            return None
        return tiktoken.Encoding("words", pat_str=rf"[^{WORD_END}]+{WORD_END}", mergeable_ranks=named, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Packed ids alone, as ``encode`` gives them."""
        found: list[bytes] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                found.append(self.added[part].to_bytes(4, "little"))
                continue
            words = self.pieces.findall(self.normalise(part))
            if self.ranks is None:
                found += [(self._words.get(w) or self.word(w))[0] for w in words]
            elif words:
                found.append(np.array(self.ranks.encode_ordinary(WORD_END.join(words) + WORD_END), dtype="<u4").tobytes())
        return b"".join(found)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces, special tokens kept; ids that name no token are skipped."""
        return " ".join(self.tokens[i] for i in ids.tolist() if i in self.tokens)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_ENCODED = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; ``with_ids`` adds the ids themselves.

    Null and empty texts have no tokens. Rows are independent: repeats, null ids and extra
    columns change nothing. ``path`` must be readable on every executor.
    """
    path = path or default_path()
    schema = T.StructType([docs.schema["doc_id"], *_ENCODED, *([T.StructField("token_ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    target = arrow_schema(schema)

    def made(ids: pa.Array, counts: list[int], digests: list[str], decoded_digests: list[str], packed: list[bytes]) -> pa.RecordBatch:
        columns = [ids, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded_digests, pa.string())]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))))
        return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            first, size = 0, 0
            counts, digests, decoded_digests, packed = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids, decoded = coder.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded_digests.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    packed.append(ids)
                    size += len(ids)
                if size > BATCH_BYTES:  # places in a list column are 32-bit numbers, and a batch is held whole
                    yield made(batch.column(0).slice(first, k + 1 - first), counts, digests, decoded_digests, packed)
                    first, size = k + 1, 0
                    counts, digests, decoded_digests, packed = [], [], [], []
            if first < batch.num_rows:
                yield made(batch.column(0).slice(first), counts, digests, decoded_digests, packed)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, token_ids)``; null ids give an empty text."""
    path = path or default_path()
    schema = T.StructType([tokens.schema["doc_id"], T.StructField("text", T.StringType())])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [coder.decode(np.array(ids or [], dtype=np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts)], schema=target)

    return tokens.select("doc_id", "token_ids").mapInArrow(run, schema)
