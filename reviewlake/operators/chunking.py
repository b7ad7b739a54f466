"""Splitting and packing of text under character and token budgets.

Packing is sequential, so these run in Python on Arrow batches, a few rows at a time, without a shuffle.
A token counter is any function from text to a number; ``quarter`` is the fallback.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import semantic_signature
from .greedy import greedy_chunks

Counter = Callable[[str], int]

# Starts and ends of lines that look like code.
CODE_STARTS = ("def ", "class ", "async def ", "return ", "import ", "from ", "if ", "for ", "while ", "try:", "except ", "public ", "private ", "protected ", "function ", "const ", "let ", "var ")
CODE_ENDS = (":", "{", "}", ";")
_SENTENCE = re.compile(r"(?<=[。！？!?\.])\s+")
_BOUNDARY = re.compile(r"\s*(?:(?:async\s+def|def|class)\s+|@)")


def quarter(text: str) -> int:
    return len(text) // 4


def words(text: str) -> int:
    return len(text.split())


def looks_like_code(text: Column) -> Column:
    """Two marked lines, or one among four or more."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.lit(True))
    left, right = lambda x: F.regexp_replace(x, r"^\s+", ""), lambda x: F.regexp_replace(x, r"\s+$", "")
    marked = F.size(F.filter(lines, lambda x: F.exists(F.array(*map(F.lit, CODE_STARTS)), lambda m: F.startswith(left(x), m)) | F.exists(F.array(*map(F.lit, CODE_ENDS)), lambda m: F.endswith(right(x), m))))
    total = F.size(lines) - F.endswith(text, F.lit("\n")).cast("int")
    return F.when(F.coalesce(text, F.lit("")) == "", False).otherwise((marked >= 2) | ((total >= 4) & (marked >= 1)))


def sentences(text: Column) -> Column:
    """Pieces after sentence ends that white space follows."""
    return F.filter(F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[。！？!?\.])\s+"), F.trim), lambda s: s != "")


def _is_code(text: str) -> bool:
    lines = text.splitlines()
    hits = sum(x.lstrip().startswith(CODE_STARTS) or x.rstrip().endswith(CODE_ENDS) for x in lines)
    return hits >= 2 or (hits >= 1 and len(lines) >= 4)


def _sentences(text: str) -> list[str]:
    return [s for piece in _SENTENCE.split(text.strip()) if (s := piece.strip())]


def _blocks(text: str) -> list[str]:
    """Code cut at blank lines and before definitions and decorators."""
    groups: list[list[str]] = [[]]
    for line in text.splitlines():
        if not line.strip():
            groups.append([])
        elif groups[-1] and _BOUNDARY.match(line):
            groups.append([line])
        else:
            groups[-1].append(line)
    return [b for g in groups if (b := "\n".join(g).strip())]


def units(text: str) -> list[str]:
    """Semantic units: code blocks, else sentences of a single line, else paragraphs (long ones as sentences)."""
    text = (text or "").replace("\r\n", "\n").strip()
    if not text:
        return []
    if _is_code(text):
        return _blocks(text) or [text]
    if "\n" not in text:
        return _sentences(text) or [text]
    out: list[str] = []
    for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        out += [paragraph] if len(paragraph) <= 200 else _sentences(paragraph) or [paragraph]
    return out or [text]


def truncate(text: str, budget: int, count: Counter = quarter) -> str:
    """Whole units that fit the budget, joined by blank lines; the first unit's start where none fits."""
    text = (text or "").replace("\r\n", "\n").strip()
    if not text or budget <= 0:
        return ""
    if count(text) <= budget:
        return text
    kept, used = [], 0
    for unit in units(text):
        n = count(unit)
        if n <= 0:
            continue
        if used + n > budget:
            if not kept:
                return unit[: budget * 4]
            break
        kept.append(unit)
        used += n
    return "\n\n".join(kept).strip() or text[: budget * 4]


def pack(segments: list[str], budget: int, count: Counter = quarter) -> list[str]:
    """Segments in order while the budget lasts, the last one trimmed."""
    out, used = [], 0
    for segment in segments:
        if budget - used <= 0:
            break
        piece = truncate(segment, budget - used, count) if segment else ""
        if piece and (n := count(piece)) > 0:
            out.append(piece)
            used += n
    return out


def by_lines(text: str, limit: int) -> list[str]:
    """Consecutive lines up to ``limit`` characters (line breaks not counted); longer lines stand alone."""
    chunks, size = [], 0
    for line in (text or "").split("\n"):
        if chunks and size + len(line) <= limit:
            chunks[-1].append(line)
            size += len(line)
        else:
            chunks.append([line])
            size = len(line)
    return ["\n".join(c) for c in chunks]


#: Rows of a batch whose values are Python objects at a time.
SLICE = 128


def _sliced(f: Callable, target: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``f`` of each row; what lies in Arrow's form is a batch, what are Python objects a slice of it."""
    out = [pa.array([f(*row) for row in zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)], target) for at in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(out) if out else pa.array([], target)


def _mapped(f: Callable, kind: str) -> Callable[..., Column]:
    target = pa.list_(pa.string()) if kind == "array<string>" else pa.string()

    def one(a: pa.Array) -> pa.Array:
        return _sliced(f, target, a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return _sliced(f, target, a, b)

    return lambda *columns: F.arrow_udf(one if len(columns) == 1 else two, kind)(*columns)


def unit_list(text: Column) -> Column:
    return _mapped(units, "array<string>")(text)


def code_blocks(text: Column) -> Column:
    return _mapped(lambda t: _blocks(t or ""), "array<string>")(text)


def truncated(text: Column, budget: Column, count: Counter = quarter) -> Column:
    return _mapped(lambda t, n: truncate(t, int(n), count), "string")(text, budget)


def packed(segments: Column, budget: Column, count: Counter = quarter) -> Column:
    return _mapped(lambda s, n: pack(list(s) if s is not None else [], int(n), count), "array<string>")(segments, budget)


def line_chunks(text: Column, limit: int = 800) -> Column:
    return _mapped(lambda t: by_lines(t, limit), "array<string>")(text)


def token_chunks(text: Column, budget: int = 256, most: int = 10, count: Counter = words) -> Column:
    """At most ``most`` groups of whole units within the token budget; an oversize unit stands alone."""

    def chunks(t: str) -> list[str]:
        groups, used = [], 0
        for unit in units(t):
            n = count(unit)
            if groups and used + n <= budget:
                groups[-1].append(unit)
                used += n
            else:
                groups.append([unit])
                used = n
        return ["\n\n".join(g) for g in groups][:most]

    return _mapped(chunks, "array<string>")(text)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def prompt_budget(model_max: Column, new_tokens: Column, margin: int = 32) -> Column:
    """``struct(input_budget, new_tokens)``: 16 new tokens at least, all within the model's size less the margin."""
    most = F.greatest(F.lit(0), model_max - margin)
    new = F.least(F.greatest(F.lit(16), F.coalesce(new_tokens, F.lit(0))), most)
    return F.struct(F.greatest(F.lit(0), model_max - new - margin).alias("input_budget"), new.alias("new_tokens"))


def semantic_chunks(issues: DataFrame, limit: int = 9000) -> DataFrame:
    """``(signature, chunk, ord)``: issues with their evidence packed by signature, in order.

    A unit's size is its JSON's length; one of the limit or more stands alone. Chunks of a
    signature count from 0. A hot signature is packed by many tasks (``greedy_chunks``).
    """
    most = max(800, limit)
    sized = issues.withColumn("signature", semantic_signature()).select("signature", F.col("ord"), F.length(F.to_json(F.struct(*[c for c in issues.columns]))).cast("long").alias("size"))
    return greedy_chunks(sized, "signature", "ord", "size", most).select("signature", "chunk", "ord")

