"""Secret scans with built-in functions only.

Three fixed patterns give the base spans. Besides them, candidate strings are judged by the
Shannon entropy of a window sliding over them: counts are updated for the character that
enters and the one that leaves, against a threshold for the candidate's character class;
allow-listed shapes are suppressed. Everything is a per-row expression: no shuffle.
Time is linear in the text, and in the matches it holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, spread

#: Kinds in the order that breaks ties between spans with the same start.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

WINDOW = 20
#: Signs that a candidate may hold.
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits per character that some window must reach, by class: hexadecimal, letters and digits, letters alone.
HEX_BITS, MIXED_BITS, LETTER_BITS = 3.0, 3.7, 3.9
#: Shapes that are no secrets: UUIDs, marked examples.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]",
)
#: Nor are plain words joined by marks: each part is words in lower, upper or camel case of at most
#: sixteen letters, with a number of at most four digits behind them, or one letter, or such a number.
MARKS = "[+/_=-]+"
PLAIN = r"^([A-Z]?[a-z]{2,15}([A-Z][a-z]{2,15}){0,7}[0-9]{0,4}|[A-Z]{1,16}[0-9]{0,4}|[a-z]?[0-9]{0,4})$"
_SPAN = "array<struct<start:bigint,rank:int,stop:bigint>>"
#: Items that one pass over an array appends one by one; longer arrays are cut into blocks, so that time stays linear.
BLOCK = 128
#: Counts of a window, of five bits each, in one long; and the scale of whole-number weights.
_PER_LONG, _SCALE = 12, 1 << 32


def _blocks(items: Column) -> Column:
    """A filled array in slices of ``BLOCK``."""
    return F.transform(F.sequence(F.lit(1), F.size(items), F.lit(BLOCK)), lambda at: F.slice(items, at, BLOCK))


def _with_matches(df: DataFrame, text: Column, pattern: str, rank: int, keep, name: str) -> DataFrame:
    """``df`` with the spans of a pattern's leftmost non-overlapping matches for which ``keep(match)`` holds.

    The pieces between the matches give the positions, in code points: within blocks first,
    then moved by what the blocks before them hold. Each stage is a column, made once a row.
    """
    taken = df.columns
    found, pairs, blocks, local, moved = (fresh(f"{name}_{k}", taken) for k in range(5))
    some = F.size(found) > 0
    measured = F.zip_with(found, F.split(text, pattern, -1), lambda m, p: F.struct(F.char_length(p).cast("bigint").alias("gap"), F.char_length(m).cast("bigint").alias("size"), F.when(m.isNotNull(), keep(m)).alias("kept")))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["size"]).alias("stop")))
        return F.struct((start + x["size"]).alias("at"), F.when(x["kept"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    staged = df.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    staged = staged.withColumn(pairs, F.when(some, F.slice(measured, F.lit(1), F.size(found))))
    staged = staged.withColumn(blocks, F.when(some, _blocks(F.col(pairs))))
    staged = staged.withColumn(local, F.when(some, F.transform(blocks, lambda b: F.aggregate(b, zero, step))))
    before = F.aggregate(local, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
    staged = staged.withColumn(moved, F.when(some, F.zip_with(local, F.slice(before, F.lit(1), F.size(local)), lambda x, o: F.transform(x["spans"], lambda s: F.struct((o + s["start"]).alias("start"), s["rank"].alias("rank"), (o + s["stop"]).alias("stop"))))))
    return staged.withColumn(name, F.when(some, F.flatten(moved)).otherwise(F.array().cast(_SPAN))).drop(found, pairs, blocks, local, moved)


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Largest entropy in bits of a window of a string of ``SIGNS``, by incremental counts.

    The entropy is log2(window) less the sum of c * log2(c) over the window's counts c, divided by
    the window. A step takes one sign from the counts and adds one; counts are packed into a few
    longs and the weights are whole numbers, so that nothing drifts over a long string.
    """
    long = lambda n: F.lit(n).cast("bigint")
    weights = F.array(*[long(round(c * math.log2(c) * _SCALE) if c else 0) for c in range(window + 2)])
    #: where each sign is counted: a long of the packed counts, and the value of one in it
    places = F.array(*[F.struct(F.lit(k // _PER_LONG).alias("slot"), long(32 ** (k % _PER_LONG)).alias("one")) for k in range(len(SIGNS))])
    nowhere = F.struct(F.lit(-1).alias("slot"), long(1).alias("one"))
    signs = F.transform(F.split(candidate, ""), lambda c: F.get(places, F.instr(F.lit(SIGNS), c) - 1))
    moves = F.zip_with(signs, F.concat(F.array_repeat(nowhere, window), signs), lambda a, z: F.struct(a.alias("enters"), z.alias("leaves")))
    empty = F.array_repeat(long(0), -(-len(SIGNS) // _PER_LONG))
    zero = F.struct(empty.alias("counts"), long(0).alias("sum"), F.lit(0).alias("n"), long(1 << 62).alias("least"))
    count = lambda acc, sign: F.call_function("div", F.get(acc["counts"], sign["slot"]), sign["one"]).bitwiseAND(long(31)).cast("int")
    change = lambda sign, j: F.when(j == sign["slot"], sign["one"]).otherwise(long(0))

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        n_in, n_out = count(acc, enters), count(acc, leaves)
        added = acc["sum"] + F.get(weights, n_in + 1) - F.get(weights, n_in)
        total = F.when(leaves["slot"] < 0, added).when(leaves == enters, acc["sum"]).otherwise(added + F.get(weights, n_out - 1) - F.get(weights, n_out))
        counts = F.when(leaves == enters, acc["counts"]).otherwise(F.transform(acc["counts"], lambda c, j: c + change(enters, j) - change(leaves, j)))
        least = F.when(acc["n"] + 1 >= window, F.least(acc["least"], total)).otherwise(acc["least"])
        return F.struct(counts.alias("counts"), total.alias("sum"), (acc["n"] + 1).alias("n"), least.alias("least"))

    return F.aggregate(F.slice(moves, F.lit(1), F.char_length(candidate)), zero, step, lambda acc: F.when(acc["n"] >= window, F.lit(math.log2(window)) - acc["least"] / (window * _SCALE)).otherwise(F.lit(-1.0)))


def _secretive(candidate: Column) -> Column:
    digits = candidate.rlike("[0-9]")
    threshold = F.when(candidate.rlike("^[0-9A-Fa-f]+$") & digits, HEX_BITS).when(digits, MIXED_BITS).otherwise(LETTER_BITS)
    allowed = ~F.exists(F.split(candidate, MARKS), lambda part: ~part.rlike(PLAIN))
    for shape in ALLOW:
        allowed = allowed | candidate.rlike(shape)
    return F.when(candidate.rlike("[A-Za-z]") & ~allowed, window_entropy(candidate) >= threshold).otherwise(False)


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, Column, Column]:
    """``docs`` with two more columns, whose names clash with none of its own, and those columns.

    The first holds the sorted base spans (start, kind rank, stop) of each whole text, the second
    those and the entropy spans, which may overlap base spans. Null texts count as empty and have no
    spans; rows are independent of each other: repeats agree, null ids pass through.
    """
    taken = docs.columns
    text, base, spans = (fresh(name, taken) for name in ("whole", "base", "spans"))
    kinds = [fresh(f"kind{k}", taken) for k in range(4)]
    staged = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    whole, always = F.col(text), lambda m: F.lit(True)
    staged = _with_matches(staged, whole, ASSIGN, 0, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGN, kinds[0])
    # A run below the least length can hold no match that reaches it: the bound may stand in the pattern.
    staged = _with_matches(staged, whole, ACCESS.replace("+", f"{{{LEAST_ACCESS - 4},}}"), 1, always, kinds[1])
    staged = _with_matches(staged, whole, HEX.replace("+", f"{{{LEAST_HEX},}}"), 2, always, kinds[2])
    staged = _with_matches(staged, whole, CANDIDATE, 3, _secretive, kinds[3])
    staged = staged.withColumn(base, F.sort_array(F.concat(*kinds[:3]))).withColumn(spans, F.sort_array(F.concat(*kinds)))
    return staged.drop(text, *kinds), F.col(base), F.col(spans)


def scan(docs: DataFrame) -> DataFrame:
    """Digest per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A row for every row of ``docs``, repeats and null ids too; null and empty texts have no spans;
    other columns are not read.
    """
    found, base, spans = find(spread(docs.select("doc_id", "text")))
    count = lambda k: F.size(F.filter(base, lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_text_of(base), 256).alias("base_sha256"), _text_of(spans).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Every document with its secrets replaced by ``mark``; texts without secrets stay as they are.

    Overlapping spans give one mark. Columns as in ``docs``, whatever their names; ``n_chars``, if
    there, follows the text. Repeats and null ids pass through, null and empty texts stay.
    """
    found, _, spans = find(spread(docs))
    taken = found.columns
    blocks, tops, kept, parts, regions = (fresh(name, taken) for name in ("blocks", "tops", "kept", "parts", "regions"))
    some, text = F.size(spans) > 0, F.col("text")
    number = lambda n: F.lit(n).cast("bigint")
    piece = "array<struct<start:bigint,stop:bigint>>"
    # what stays: from the largest stop so far to the next start beyond it; block by block, then in one array
    staged = found.withColumn(blocks, F.when(some, _blocks(spans)))
    reach = F.aggregate(blocks, F.array(number(0)), lambda acc, b: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.array_max(F.transform(b, lambda s: s["stop"]))))))
    staged = staged.withColumn(tops, F.when(some, reach))

    def step(acc: Column, s: Column) -> Column:
        one = F.array(F.struct(acc["at"].alias("start"), s["start"].alias("stop")))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    def stays(b: Column, top: Column) -> Column:
        return F.aggregate(b, F.struct(top.alias("at"), F.array().cast(piece).alias("out")), step)["out"]

    inner = F.flatten(F.zip_with(blocks, F.slice(tops, F.lit(1), F.size(blocks)), stays))
    last = F.array(F.struct(F.element_at(tops, -1).alias("start"), F.char_length(text).cast("bigint").alias("stop")))
    staged = staged.withColumn(kept, F.when(some, F.concat(inner, last))).withColumn(parts, F.when(some, _blocks(F.col(kept))))
    # positions are counted from the start of a text: cut a block's stretch first, then its pieces from that
    cut = lambda t, start, stop: F.substring(t, (start + 1).cast("int"), (stop - start).cast("int"))
    opens = lambda b: F.get(b, F.lit(0))["start"]
    staged = staged.withColumn(regions, F.when(some, F.transform(parts, lambda b: F.struct(cut(text, opens(b), F.element_at(b, -1)["stop"]).alias("text"), opens(b).alias("at"), b.alias("pieces")))))
    pieces = F.flatten(F.transform(regions, lambda r: F.transform(r["pieces"], lambda p: cut(r["text"], p["start"] - r["at"], p["stop"] - r["at"]))))
    out = staged.withColumn("text", F.when(some, F.array_join(pieces, mark)).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


_SQL_SPANS = """
  SELECT doc_id, list_transform(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': CAST(list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS BIGINT), 'm': m[i]}}), lambda x: {keep}), lambda x: {{'s': x.s, 'k': {rank}, 'e': x.s + length(x.m)}}) AS spans
  FROM (SELECT doc_id, regexp_extract_all(t, {pattern}, 0) AS m, regexp_split_to_array(t, {pattern}) AS p FROM texts WHERE regexp_matches(t, {pattern}))
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def scan_sql() -> str:
    """The contract's patterns and the method's rules as literals of their own, so that a wrong constant above shows."""
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    entropy = "list_max(list_transform(range(1, length(x.m) - 18), lambda i: list_aggregate(string_split(substr(x.m, i, 20), ''), 'entropy')))"
    plain = "^([A-Z]?[a-z]{2,15}([A-Z][a-z]{2,15}){0,7}[0-9]{0,4}|[A-Z]{1,16}[0-9]{0,4}|[a-z]?[0-9]{0,4})$"
    uuid = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
    allowed = f"regexp_matches(x.m, '{uuid}') OR regexp_matches(x.m, '(?i)example') OR len(list_filter(regexp_split_to_array(x.m, '[+/_=-]+'), lambda y: NOT regexp_matches(y, '{plain}'))) = 0"
    keeps = [
        (assign, f"length(regexp_extract(x.m, {_quoted(assign)}, 2)) >= 6"),
        ("AKIA[A-Z0-9]+", "length(x.m) >= 20"),
        ("[0-9a-f]+", "length(x.m) >= 24"),
        ("[A-Za-z0-9+/_=-]{20,}", f"CASE WHEN regexp_matches(x.m, '[A-Za-z]') AND NOT ({allowed}) THEN {entropy} >= CASE WHEN NOT regexp_matches(x.m, '[0-9]') THEN 3.9 WHEN regexp_matches(x.m, '^[0-9A-Fa-f]+$') THEN 3.0 ELSE 3.7 END ELSE false END"),
    ]
    ctes = [f"k{k} AS ({_SQL_SPANS.format(pattern=_quoted(p), keep=keep, rank=k)})" for k, (p, keep) in enumerate(keeps)]
    join = " ".join(f"LEFT JOIN k{k} ON texts.doc_id = k{k}.doc_id" for k in range(4))
    said = "array_to_string(list_transform({0}, lambda x: ['assign', 'access', 'hex', 'entropy'][x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(ctes)},
base AS (SELECT texts.doc_id, list_sort(list_concat(coalesce(k0.spans, []), coalesce(k1.spans, []), coalesce(k2.spans, []))) AS b, coalesce(k3.spans, []) AS more FROM texts {join}),
spans AS (SELECT doc_id, b, list_sort(list_concat(b, more)) AS a FROM base)
SELECT doc_id, CAST(len(list_filter(b, lambda x: x.k = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(b, lambda x: x.k = 1)) AS BIGINT) AS n_access,
  CAST(len(list_filter(b, lambda x: x.k = 2)) AS BIGINT) AS n_hex, sha256(coalesce({said.format("b")}, '')) AS base_sha256, coalesce({said.format("a")}, '') AS spans
FROM spans
"""
