"""Fill-in-the-middle transformation with built-in functions only.

A text is cut into units (lines), two cuts drawn from a hash of its id part them into prefix,
middle and suffix, and the three are written in another order behind sentinels, so that a model
learns to fill a gap. ``restored`` parses the sentinels and rebuilds the exact text.

The arrangement is unambiguous: a text that holds a sentinel stays plain, and no sentinel can arise
where a part meets one, as each begins with a sign that occurs in it only once, at its start
(``transform`` asks for that).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, spread

#: Units of a text, matched left to right: lines with their ends.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are transformed, and of those so many carry the suffix first.
RATE, SUFFIX_FIRST, SEED = 100, 50, 7


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first digits of the SHA-256 of ``seed:doc_id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, units: str = LINES, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``docs`` with n, form, prefix, middle, suffix and output of every whole text.

    ``form`` is ``plain`` (output: the text; no parts) where the text is null or empty, holds one
    of the sentinels, or its third draw modulo 100 is at least ``rate``; else ``spm`` (suffix
    first) where the fourth modulo 100 is below ``suffix_first``, else ``psm``. ``units`` matches
    the units; together they must be the whole text. Rows are independent: repeats give repeats,
    a null id draws like an empty one. Columns of ``docs`` with the names of new ones are replaced
    by them, others stay.
    """
    if len(set(sentinels)) < 3 or any(len(s) < 2 or s.count(s[0]) > 1 or s[0] != sentinels[0][0] for s in sentinels):
        raise ValueError("sentinels must differ and begin with one sign that each holds nowhere else")
    if any(a != b and a in b for a in sentinels for b in sentinels):
        raise ValueError("no sentinel may lie within another")
    prefix, suffix, middle = map(F.lit, sentinels)
    made = ("n", "form", "prefix", "middle", "suffix", "output")
    names = [*docs.columns, *made]
    text, cut, h = (fresh(name, names) for name in ("whole", "cut", "drawn"))
    # each step is a column of its own, so that units, cuts and parts are made once a row
    staged = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    staged = staged.withColumn(cut, F.regexp_extract_all(text, F.lit(units), 0)).withColumn(h, F.array(*draws(F.col("doc_id"), seed)))
    n = F.size(cut)
    held = F.lit(False)
    for s in (prefix, suffix, middle):
        held = held | F.contains(F.col(text), s)
    form = F.when((F.col(text) == "") | held | (F.col(h)[2] % 100 >= rate), "plain").when(F.col(h)[3] % 100 < suffix_first, "spm").otherwise("psm")
    first, second = (F.col(h)[k] % (n + 1) for k in (0, 1))
    kept = [c for c in staged.columns if c.lower() not in made]
    staged = staged.select(*kept, n.cast("long").alias("n"), form.alias("form"), F.least(first, second).cast("int").alias("prefix"), F.greatest(first, second).cast("int").alias("suffix"))
    low, high = F.col("prefix"), F.col("suffix")

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice(cut, start + 1, length), ""))

    kept = [c for c in kept if c not in (cut, h)]
    staged = staged.select(*kept, "n", "form", part(F.lit(0), low).alias("prefix"), part(low, high - low).alias("middle"), part(high, F.col("n").cast("int") - high).alias("suffix"))
    before, after = F.concat(prefix, "prefix"), F.concat(suffix, "suffix")
    output = F.when(F.col("form") == "plain", F.col(text)).otherwise(F.concat(F.when(F.col("form") == "spm", F.concat(after, before)).otherwise(F.concat(before, after)), middle, "middle"))
    return staged.select(*(c for c in kept if c != text), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The exact text: the parts found behind their sentinels, in their old order; null of a null output."""
    prefix, suffix, middle = sentinels

    def between(a: str, b: str | None) -> Column:
        start = F.instr(output, F.lit(a)) + F.lit(len(a))
        end = F.instr(output, F.lit(b)) if b else F.char_length(output) + 1
        return F.substring(output, start, end - start)

    psm = F.concat(between(prefix, suffix), between(middle, None), between(suffix, middle))
    spm = F.concat(between(prefix, middle), between(middle, None), between(suffix, prefix))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, lengths of prefix and middle, and SHA-256 of the output and of the text rebuilt from it.

    A row for every row of ``docs``; other columns than doc_id and text are not read.
    """
    made = transform(spread(docs.select("doc_id", "text")))
    made = made.withColumn("restored", restored(F.col("output"), F.col("form")))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


_HASH = "sha256('7:' || coalesce(doc_id::varchar, ''))"
DIGESTS_SQL = f"""
with cut as (
  select doc_id, coalesce(text, '') as whole, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as units,
    {", ".join(f"('0x' || substr({_HASH}, {1 + 8 * k}, 8))::bigint as h{k + 1}" for k in range(4))}
  from documents),
placed as (
  select *, len(units)::bigint as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as high,
    case when whole = '' or contains(whole, '<P>') or contains(whole, '<S>') or contains(whole, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from cut),
parts as (
  select doc_id, n, form, whole, coalesce(array_to_string(units[1:low], ''), '') as p, coalesce(array_to_string(units[low + 1:high], ''), '') as m, coalesce(array_to_string(units[high + 1:], ''), '') as s
  from placed)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then whole when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(whole) as restored_sha256
from parts"""
