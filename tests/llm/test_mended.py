"""Cases that earlier versions got wrong: missing labels, long samples, clashing names, worn copies side by side, letters-only secrets."""

from __future__ import annotations

import random
import time

import corpus_pipeline
from pyspark.sql import functions as F

from reviewlake.llm import bpe, html, languagemodel, licenses, secrets, simhash, toxicity

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def labelled(spark, n=400):
    r = random.Random(3)
    syllables = ["the", "an", "er", "on", "st", "re", "ing", "ed", "ou", "ly"]
    words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(300)]
    docs = [(k, " ".join(r.choices(words, k=20) + (["moron"] if k % 4 == 0 else [])), "en", "s", 1) for k in range(n)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(n)], LABELS)


def test_without_labels_every_document_stays(spark):
    docs, labels = labelled(spark, 60)
    for known in (labels.limit(0), labels.filter("toxic = 1"), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int")), labels.withColumn("toxic", F.lit(7))):
        assert toxicity.keep_clean(docs, known).count() == 60
        scores = toxicity.score(docs, known).collect()
        assert len(scores) == 60 and len({r.score for r in scores}) == 1
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0


def test_pipeline_without_labels_keeps_documents(spark, tmp_path):
    docs, labels = labelled(spark, 40)
    for name, df in (("documents", docs), ("labels", labels.limit(0)), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 40


def test_one_huge_text_does_not_end_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 100_000)
    docs, labels = labelled(spark)
    first = toxicity.sample(docs, labels).orderBy(F.xxhash64("doc_id")).first().doc_id
    huge = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("long "), 40_000)).otherwise(F.col("text")))
    rows = toxicity.sample(huge, labels).collect()
    assert first not in {r.doc_id for r in rows} and len(rows) > 200 and {r.toxic for r in rows} == {0, 1}
    kept = {r.doc_id for r in toxicity.keep_clean(huge, labels).select("doc_id").collect()}
    assert not any(k % 4 == 0 and k != first for k in kept) and sum(k % 4 != 0 for k in kept) == 300


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """The distributed fit is that of all rows in memory, whatever a sample would hold."""
    for name in ("SAMPLE_TOXIC", "SAMPLE_CLEAN"):
        monkeypatch.setattr(toxicity, name, 10)
    docs, labels = labelled(spark)
    got = toxicity.fitted(docs, labels)
    rows = [(r.doc_id, r.text, r.toxic) for r in docs.join(labels, "doc_id").filter(~toxicity.held_out(F.col("doc_id"), toxicity.FOLDS, toxicity.HELD)).collect()]
    want = toxicity.train(rows)
    assert got.learned and "=moron" in got.weights and got.model.seen == want.model.seen
    assert got.weights.keys() == want.weights.keys() and all(abs(got.weights[k] - w) < 1e-9 for k, w in want.weights.items())
    assert abs(got.coef - want.coef).max() < 1e-6


def test_the_prior_is_chosen_on_every_training_text(spark, monkeypatch):
    docs, _ = labelled(spark)
    judged, best = [], languagemodel.best_prior
    monkeypatch.setattr(languagemodel, "best_prior", lambda rows: judged.extend(rows.collect()) or best(rows))
    scores = {r.doc_id: r.score for r in languagemodel.score(docs).collect()}
    sums = [sum(r.left[k] for r in judged) for k in range(len(languagemodel.PRIORS))]
    k = sums.index(max(sums))
    assert len(judged) == 400 and all((r.left[0] < 0) != r.held_out for r in judged)
    assert all(scores[r.doc_id] == r.scores[k] for r in judged)


def test_keep_one_with_clashing_columns(spark):
    rows = [(1, "some words that are here", 7, 8, 9, "a"), (2, "some words that are here", 1, 2, 3, "b"), (3, "quite another text altogether now", 4, 5, 6, "c"), (3, "a third text under that number", 4, 5, 6, "d"), (None, "no id", 0, 0, 0, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __rl_gone int, gone int, Twice int, row string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.row) for r in kept.collect()) == [(0, "e"), (1, "a"), (3, "d")]


def worn(words, every, r):
    """A copy with two filler words after each ``every``-th word."""
    out = []
    for k, w in enumerate(words):
        out += [w, *(["the", "the"] if k % every == 0 else [])]
    return out


def test_copies_of_different_wear_side_by_side():
    r = random.Random(8)
    s = licenses.Scanner()
    for name in ("MIT", "ISC", "Apache-2.0"):
        words = licenses.words_of(licenses.TEMPLATES[name])
        forms = {"clean": words, "each": worn(words, 1, r), "third": worn(words, 3, r), "cut": words[: int(len(words) * 0.9)]}
        for _ in range(12):
            chosen = r.choices(list(forms), k=r.randint(1, 4))
            text, spans = [], []
            for form in chosen:
                text += [r.choice(["river", "stone", "of", "the", "and"]) for _ in range(r.randint(5, 40))]
                spans.append((len(text), len(text) + len(forms[form])))
                text += forms[form]
            found = sorted((f[3], f[4], f[2]) for f in s.finds(" ".join(text)) if f[0] == name)
            assert len(found) == len(chosen), (name, chosen, found, spans)
            for (first, stop, n), (a, b) in zip(found, spans, strict=True):
                assert max(first, a) < min(stop, b) and n >= 0.8 * len(words), (name, chosen)


def test_a_worn_copy_behind_a_clean_one():
    words = licenses.words_of(licenses.TEMPLATES["MIT"])
    text = " ".join([*words, *["river"] * 20, *worn(words, 1, None)])
    assert len([f for f in licenses.Scanner().finds(text) if f[0] == "MIT"]) == 2


def test_secrets_by_words_not_by_digits(spark):
    found = {"kJsHfWqPzXcVbNmLkJhGfDsAyRtU7", "kJsHfWqPzXcVbNmLkJhGfDsAyRtU", "kJsHfWqPzX7cVbNmLkJhGfDsAyRtU"}
    plain = {"my-long-identifier-name-2024", "SomeLongFunctionName1234", "usr/local/share/applications", "Donaudampfschifffahrtsgesellschaft", "READ_ME_FIRST_PLEASE_NOW_42", "x" * 400, "a/" * 50_000, "123456789012345678901234567890", "kJsHfWqPzXcVbNmLExamplekJhGfDsAyRtU7"}
    rows = list(enumerate(sorted(found | plain)))
    got = {rows[r.doc_id][1] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if "entropy" in r.spans}
    assert got == found


def test_marks_hold_at_any_depth():
    """Menus and articles nested deeper than a page ever is are still told apart."""
    prose = "These are words of an article that somebody wrote for other people to read, with commas, and with an end. " * 3
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(8)) + "</ul>"
    for depth in (10, 600, 20_000):
        inner = f"<nav>{menu}</nav><article><p>{prose}</p></article><footer><p>All about us and our friends</p></footer>"
        page = "<html><body>" + "<div>" * depth + inner + "</div>" * depth + "</body></html>"
        assert html.main_text(page) == prose.strip(), depth


def test_deep_markup_takes_linear_time():
    began = time.perf_counter()
    for piece in ("<div><i>", "<i><b></i>", "<table><tr><td>", "<p><ul><li>", "<div></i>"):
        html.main_text(piece * 100_000 + "text" + "</div>" * 50_000)
    assert time.perf_counter() - began < 60


def test_ids_of_long_batches_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_BYTES", 40)
    rows = [(k, "some words that follow each other " * (k % 4) or None) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = {r.doc_id: r for r in bpe.encode(df).collect()}
    got = bpe.encode(df, with_ids=True).collect()
    assert sorted(r.doc_id for r in got) == list(range(30)) and all(len(r.token_ids) == r.n_tokens and r.ids_sha256 == whole[r.doc_id].ids_sha256 for r in got)
    assert {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame([(r.doc_id, r.token_ids) for r in got], "doc_id long, token_ids array<int>")).collect()}[3].startswith("some</w> words</w>")
