"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat, decontaminate, fim, html, languagemodel, licenses, packing, secrets, simhash, sketches, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languagemodel.score(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequence_table(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 on conversations that are told through tool calls."""
    return chat.link(chat.with_tool_calls(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return {**found, "tool_calls": tool_calls, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontaminate.SCAN_SQL, "op6_chat": chat.LINK_SQL, "tool_calls": chat.CALLS_SQL, "op9_secrets": secrets.scan_sql(), "op13_fill_in_middle": fim.DIGESTS_SQL}
