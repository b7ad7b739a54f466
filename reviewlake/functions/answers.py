"""Structured facts from model answers and rule-based stand-ins for them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .repair import json_object

# Words and texts of the rules.
THREAT_WORDS = ("inject", "xss", "csrf", "overflow", "leak", "auth bypass", "deserialization")
COMPLEXITIES = ("O(1)", "O(LOG N)", "O(N)", "O(N LOG N)", "O(N^2)", "O(N^3)", "O(2^N)")
CONCERNS = ("nested loop", "recursion", "database", "query", "io", "network", "cache", "sort", "scan")
SIGNALS = {
    "ai_async_signal": ("async", "await", "concurrent", "parallel", "线程", "并发"),
    "ai_database_signal": ("sql", "database", "query", "orm", "索引", "连接池"),
    "ai_caching_opportunity": ("cache", "memo", "缓存"),
    "ai_io_hotspot_signal": ("i/o", "io", "disk", "network", "socket", "磁盘", "网络"),
    "ai_refactor_needed": ("refactor", "split", "modular", "重构", "拆分", "模块化"),
}
STRIDE = ("Spoofing", "Tampering", "Repudiation", "Information Disclosure", "Denial of Service", "Elevation of Privilege")
TESTS = (
    ("database_operations", "数据库性能测试", "high"),
    ("network_operations", "网络性能测试", "medium"),
    ("async_patterns", "异步性能测试", "high"),
)
ITEM_TYPES = ("algorithmic_improvement", "architectural_change", "structural_adjustment", "monitoring", "general", "performance")


def _words_in(text: Column, words: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.size(_words_in(text, words)) > 0


def _filled(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def vulnerability(answer: Column, index: Column) -> Column:
    """``struct(type, severity, description, location, confidence, source)`` of a threat answer.

    A JSON object gives its fields; else the threat words found count; null without any.
    """
    v = json_object(answer)
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    place = F.concat(F.lit("代码块 "), (index + 1).cast("string"))
    found = _words_in(F.lower(F.coalesce(answer, F.lit(""))), THREAT_WORDS)
    one = F.struct(
        F.coalesce(_filled(get("type"), get("vulnerability_type")), F.lit("generated_threat_indicator")).alias("type"),
        rules.priority(F.coalesce(get("severity"), F.lit("low"))).alias("severity"),
        F.coalesce(_filled(get("description"), get("issue")), F.lit("生成威胁文本指出潜在风险")).alias("description"),
        F.coalesce(get("location"), place).alias("location"),
        F.lit(0.72).alias("confidence"),
        F.lit("generation_json").alias("source"),
    )
    two = F.struct(
        F.lit("generated_threat_indicator").alias("type"),
        F.when(F.size(found) > 1, "medium").otherwise("low").alias("severity"),
        F.concat(F.lit("生成威胁文本中提及关键词: "), F.array_join(found, ", ")).alias("description"),
        place.alias("location"),
        F.least(F.lit(0.95), F.lit(0.6) + F.lit(0.1) * F.size(found)).alias("confidence"),
        F.lit("generation_keyword").alias("source"),
    )
    return F.when(v.isNotNull(), one).when(F.size(found) > 0, two)


def complexity(answer: Column) -> Column:
    """``struct(estimated_complexity, confidence, summary, concerns)``: the first class of the list that the text names."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    named = F.get(_words_in(F.upper(text), COMPLEXITIES), F.lit(0))
    shown = F.replace(F.replace(named, F.lit("LOG N"), F.lit("log n")), F.lit("N"), F.lit("n"))
    return F.when(text != "", F.struct(F.coalesce(shown, F.lit("O(n)")).alias("estimated_complexity"), F.lit(0.68).alias("confidence"), F.substring(text, 1, 220).alias("summary"), _words_in(F.lower(text), CONCERNS).alias("concerns")))


def signals(answer: Column) -> Column:
    """Struct of five booleans."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.struct(*[_any(low, words).alias(name) for name, words in SIGNALS.items()])


def quality_lines(answer: Column) -> Column:
    """``struct(issues, recommendations, score)``: each line counts once, as an issue, a recommendation or a score; the last score stands."""
    lines = F.split(F.coalesce(answer, F.lit("")), "\n")
    kind = lambda x: F.when(F.contains(x, F.lit("问题")) | F.contains(F.lower(x), F.lit("issue")), 1).when(F.contains(x, F.lit("建议")) | F.contains(F.lower(x), F.lit("recommend")), 2).when(F.contains(x, F.lit("分数")) | F.contains(F.lower(x), F.lit("score")), 3).otherwise(0)
    of = lambda n: F.transform(F.filter(lines, lambda x: kind(x) == n), F.trim)
    numbers = F.filter(F.transform(of(3), lambda x: F.regexp_extract(x, r"(\d+(?:\.\d+)?)", 1)), lambda n: n != "")
    last = F.when(F.size(numbers) > 0, F.element_at(numbers, -1).try_cast("double"))
    return F.struct(of(1).alias("issues"), of(2).alias("recommendations"), F.coalesce(last, F.lit(7.0)).alias("score"))


def suggestion_lines(answer: Column, most: int = 5) -> Column:
    """``array(struct(suggestion_id, description))`` of the first lines that are neither blank nor headings, by original line number."""
    numbered = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x, k: F.struct((k + 1).alias("suggestion_id"), F.trim(x).alias("description"), F.startswith(x, F.lit("#")).alias("heading")))
    kept = F.filter(numbered, lambda s: (s["description"] != "") & ~s["heading"])
    return F.transform(F.slice(kept, 1, most), lambda s: F.struct(s["suggestion_id"].alias("suggestion_id"), s["description"].alias("description")))


def threat_model(answer: Column) -> Column:
    """``struct(categories, overall)``: what an answer says of each threat category (line from its name on, 160 characters) and the mean risk."""
    text = F.coalesce(answer, F.lit(""))
    low = F.lower(text)

    def detail(name: str) -> Column:
        at = F.instr(low, name.lower())
        line = F.split_part(F.substring(text, at, F.lit(180)), F.lit("\n"), F.lit(1))
        return F.when(at > 0, F.substring(line, 1, 160)).otherwise("未提及")

    risk = lambda d: F.when((F.length(d) > 20) & (d != "未提及"), 5.5).otherwise(4.5)
    details = [detail(name) for name in STRIDE]
    rows = F.array(*[F.struct(F.lit(n).alias("category"), d.alias("summary"), risk(d).alias("risk_score")) for n, d in zip(STRIDE, details, strict=True)])
    return F.struct(rows.alias("categories"), rules.rounded(sum((risk(d) for d in details), F.lit(0.0)) / len(STRIDE), 2).alias("overall"))


def plan_item(item: Column, default_type: str = "general") -> Column:
    """Plan item of a map: fields filled from their alternatives, type lower-case, priority one of five."""
    get = lambda k: F.trim(F.coalesce(F.try_element_at(item, F.lit(k)), F.lit("")))
    description = F.coalesce(_filled(get("description"), get("suggestion")), F.lit(""))
    return F.struct(
        F.coalesce(_filled(F.lower(get("type"))), F.lit(default_type)).alias("type"),
        rules.priority(F.coalesce(_filled(get("priority")), F.lit("medium"))).alias("priority"),
        description.alias("description"),
        F.coalesce(F.try_element_at(item, F.lit("expected_effect")), F.try_element_at(item, F.lit("benefit")), F.lit("")).alias("expected_effect"),
        get("location").alias("location"),
        get("reason").alias("reason"),
        F.coalesce(_filled(get("recommendation"), get("solution")), description).alias("recommendation"),
    )


def optimization_item(item: Column, index: Column) -> Column:
    """Suggestion of a map: known type or general, number from the item or its place, recommendation never empty."""
    get = lambda k: F.trim(F.coalesce(F.try_element_at(item, F.lit(k)), F.lit("")))
    description = F.coalesce(_filled(get("description"), get("recommendation"), get("solution"), get("suggestion")), F.lit(""))
    kind = F.lower(get("type"))
    return F.struct(
        F.coalesce(get("suggestion_id").try_cast("int"), index + 1).alias("suggestion_id"),
        F.when(kind.isin(*ITEM_TYPES), kind).otherwise("general").alias("type"),
        rules.priority(F.coalesce(_filled(get("priority")), F.lit("medium"))).alias("priority"),
        description.alias("description"),
        F.coalesce(_filled(get("recommendation"), get("solution"), description), F.lit("请根据瓶颈类型补充可执行的重构步骤。")).alias("recommendation"),
    )


def first_items(items: Column, make, most: int) -> Column:
    """At most ``most`` normalised items; a null list has none."""
    return F.transform(F.slice(F.coalesce(items, F.array().cast("array<map<string,string>>")), 1, most), lambda x: make(x))


def remediation_item(item: Column) -> Column:
    get = lambda k, d="": F.trim(F.coalesce(F.try_element_at(item, F.lit(k)), F.lit(d)))
    return F.struct(rules.priority(F.coalesce(_filled(get("priority")), F.lit("medium"))).alias("priority"), get("vulnerability_id").alias("vulnerability_id"), get("type", "unknown").alias("type"), get("fix").alias("fix"))


def analysis_envelope(status: Column, failed_steps: Column, whole: float, partial: float) -> Column:
    """``struct(analysis_status, confidence)``: completed with full confidence without failed steps; unknown states are partial."""
    failed = F.coalesce(F.size(failed_steps), F.lit(0)) > 0
    said = F.when(status.isin("completed", "partial_success", "failed"), status)
    return F.struct(F.coalesce(said, F.when(failed, "partial_success").otherwise("completed")).alias("analysis_status"), F.when(failed, partial).otherwise(whole).alias("confidence"))


def test_advice(flags: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(flags[name], F.struct(F.lit(kind).alias("test_type"), F.lit(level).alias("priority"))) for name, kind, level in TESTS]))


def complexity_advice(average: Column) -> Column:
    """Two stand-in suggestions: by the average complexity score, and to split functions."""
    high = F.coalesce(average >= 7.5, F.lit(False))
    one = F.struct(F.lit(1).alias("suggestion_id"), F.when(high, "algorithmic_improvement").otherwise("monitoring").alias("type"), F.when(high, "high").otherwise("medium").alias("priority"))
    return F.array(one, F.struct(F.lit(2).alias("suggestion_id"), F.lit("structural_adjustment").alias("type"), F.lit("medium").alias("priority")))


def prompt(templates: dict[str, str], variant: Column, model: Column, values: dict[str, Column]) -> Column:
    """Template of the variant, else of the model, else the default, with its placeholders filled; double braces become single."""
    table = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])
    out = F.coalesce(F.try_element_at(table, variant), F.try_element_at(table, model), F.try_element_at(table, F.lit("default")))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.replace(F.replace(out, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def merged_config(default: dict, user: dict) -> dict:
    """Nested settings where the user's win."""
    keys = [*default, *(k for k in user if k not in default)]
    both = lambda k: isinstance(default.get(k), dict) and isinstance(user.get(k), dict)
    return {k: merged_config(default[k], user[k]) if both(k) else user[k] if k in user else default[k] for k in keys}


def merged_settings(default: Column, user: Column) -> Column:
    """Nested settings of each row, both JSON objects, merged as ``merged_config`` does: canonical JSON, keys sorted.

    A text that is no object counts as empty; a null of the user's wins like any other value.
    """

    def merge(defaults: pd.Series, users: pd.Series) -> pd.Series:
        read = lambda t: v if isinstance(v := _object(t), dict) else {}
        return pd.Series([json.dumps(merged_config(read(d), read(u)), sort_keys=True, ensure_ascii=False, separators=(",", ":")) for d, u in zip(defaults, users, strict=True)], dtype=object)

    return F.pandas_udf(merge, "string")(default, user)


def _object(text: str | None) -> object:
    try:
        return json.loads(text or "{}")
    except ValueError:
        return {}
