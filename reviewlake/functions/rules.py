"""Rule tables and score rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import lookup
from .text import normalize_text

# Texts and maps that results must carry.
PATTERN_TEXT = {
    "input_validation": "External input is consumed without strict bounds/format validation.",
    "memory_overflow": "Unchecked arithmetic or index usage may cause out-of-bounds access.",
    "resource_exhaustion": "Resource allocation path lacks defensive limits or cleanup.",
    "race_condition": "Shared state updates are not protected by synchronization or ordering checks.",
    "authorization_bypass": "Security-critical capability checks are incomplete or bypassable.",
    "dos": "Error handling allows repeated attacker-controlled state transitions or loops.",
    "general": "Security-sensitive logic lacks explicit defensive checks.",
}
SOLUTION_TEXT = {
    "input_validation": "Enforce strict input validation (length, format, ranges), reject malformed packets early, and add regression tests for malformed inputs.",
    "memory_overflow": "Add bounds checks before array/pointer operations, guard integer arithmetic, and include sanitizer-backed tests (ASAN/UBSAN).",
    "resource_exhaustion": "Add resource limits and failure guards, ensure cleanup on every error path, and add stress tests for large/invalid inputs.",
    "race_condition": "Protect shared state with synchronization primitives, verify ordering assumptions, and add concurrent execution tests.",
    "authorization_bypass": "Centralize privilege checks, require strongest capability for sensitive paths, and add negative authorization tests.",
    "dos": "Add loop exit guards and request throttling, fail fast on invalid state, and create replay/fuzz tests for abusive sequences.",
    "general": "Introduce explicit guard clauses for security-sensitive code paths and add regression tests covering exploit preconditions.",
}
CWE_TYPE = {
    "CWE-119": "buffer_error", "CWE-125": "out_of_bounds_read", "CWE-787": "out_of_bounds_write", "CWE-20": "input_validation", "CWE-79": "xss",
    "CWE-89": "sql_injection", "CWE-94": "code_injection", "CWE-400": "resource_exhaustion", "CWE-476": "null_pointer", "CWE-502": "deserialization",
}
CWE_SEVERITY = {"CWE-119": "high", "CWE-125": "high", "CWE-787": "high", "CWE-89": "critical", "CWE-94": "critical"}
CPPCHECK_SEVERITY = {"error": "high", "warning": "medium", "style": "low", "performance": "low", "portability": "low", "information": "low"}
SEMGREP_SEVERITY = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
SPOTBUGS_PRIORITY = {"1": "high", "2": "medium", "3": "low"}
PYLINT_SEVERITY = {"error": "high", "warning": "medium", "refactor": "low", "convention": "low", "info": "low"}
SCAN_ADVICE = (
    "立即修复严重问题,代码可能存在安全风险或逻辑错误",
    "优先修复高级别问题,这些问题影响代码质量和可维护性",
    "问题数量过多,建议分模块逐步改进",
    "考虑配置代码格式化工具自动修复样式问题",
)


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding of the double itself, not of its shortest decimal form."""
    return F.rint(value * float(10**digits)) / float(10**digits)


def bands(value: Column, *steps: tuple[float, str], other: str) -> Column:
    """First label whose bound the value reaches; bounds fall."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for bound, label in steps[1:]:
        out = out.when(value >= bound, label)
    return out.otherwise(other)


def score_severity(score: Column) -> Column:
    """CVSS score to severity: unreadable is medium, not-a-number is low."""
    number = score.cast("string").try_cast("double")
    return F.when(number.isNull(), "medium").when(F.isnan(number), "low").otherwise(bands(number, (9.0, "critical"), (7.0, "high"), (4.0, "medium"), other="low"))


def error_type(cwe_id: Column, classification: Column, summary: Column) -> Column:
    """Seven ordered rules on CWE, classification and summary."""
    cwe, kind, text = normalize_text(cwe_id), F.lower(normalize_text(classification)), F.lower(normalize_text(summary))
    has = lambda c, piece: F.contains(c, F.lit(piece))
    return (
        F.when(has(kind, "race") | has(text, "race condition") | (cwe == "CWE-362"), "race_condition")
        .when(has(kind, "overflow") | has(text, "out of bounds") | cwe.isin("CWE-119", "CWE-189"), "memory_overflow")
        .when(has(kind, "bypass") | has(text, "privilege") | (cwe == "CWE-264"), "authorization_bypass")
        .when(has(kind, "dos") | has(text, "denial of service"), "dos")
        .when((cwe == "CWE-20") | has(text, "validate") | has(text, "input"), "input_validation")
        .when((cwe == "CWE-399") | has(text, "memory leak"), "resource_exhaustion")
        .otherwise("general")
    )


def problematic_pattern(kind: Column, summary: Column) -> Column:
    return F.concat(lookup(kind, PATTERN_TEXT, PATTERN_TEXT["general"]), F.lit(" Evidence: "), normalize_text(summary))


def solution(kind: Column) -> Column:
    return lookup(kind, SOLUTION_TEXT, SOLUTION_TEXT["general"])


def scan_grade(score: Column) -> Column:
    return bands(score, (9.0, "A"), (8.0, "B"), (7.0, "C"), (6.0, "D"), other="F")


def performance_grade(score: Column) -> Column:
    return bands(score, (9.0, "Excellent"), (7.5, "Good"), (6.0, "Fair"), (4.0, "Poor"), other="Critical")


def security_rating(score: Column) -> Column:
    return bands(score, (8.5, "Excellent"), (7.0, "Good"), (5.0, "Fair"), (3.0, "Poor"), other="Critical")


def priority(value: Column) -> Column:
    """One of the five levels, else medium."""
    level = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(level.isin("critical", "high", "medium", "low", "info"), level).otherwise("medium")


# Penalties and bases of the score rules.
SCAN_PENALTY = {"critical": 3.0, "high": 2.0, "medium": 1.0, "low": 0.5}
SECURITY_PENALTY = {"critical": 3.0, "high": 2.0, "medium": 1.0, "low": 0.4, "info": 0.1}
PERFORMANCE_PENALTY = {"critical": 2.0, "high": 1.5, "medium": 1.0, "low": 0.5, "info": 0.2}
RISK_BASE = {"critical": 9.0, "high": 7.5, "medium": 5.5, "low": 3.0, "info": 1.0}
#: Label parts, tested in this order, with the score at confidence zero and its slope.
LABEL_SCORES = (
    (("NEG", "LABEL_0", "BAD", "HIGH_RISK", "UNSAFE"), 5.5, -4.5),
    (("POS", "LABEL_1", "GOOD", "LOW_RISK", "SAFE"), 5.5, 4.0),
    (("NEU", "LABEL_2", "MID", "MEDIUM"), 5.5, 0.0),
)
EFFORT_STEPS = ((1, "无"), (10, "低 (~0.5-1天)"), (30, "中 (~2-3天)"), (60, "高 (~1周)"))
EFFORT_MOST = "非常高 (>1周)"
SEVERITY_LABEL = {"critical": "🚨 严重", "high": "🔴 高", "medium": "🟡 中", "low": "🟢 低"}
SOURCE_LABEL = {
    "style": "代码风格", "quality": "代码质量", "security": "安全问题", "security_vulnerability": "安全漏洞", "security_risk": "安全风险",
    "performance": "性能问题", "performance_bottleneck": "性能瓶颈", "complexity": "复杂度问题",
}
TYPE_LABEL = {"security_analysis": "安全分析", "performance_analysis": "性能分析", "static_analysis": "静态分析", "ai_analysis": "AI分析"}
TYPE_SOURCES = {"security_analysis": ("security_vulnerability", "security_risk"), "performance_analysis": ("performance_bottleneck",), "static_analysis": ("style", "quality"), "ai_analysis": ()}


def number_of(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def clamp(value: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def risk_score(severity: Column, confidence: Column) -> Column:
    """Base of the severity (2 for unknown ones) raised by confidence, 10 at most, two digits."""
    base = number_of(F.coalesce(severity, F.lit("info")), RISK_BASE, 2.0)
    return rounded(F.least(F.lit(10.0), base + F.coalesce(confidence, F.lit(0.5)) * 1.5), 2)


def label_score(label: Column, confidence: Column) -> Column:
    """Score of a classifier's label: bad labels first, unknown ones near neutral."""
    label, c = F.upper(label), clamp(F.coalesce(confidence, F.lit(0.0)), 0.0, 1.0)
    out = None
    for parts, base, slope in LABEL_SCORES:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(label, F.lit(p))
        value = F.lit(base) + F.lit(slope) * c
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return rounded(clamp(out.otherwise(5.0 + (c - 0.5))), 3)


def fused_score(rule: Column, model: Column, confidence: Column) -> Column:
    """Weighted mean that trusts the model more when it is confident; the rule alone without one."""
    weight = F.when(confidence >= 0.8, 0.65).when(confidence >= 0.55, 0.55).otherwise(0.4)
    return F.when(model.isNull(), rule).otherwise(rounded(clamp(weight * model + (F.lit(1.0) - weight) * rule), 3))


def detection_severity(label: Column, code: Column, confidence: Column) -> Column:
    """Severity that a label or the code's start names, else by confidence."""
    said = F.lower(F.concat_ws(" ", F.upper(label), F.substring(code, 1, 160)))
    named = lambda word: F.contains(said, F.lit(word))
    return F.when(named("critical"), "critical").when(named("high"), "high").when(named("medium") | (confidence > 0.88), "medium").otherwise("low")


def fix_effort(count: Column) -> Column:
    out = F.when(count < EFFORT_STEPS[0][0], EFFORT_STEPS[0][1])
    for bound, label in EFFORT_STEPS[1:]:
        out = out.when(count < bound, label)
    return out.otherwise(EFFORT_MOST)


def remediation_effort(critical: Column, high: Column, total: Column) -> Column:
    return (
        F.when((critical >= 2) | (total >= 8), "1-2 weeks")
        .when((critical >= 1) | (high >= 2) | (total >= 5), "3-5 days")
        .when(total >= 1, "1-2 days")
        .otherwise("0.5-1 day")
    )


def cwe_type(cwe: Column) -> Column:
    return lookup(cwe, CWE_TYPE, "security_vulnerability")


def cwe_severity(cwe: Column) -> Column:
    return lookup(cwe, CWE_SEVERITY, "medium")
