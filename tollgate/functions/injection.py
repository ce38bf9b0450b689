"""Prompt-injection scoring (N1-N16), as column expressions.

Each rule is a case-insensitive ``rlike`` on a literal pattern (compiled once
per task). The matched rules, in list order, become an array of
``struct<type,reason>``; detection, confidence, first type and the joined
reasons are read off that one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dialect
from .pii import fence
from .rules import (
    INJECTION_CONFIDENCE_BASE,
    INJECTION_CONFIDENCE_CAP,
    INJECTION_CONFIDENCE_STEP,
    INJECTION_RULES,
    InjectionRule,
    first_char_guard,
)

RESULT_TYPE = "struct<detected:boolean,confidence:double,type:string,reason:string>"


def java_pattern(r: InjectionRule) -> str:
    return r.java or dialect.to_java(first_char_guard(r.first) + r.pattern, "i")


def re2_pattern(r: InjectionRule) -> str:
    return dialect.to_re2(r.pattern, "i")


def rule_hit(text: Column, r: InjectionRule) -> Column:
    """Boolean: the rule matches somewhere in ``text``. Rules with needles
    first check those literal substrings by byte search."""
    hit = text.rlike(java_pattern(r))
    if r.needles:
        pre = None
        for nd in r.needles:
            c = F.instr(text, nd) > 0
            pre = c if pre is None else (pre & c)
        hit = F.when(pre, hit).otherwise(F.lit(False))
    return F.coalesce(hit, F.lit(False))


def injection_hits(text: Column, rules: Sequence[InjectionRule] = INJECTION_RULES) -> Column:
    """Ordered ``array<struct<type,reason>>`` of the matching rules."""
    cands = [
        F.when(rule_hit(text, r), F.struct(F.lit(r.type).alias("type"), F.lit(r.reason).alias("reason")))
        for r in rules
    ]
    return F.filter(F.array(*cands), lambda x: x.isNotNull())


def confidence(hits: Column) -> Column:
    """min(cap, base + step * distinct types), 0 when nothing matched; double
    arithmetic in the same order as specified."""
    n_types = F.size(F.array_distinct(F.transform(hits, lambda h: h["type"])))
    score = F.least(
        F.lit(INJECTION_CONFIDENCE_CAP),
        F.lit(INJECTION_CONFIDENCE_BASE) + n_types * F.lit(INJECTION_CONFIDENCE_STEP),
    )
    return F.when(F.size(hits) > 0, score).otherwise(F.lit(0.0))


def _result_sql(h: str) -> str:
    n_types = f"size(array_distinct(transform({h}, _x -> _x.type)))"
    conf = (f"CASE WHEN size({h}) > 0 THEN least(CAST({INJECTION_CONFIDENCE_CAP!r} AS DOUBLE), "
            f"CAST({INJECTION_CONFIDENCE_BASE!r} AS DOUBLE) + {n_types} * CAST({INJECTION_CONFIDENCE_STEP!r} AS DOUBLE)) "
            f"ELSE CAST(0.0 AS DOUBLE) END")
    return (f"named_struct('detected', size({h}) > 0, 'confidence', {conf}, "
            f"'type', coalesce(get({h}, 0).type, 'none'), "
            f"'reason', array_join(transform({h}, _x -> _x.reason), '; '))")


def result_from_hits(hits: Column | str) -> Column:
    """``struct<detected, confidence, type, reason>`` (N11-N14). A column
    name takes the SQL-text path (one expression object)."""
    if isinstance(hits, str):
        from .pii import ident

        return F.expr(_result_sql(ident(hits)))
    return F.struct(
        (F.size(hits) > 0).alias("detected"),
        confidence(hits).alias("confidence"),
        F.coalesce(F.get(hits, 0)["type"], F.lit("none")).alias("type"),
        F.array_join(F.transform(hits, lambda h: h["reason"]), "; ").alias("reason"),
    )


def no_injection() -> Column:
    """The result of a switched-off detector."""
    return F.struct(
        F.lit(False).alias("detected"),
        F.lit(0.0).alias("confidence"),
        F.lit("none").alias("type"),
        F.lit("").alias("reason"),
    )


def with_injection(
    df: DataFrame,
    text: str = "text",
    out: str = "injection",
    rules: Sequence[InjectionRule] = INJECTION_RULES,
    enabled: Column | None = None,
) -> DataFrame:
    """Add ``out`` (the result struct) and ``out + '_hits'``. Staged so that
    every rule runs once per row; ``enabled`` switches detection off per row
    (library profile with a disabled rule)."""
    hits = injection_hits(F.col(text), rules)
    if enabled is not None:
        hits = F.when(enabled, hits).otherwise(F.array().cast("array<struct<type:string,reason:string>>"))
    hits_col = out + "_hits"
    df1 = df.withColumn(hits_col, fence(hits))
    return df1.withColumn(out, result_from_hits(hits_col))


def is_blocking(inj: Column, threshold: float = 0.5) -> Column:
    """Detected and confidence >= threshold."""
    return inj["detected"] & (inj["confidence"] >= F.lit(float(threshold)))


def confidence_percent(conf: Column) -> Column:
    """Math.round(confidence * 100) for non-negative values."""
    return F.floor(conf * F.lit(100.0) + F.lit(0.5)).cast("int")


def type_label(t: Column) -> Column:
    """Underscores to spaces."""
    return F.translate(t, "_", " ")


def distinct_type_count(hits: Column) -> Column:
    """A10: number of distinct attack types in a row."""
    return F.size(F.array_distinct(F.transform(hits, lambda h: h["type"])))
