"""The golden suite (A8, A9, J4): expected against actual per case, and a
one-row summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dashboard import to_fixed_1
from .policy import DEFAULT_POLICY, Policy
from .verdict import screen_input


def suite_results(cases: DataFrame, policy: Policy = DEFAULT_POLICY, text: str = "prompt",
                  latency_ms: str | None = None) -> DataFrame:
    """Per case ``actual, passed, pii_count, injection_detected,
    details`` from the ``suite`` profile. ``latency_ms`` names an input
    column when timings are supplied (the reference measures wall clock)."""
    s = screen_input(cases, text, policy, profile="suite")
    return s.select(
        *cases.columns,
        F.col("input_status").alias("actual"),
        (F.col("input_status") == F.col("expected")).alias("passed"),
        (F.col(latency_ms) if latency_ms else F.lit(None)).cast("int").alias("latency_ms"),
        F.size("pii").alias("pii_count"),
        F.col("injection.detected").alias("injection_detected"),
        F.col("reason").alias("details"),
        F.col("blocked_by").alias("log_blocked_by"),
    )


def expected_vs_actual(expected: DataFrame, actual: DataFrame, key: str = "id") -> DataFrame:
    """J4 as tables: expected and actual verdicts joined on the case id."""
    return expected.join(actual, key, "inner").withColumn("passed", F.col("expected") == F.col("actual"))


def suite_summary(results: DataFrame) -> DataFrame:
    """Total, passed, failed, pass rate (one decimal), total latency."""
    agg = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("passed").alias("passed"),
        F.sum("latency_ms").alias("total_latency_ms"),
    )
    rate = F.col("passed").cast("double") / F.col("total").cast("double") * F.lit(100.0)
    return agg.select(
        "total",
        "passed",
        (F.col("total") - F.col("passed")).alias("failed"),
        F.when(F.col("total") > 0, to_fixed_1(rate)).alias("pass_rate"),
        F.coalesce(F.col("total_latency_ms"), F.lit(0)).cast("bigint").alias("total_latency_ms"),
    )
