"""Dashboard statistics over the audit log.

One scan and one aggregate for the counters, one grouped count per
breakdown, one top-k for the recent feed. All aggregates are partial
(map-side) before their shuffle; the global ones shuffle one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECENT_COLUMNS = [
    "request_id", "direction", "input_text", "output_text", "status",
    "blocked_by", "reason", "latency_ms", "pii_found", "created_at",
]
RECENT_LIMIT = 50
BLOCK_RATE_ALARM = 20.0


def to_fixed_1(x: Column) -> Column:
    """JavaScript ``x.toFixed(1)`` for finite 0 <= x < 1e21: round the exact
    binary value, ties (only possible for exactly representable .x5 values,
    i.e. quarters) to the larger neighbour. ``format_number`` rounds the
    exact binary value half-even, so only the quarter ties need the
    override; both are exact double operations."""
    x4 = x * F.lit(4.0)
    x2 = x * F.lit(2.0)
    tie = (x4 == F.floor(x4)) & (x2 != F.floor(x2))
    up = F.floor(x * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)
    return F.when(tie, F.format_number(up, 1)).otherwise(F.format_number(x, 1))


def js_round(x: Column) -> Column:
    """``Math.round`` for non-negative values: half up."""
    return F.floor(x + F.lit(0.5))


def dash_stats(log: DataFrame) -> DataFrame:
    """A1-A3 in one pass: total, blocked, modified, allowed, block rate (one
    decimal, ``"0"`` when empty), average latency (half up, 0 when empty),
    maximum latency (0 when empty)."""
    agg = log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "blocked").alias("blocked"),
        F.count_if(F.col("status") == "modified").alias("modified"),
        F.count_if(F.col("status") == "allowed").alias("allowed"),
        F.avg("latency_ms").alias("_avg"),
        F.max("latency_ms").alias("_max"),
    )
    rate = F.col("blocked").cast("double") / F.col("total").cast("double") * F.lit(100.0)
    return agg.select(
        "total", "blocked", "modified", "allowed",
        F.when(F.col("total") > 0, to_fixed_1(rate)).otherwise(F.lit("0")).alias("block_rate"),
        js_round(F.coalesce(F.col("_avg"), F.lit(0.0))).cast("bigint").alias("avg_latency"),
        F.coalesce(F.col("_max"), F.lit(0)).cast("bigint").alias("max_latency"),
    )


def block_rate_alarm(stats: DataFrame) -> DataFrame:
    """The block rate is above 20 percent."""
    return stats.withColumn("alarm", F.col("block_rate").cast("double") > F.lit(BLOCK_RATE_ALARM))


def blocked_by_counts(log: DataFrame) -> DataFrame:
    """A4 (P7): blocked rows with a rule, counted per rule; ``unknown`` for
    a null rule (A5 fallback, unreachable after the filter but kept)."""
    return (
        log.filter((F.col("status") == "blocked") & F.col("blocked_by").isNotNull())
        .groupBy("blocked_by")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.coalesce(F.col("blocked_by"), F.lit("unknown")).alias("type"), "count")
    )


def title_label(t: Column) -> Column:
    """A5: underscores to spaces, then every ASCII word character that
    follows a non-word character (or starts the text) upper-cased, i.e.
    ``\\b\\w`` with an ASCII word class. Labels are a handful of
    characters, so a per-character transform is cheap."""
    spaced = F.translate(t, "_", " ")
    chars = F.split(spaced, "", -1)
    up = F.transform(
        chars,
        lambda c, i: F.when(
            ((i == 0) | ~F.coalesce(F.get(chars, i - 1).rlike("^[A-Za-z0-9_]$"), F.lit(False)))
            & c.rlike("^[a-z]$"),
            F.upper(c),
        ).otherwise(c),
    )
    return F.when(spaced == "", spaced).otherwise(F.array_join(up, ""))


def blocked_by_chart(log: DataFrame) -> DataFrame:
    """A5: chart rows with display labels."""
    return blocked_by_counts(log).select(title_label(F.col("type")).alias("label"), "count")


def daily_counts(log: DataFrame, as_of: Column, days: int = 7, grain: str = "day") -> DataFrame:
    """A6 (P8): rows created in the ``days`` days up to ``as_of`` (inclusive
    lower bound), counted per UTC day (``grain='day'``, the stated intent) or
    per exact timestamp (``grain='exact'``, as coded). On a written log the
    predicate on ``created_date`` prunes its date partitions."""
    since = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = log.filter(F.col("created_at") >= since)
    if "created_date" in log.columns:
        recent = recent.filter(F.col("created_date") >= F.to_date(since))
    if grain == "day":
        key = F.date_format(F.col("created_at"), "yyyy-MM-dd").alias("day")
    elif grain == "exact":
        key = F.date_format(F.col("created_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at")
    else:
        raise ValueError(grain)
    return recent.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def status_distribution(log: DataFrame) -> DataFrame:
    """A7 (P9): (name, value) per status, zero slices dropped. Derived from
    the one-row counters, so it costs no extra scan."""
    s = dash_stats(log)
    unp = s.select(
        F.explode(
            F.array(
                F.struct(F.lit("Allowed").alias("name"), F.col("allowed").alias("value")),
                F.struct(F.lit("Blocked").alias("name"), F.col("blocked").alias("value")),
                F.struct(F.lit("Modified").alias("name"), F.col("modified").alias("value")),
            )
        ).alias("s")
    ).select("s.name", "s.value")
    return unp.filter(F.col("value") > 0)


def recent_requests(log: DataFrame, n: int = RECENT_LIMIT) -> DataFrame:
    """T1 (P5): newest ``n`` rows by creation time; ties broken by request id
    (ours). The ``n`` newest keys are found first, from the two columns that
    order them (a TakeOrderedAndProject: each task keeps its own top ``n``);
    the other columns are then fetched for these keys, at most ``n``, so they
    are broadcast. On a written log their dates prune its folders."""
    newest = [F.col("created_at").desc(), F.col("request_id")]
    by = ["created_at", "request_id"]
    dated = "created_date" in log.columns
    keys = log.select(*by, *["created_date"] * dated).orderBy(*newest).limit(n)
    if dated:
        oldest = keys.agg(F.min("created_date")).scalar()
        log = log.filter((F.col("created_date") >= oldest) | F.col("created_date").isNull())
    wanted = keys.select(*[F.col(c).alias("__" + c) for c in by])
    same = F.col("created_at").eqNullSafe(F.col("__created_at")) & F.col("request_id").eqNullSafe(F.col("__request_id"))
    return log.join(F.broadcast(wanted), same, "left_semi").select(*RECENT_COLUMNS).orderBy(*newest).limit(n)


def has_pii(pii_found: Column) -> Column:
    """P10: null, empty and ``[]`` count as no PII."""
    return F.coalesce(pii_found.isNotNull() & (pii_found != "") & (pii_found != "[]"), F.lit(False))


def recent_pii_count(log: DataFrame, n: int = RECENT_LIMIT) -> DataFrame:
    """Rows with PII among the recent ``n`` only (limit before filter)."""
    return recent_requests(log, n).agg(F.count_if(has_pii(F.col("pii_found"))).alias("pii_rows"))


def log_status(response_status: Column) -> Column:
    """Response status to the status written in the log."""
    return F.when(response_status.isin("blocked_input", "blocked_output"), "blocked").otherwise(response_status)
