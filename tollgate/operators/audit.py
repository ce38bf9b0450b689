"""Audit log: row shapes, unique request ids, append, clear (K1-K6).

The log is a parquet table partitioned by ``created_date`` so the 7-day
window of the dashboard prunes partitions. Appends are idempotent per
request id: a batch is first reduced to one row per id, then rows whose id
is already in the log are dropped with a left-anti join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pii as piif
from ..session import path_exists
from ..sources.tables import AUDIT_COLUMNS, AUDIT_SCHEMA


def _s(c) -> Column:
    return (F.lit(c) if not isinstance(c, Column) else c).cast("string")


def audit_rows(
    screened: DataFrame,
    profile: str = "live",
    input_col: str = "input",
    response_col: str | None = "response",
    dry_run: str | None = None,
    created_at: Column | None = None,
    latency_ms: Column | None = None,
    id_col: Column | None = None,
) -> DataFrame:
    """K1: one audit row per screened request in the shape its logging site
    writes (six shapes; see the README). ``screened`` comes from
    ``screen_requests`` (live/library) or ``screen_input`` (suite, dry-run
    only inputs). Ids default to ``log-<request_id>``; ``created_at`` and
    ``latency_ms`` are supplied as columns (null when not given)."""
    pii_json = piif.pii_json(F.col("pii"))
    in_status = F.col("input_status")
    blocked_in = in_status == "blocked"
    has_out = "output_status" in screened.columns
    if profile == "suite" or not has_out:
        direction = F.lit("input")
        status = in_status
        blocked_by = F.col("blocked_by")
        reason = F.col("reason")
        out_text = _s(None)
        pj = pii_json
    elif profile == "live":
        dry = F.coalesce(F.col(dry_run), F.lit(False)) if dry_run else F.lit(False)
        out_blocked = F.col("output_status") == "blocked"
        input_row = blocked_in | dry
        direction = F.when(input_row, "input").otherwise("output")
        status = (
            F.when(blocked_in, "blocked")
            .when(dry, F.when(in_status == "modified", "modified").otherwise("allowed"))
            .when(out_blocked, "blocked")
            .otherwise("allowed")
        )
        blocked_by = (
            F.when(blocked_in, F.col("blocked_by"))
            .when(dry, F.when(in_status == "modified", "pii"))
            .when(out_blocked, F.col("output_blocked_by"))
        )
        reason = (
            F.when(blocked_in, F.col("reason"))
            .when(dry, F.when(in_status == "modified", F.col("reason")))
            .when(out_blocked, F.col("output_reason"))
        )
        out_text = F.when(~input_row & ~out_blocked, F.col(response_col))
        # a dry-run allowed row logs no PII even when some was found
        pj = F.when(dry & ~blocked_in & (in_status != "modified"), _s(None)).otherwise(pii_json)
    elif profile == "library":
        out_blocked = F.col("output_status") == "blocked"
        direction = F.when(blocked_in, "input").otherwise("output")
        status = F.when(blocked_in | out_blocked, "blocked").otherwise("allowed")
        blocked_by = F.when(blocked_in, F.col("blocked_by")).otherwise(F.col("output_blocked_by"))
        reason = F.when(blocked_in, F.col("reason")).otherwise(F.col("output_reason"))
        out_text = F.when(~blocked_in, F.col(response_col))
        pj = pii_json
    else:
        raise ValueError(f"unknown profile {profile!r}")
    rid = F.col("request_id").cast("string")
    return screened.select(
        (id_col if id_col is not None else F.concat(F.lit("log-"), rid)).cast("string").alias("id"),
        rid.alias("request_id"),
        direction.alias("direction"),
        F.col(input_col).alias("input_text"),
        _s(out_text).alias("output_text"),
        status.cast("string").alias("status"),
        _s(blocked_by).alias("blocked_by"),
        _s(reason).alias("reason"),
        (latency_ms if latency_ms is not None else F.lit(None)).cast("int").alias("latency_ms"),
        _s(pj).alias("pii_found"),
        (created_at if created_at is not None else F.current_timestamp()).cast("timestamp").alias("created_at"),
    )


def dedupe_requests(log: DataFrame) -> DataFrame:
    """K2 in a batch: one row per request id, the earliest (then smallest id,
    then the rest of the row), deterministic. A grouped ``min`` over a struct
    aggregates map-side before the shuffle, so a request id repeated in a
    third of all rows costs one partial row per task, not one giant group."""
    rest = [c for c in log.columns if c not in ("request_id", "created_at", "id")]
    packed = F.struct(F.col("created_at"), F.col("id"), *[F.col(c) for c in rest])
    agg = log.groupBy("request_id").agg(F.min(packed).alias("_r"))
    return agg.select("request_id", "_r.*").select(*log.columns)


def new_rows_only(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """K2 across batches: drop ids already in the log (left-anti join; the
    log grows with the data, so it is never broadcast blindly)."""
    return dedupe_requests(batch).join(existing.select("request_id"), "request_id", "left_anti")


def with_created_date(log: DataFrame) -> DataFrame:
    return log.withColumn("created_date", F.to_date("created_at"))


def write_audit_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """K1 sink: parquet, partitioned by creation date. The rows of a date are
    brought together first, by size: small dates make one file, a date too
    large for one task is split, and files do not multiply with the tasks."""
    dated = with_created_date(log.select(*AUDIT_COLUMNS)).hint("rebalance", "created_date")
    dated.write.mode(mode).partitionBy("created_date").parquet(path)


def append_audit_log(spark: SparkSession, batch: DataFrame, path: str) -> None:
    """Append only requests not yet logged."""
    from ..sources.tables import read_audit_log

    if path_exists(spark, path):
        rows = new_rows_only(batch, read_audit_log(spark, path))
    else:
        rows = dedupe_requests(batch)
    write_audit_log(rows, path, "append")


def clear_log(spark: SparkSession, path: str) -> DataFrame:
    """K3: replace the log by an empty table of the same schema, also where
    the session overwrites partitions dynamically."""
    empty = with_created_date(spark.createDataFrame([], AUDIT_SCHEMA))
    empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("created_date").parquet(path)
    return spark.read.schema(AUDIT_SCHEMA + ", created_date date").parquet(path)
