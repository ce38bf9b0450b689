"""Table sources: the driver tables, request files, the audit log.

Scans read parquet with column pruning; filters placed on the result reach
the parquet reader as pushed filters. ``spread`` repartitions an input that
its caller knows to be small; it is off unless a number is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

REQUEST_SCHEMA = (
    "request_id string, input string, dry_run boolean, "
    "rules array<struct<type:string,enabled:boolean>>"
)

AUDIT_SCHEMA = (
    "id string, request_id string, direction string, input_text string, "
    "output_text string, status string, blocked_by string, reason string, "
    "latency_ms int, pii_found string, created_at timestamp"
)
AUDIT_COLUMNS = [c.strip().split(" ")[0] for c in AUDIT_SCHEMA.split(",")]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin repartition into ``partitions`` parts, for inputs known to
    be too small to give every core a scan split; off by default."""
    return df if partitions is None else df.repartition(partitions)


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Request rows ``{request_id, input, dry_run, rules}`` with a fixed
    schema (nothing inferred). In JSON, a record whose ``rules`` is not a
    list cannot be read into the typed schema and lands in ``_corrupt``."""
    if fmt == "json":
        schema = REQUEST_SCHEMA + ", _corrupt string"
        return (
            spark.read.schema(schema)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt")
            .json(path)
        )
    return spark.read.schema(REQUEST_SCHEMA).format(fmt).load(path)


def read_requests_stream(spark: SparkSession, path: str, fmt: str = "parquet", glob: str | None = None) -> DataFrame:
    """Streaming form of S1."""
    r = spark.readStream.schema(REQUEST_SCHEMA)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.format(fmt).load(path)


INPUT_REQUIRED = "Input text is required."
UNREADABLE = "Request could not be read."


def request_outcomes(requests: DataFrame) -> DataFrame:
    """Rows of ``read_requests`` with ``error``: what cannot be read (R1b: a
    ``rules`` that is no list, a record cut off) and what has no input (P1)
    stays as a row, under its request id where that can be made out."""
    named = F.regexp_extract("_corrupt", '"request_id" *: *"([^"\\\\]+)"', 1)
    error = F.when(F.col("_corrupt").isNotNull(), UNREADABLE).when(F.col("input").isNull() | (F.length("input") == 0), INPUT_REQUIRED)
    return requests.withColumn("request_id", F.coalesce("request_id", F.when(named != "", named))).withColumn("error", error)


def valid_requests(requests: DataFrame, text: str = "input", strict: bool = False) -> DataFrame:
    """Input present and non-empty (whitespace-only passes); P2 with
    ``strict``: non-blank after trimming."""
    t = F.col(text)
    cond = t.isNotNull() & (F.length(t) > 0)
    if strict:
        cond = cond & (F.length(F.trim(t)) > 0)
    return requests.filter(cond)


def rejected_requests(requests: DataFrame, text: str = "input", strict: bool = False) -> DataFrame:
    """The complement of ``valid_requests`` with an error message column."""
    t = F.col(text)
    ok = t.isNotNull() & (F.length(t) > 0)
    if strict:
        ok = ok & (F.length(F.trim(t)) > 0)
    return requests.filter(~F.coalesce(ok, F.lit(False))).withColumn("error", F.lit(INPUT_REQUIRED))


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """The audit log as written by ``audit.write_audit_log``."""
    return spark.read.schema(AUDIT_SCHEMA + ", created_date date").parquet(path)


# Event type -> (status, blocked_by) for the stand-in audit log.
EVENT_STATUS = {
    "error": ("blocked", "prompt_injection"),
    "purchase": ("modified", "pii"),
    "signup": ("blocked", "toxicity"),
}


def events_as_audit(events: DataFrame) -> DataFrame:
    """The ``events`` table read as an audit log: event id -> request id,
    timestamp -> created_at (UTC), event type -> status/blocked_by,
    floor(value) -> latency. Purchase rows carry their props as the PII
    JSON, so the non-empty-PII flag has something to count."""
    et = F.col("event_type")
    status = F.lit("allowed")
    blocked_by = F.lit(None).cast("string")
    for k, (s, b) in reversed(list(EVENT_STATUS.items())):
        status = F.when(et == k, s).otherwise(status)
        blocked_by = F.when(et == k, b).otherwise(blocked_by)
    return events.select(
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("id"),
        F.col("event_id").cast("string").alias("request_id"),
        F.lit("input").alias("direction"),
        F.col("props").alias("input_text"),
        F.lit(None).cast("string").alias("output_text"),
        status.alias("status"),
        blocked_by.alias("blocked_by"),
        F.when(status != "allowed", F.concat(F.lit("event: "), et)).alias("reason"),
        F.floor("value").cast("int").alias("latency_ms"),
        F.when(et == "purchase", F.col("props")).alias("pii_found"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def audit_log_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_audit(read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value", "props"]))
