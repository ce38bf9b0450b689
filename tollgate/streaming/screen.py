"""Structured Streaming forms of screening and the dashboard.

The same column functions run on ``readStream`` sources. A long-running query
keeps its checkpoint beside its sink under its name, so a second start (lost
executor, lost driver) resumes from its offsets; the audit sink is idempotent
per ``(query, batch_id)``: a replayed batch overwrites its own folder instead
of appending twice, and request ids stay unique across batches and queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, dashboard
from ..operators.pairs import screen_requests
from ..operators.policy import DEFAULT_POLICY, Policy
from ..operators.verdict import screen_input
from ..session import path_exists, remove_path, scratch_path
from ..sources.tables import events_as_audit, spread, table_path
from . import daily
from .exchange import delivered_streams
from .registry import close_registry, registry


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None,
                 partitions: int | None = None) -> DataFrame:
    """A file stream over one driver table, a file or a folder of files (the
    schema is taken from the table once, never inferred per batch).
    ``partitions`` spreads the rows of each micro-batch; off by default."""
    path = table_path(sf_dir, name)
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    # a pattern that fits the table only: a stream takes a single file by a pattern, not by its path
    return spread(r.parquet(table_path(sf_dir, f"[{name[0]}]{name[1:]}")), partitions)


def events_audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_audit(table_stream(spark, sf_dir, "events"))


def screen_stream(stream: DataFrame, text: str = "text", policy: Policy = DEFAULT_POLICY,
                  profile: str = "live") -> DataFrame:
    """Stateless screening of a request stream (append mode)."""
    return screen_input(stream, text, policy, profile)


def run_to_table(spark: SparkSession, df: DataFrame, name: str, mode: str = "append",
                 foreach: Callable | None = None) -> str:
    """Run a streaming query over everything available now, into a parquet
    folder (or through ``foreach``), and return the output folder."""
    out = scratch_path(spark, name)
    w = df.writeStream.option("checkpointLocation", out + "/_checkpoint").outputMode(mode)
    if foreach is not None:
        w = w.foreachBatch(lambda bdf, bid: foreach(bdf, bid, out + "/data"))
    else:
        w = w.format("parquet").option("path", out + "/data")
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover
        raise RuntimeError(str(q.exception()))
    return out + "/data"


def idempotent_append(bdf: DataFrame, batch_id: int, path: str, query: str = "batch") -> None:
    """W2 sink: each micro-batch of each query owns one folder, so a replay
    of a batch overwrites itself and two queries share a sink. Rows are
    reduced to one per request id, and those stay whose id this batch claims
    first among all batches of the sink (``registry``); no other batch is read."""
    ids = registry(bdf.sparkSession, path)
    bdf.persist()  # read for its ids and for its rows, screened once
    try:
        won = ids.claim(bdf.select("request_id").distinct(), query, batch_id)
        rows = audit.dedupe_requests(bdf).join(won, "request_id", "left_semi").select(*bdf.columns)
        audit.with_created_date(rows).write.mode("overwrite").parquet(f"{path}/query={query}/batch_id={batch_id}")
    finally:
        bdf.unpersist()


def run_steps(spark: SparkSession, steps: Sequence[DataFrame], name: str, build: Callable[[DataFrame], DataFrame],
              foreach: Callable | None = None) -> str:
    """Deliver ``steps`` one after another to a streaming query, each as one
    micro-batch whatever its size, the query being stopped and started again
    from its checkpoint in between. Returns the output folder."""
    out = scratch_path(spark, name)
    for rows in steps:
        rows.write.mode("append").parquet(out + "/in")
        w = build(spark.readStream.schema(rows.schema).parquet(out + "/in")).writeStream
        w = w.option("checkpointLocation", out + "/_checkpoint")
        if foreach is not None:
            w = w.foreachBatch(lambda bdf, bid: foreach(bdf, bid, out + "/data"))
        else:
            w = w.format("parquet").option("path", out + "/data")
        w.trigger(availableNow=True).start().awaitTermination()
    return out + "/data"


KEEP_VERSIONS = 3


def _published(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """``(seq, version)`` of the versions on offer, oldest first: a few rows,
    since old ones are removed."""
    if not path_exists(spark, f"{path}/commits"):
        return []
    rows = spark.read.schema("version string, seq long").parquet(f"{path}/commits").collect()
    return sorted((r["seq"], r["version"]) for r in rows)


def overwrite_result(bdf: DataFrame, batch_id: int, path: str, keep: int = KEEP_VERSIONS) -> None:
    """Complete-mode results: each batch writes a version of its own, and
    then, in one file that appears whole, says that it is the newest. The
    order of versions is that of publication, so a query started anew, whose
    batches count from 0 again, goes on after the old ones. All but the last
    ``keep`` versions are removed, those being read longest after."""
    spark, version = bdf.sparkSession, uuid.uuid4().hex
    bdf.write.parquet(f"{path}/data/{version}")
    before = _published(spark, path)
    seq = before[-1][0] + 1 if before else 0
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{path}/commits/seq={seq}")
    for old, name in before[:max(0, len(before) + 1 - keep)]:
        remove_path(spark, f"{path}/commits/seq={old}")
        remove_path(spark, f"{path}/data/{name}")


def newest_result(spark: SparkSession, path: str) -> DataFrame:
    """The version published last; one being written is not on offer yet."""
    return spark.read.parquet(f"{path}/data/{_published(spark, path)[-1][1]}")


def stream_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = screen_stream(table_stream(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    out = s.select("doc_id", "input_status", "blocked_by", "reason", F.size("pii").cast("bigint").alias("pii_count"))
    return spark.read.parquet(run_to_table(spark, out, "stream-screen"))


def stream_audit(spark: SparkSession, sf_dir: str, as_of: str = "2024-01-15 12:00:00") -> DataFrame:
    """Screened documents become input-direction audit rows, appended
    through the idempotent sink."""
    s = screen_stream(
        table_stream(spark, sf_dir, "documents").select(
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("request_id"), "text"
        ),
        "text",
    )
    rows = audit.audit_rows(s, "live", "text", None, created_at=F.lit(as_of).cast("timestamp"))
    out = run_to_table(spark, rows, "stream-audit", foreach=idempotent_append)
    close_registry(out)
    return spark.read.parquet(out)


def stream_conversations(pairs: DataFrame) -> DataFrame:
    """Requests and recorded responses arrive as two streams, are
    joined in event time and screened end to end."""
    s = screen_requests(delivered_streams(pairs), "input", "response")
    out = s.select("request_id", "input_status", "blocked_by", "response_status", "output_status", "output_blocked_by",
                   "output_reason", "output", "intent")
    spark = pairs.sparkSession
    return spark.read.parquet(run_to_table(spark, out, "stream-conversations")).filter("request_id IS NOT NULL")


def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard counters as a complete-mode streaming aggregate
    (a real deployment triggers every 5 seconds; here: everything now)."""
    stats = dashboard.dash_stats(events_audit_stream(spark, sf_dir))
    return newest_result(spark, run_to_table(spark, stats, "stream-stats", "complete", overwrite_result))


def stream_daily(spark: SparkSession, sf_dir: str, watermark: str = "1 hour") -> DataFrame:
    """Per-day counts over a stream, daily tumbling windows behind a
    watermark; complete mode so the last (still open) day is reported."""
    log = events_audit_stream(spark, sf_dir).withWatermark("created_at", watermark)
    daily = log.groupBy(F.window("created_at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("count"))
    out = daily.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "count")
    return newest_result(spark, run_to_table(spark, out, "stream-daily", "complete", overwrite_result))


def stream_daily_closed(spark: SparkSession, steps: Sequence[DataFrame], delay: str = "1 hour") -> DataFrame:
    """W4 with event time that acts: per day the counted rows, whether the day
    has closed, and the rows that came after that and were set aside."""
    out = run_steps(spark, steps, "stream-daily-closed", lambda s: s, partial(daily.fold_days, delay=delay))
    days = daily.closed_days(spark, out).withColumn("closed", F.lit(True)).unionByName(
        daily.open_days(spark, out).withColumn("closed", F.lit(False)))
    late = daily.late_rows(spark, out).groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("late"))
    both = days.join(late, "day", "full_outer")
    return both.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                       F.coalesce("late", F.lit(0)).cast("long").alias("late"), F.coalesce("closed", F.lit(True)).alias("closed"))


def stream_dedup_expiry(spark: SparkSession, steps: Sequence[DataFrame], watermark: str = "10 minutes") -> DataFrame:
    """W5 over several batches: a request id is kept for ``watermark`` after
    its first row, and one that returns after that is let through."""
    def build(s: DataFrame) -> DataFrame:
        return s.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["request_id"]).select("request_id", "id")

    return spark.read.parquet(run_steps(spark, steps, "stream-dedup-expiry", build))


def stream_dedup(spark: SparkSession, sf_dir: str, watermark: str = "10 minutes") -> DataFrame:
    """The log delivered twice (replay a minute later); duplicates of a
    request id within the watermark are dropped, state expires with it."""
    log = events_audit_stream(spark, sf_dir)
    replay = events_audit_stream(spark, sf_dir).withColumn(
        "created_at", F.col("created_at") + F.expr("INTERVAL 1 MINUTE")
    )
    both = log.unionByName(replay).withWatermark("created_at", watermark)
    dedup = both.dropDuplicatesWithinWatermark(["request_id"]).select("request_id")
    return spark.read.parquet(run_to_table(spark, dedup, "stream-dedup"))


# --------------------------------------------------------------------------
# Long-running forms (W2, W3): a processing-time trigger instead of "all
# available now". Checkpoints default to a folder of the sink named after the
# query, so a second start resumes from the last committed offsets.
# --------------------------------------------------------------------------


def start_audit_stream(requests: DataFrame, sink: str, text: str = "input", policy: Policy = DEFAULT_POLICY,
                       profile: str = "live", checkpoint: str | None = None, trigger: str = "5 seconds",
                       created_at=None, name: str = "tollgate-audit"):
    """W1+W2: screen a request stream (``request_id`` and ``text`` columns)
    and append input-direction audit rows under ``sink`` through the
    per-batch idempotent sink. Returns the running ``StreamingQuery``."""
    spark = requests.sparkSession
    s = screen_input(requests, text, policy, profile)
    rows = audit.audit_rows(s, profile if profile == "suite" else "live", text, None,
                            created_at=created_at if created_at is not None else F.current_timestamp())
    ck = checkpoint or f"{sink}/_checkpoints/{name}"
    if path_exists(spark, f"{sink}/query={name}") and not path_exists(spark, f"{ck}/offsets"):
        raise ValueError(f"{sink} has rows of query {name!r}, but {ck} is a new checkpoint and would overwrite them")
    return (rows.writeStream.queryName(name).option("checkpointLocation", ck)
            .foreachBatch(lambda bdf, bid: idempotent_append(bdf, bid, sink, name))
            .trigger(processingTime=trigger).start())


def start_stats_stream(audit_log: DataFrame, sink: str, checkpoint: str | None = None,
                       trigger: str = "5 seconds", name: str = "tollgate-stats"):
    """The dashboard counters kept current under ``sink`` (complete mode,
    a version published at each trigger). A new checkpoint counts its input
    anew and publishes after what is there."""
    spark = audit_log.sparkSession
    stats = dashboard.dash_stats(audit_log)
    ck = checkpoint or f"{sink}/_checkpoints/{name}"
    return (stats.writeStream.queryName(name).outputMode("complete").option("checkpointLocation", ck)
            .foreachBatch(lambda bdf, bid: overwrite_result(bdf, bid, sink))
            .trigger(processingTime=trigger).start())
