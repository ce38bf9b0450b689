"""Requests and recorded responses as two streams.

A request waits for its response for a bounded event time. The join is a
stream-stream left outer join: its state holds requests and responses within
that time only, an answered request is emitted when both are there, and an
unanswered one once, when the watermark says that no response can follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

REQUEST_COLUMNS = "request_id string, input string, asked_at timestamp"
RESPONSE_COLUMNS = "request_id string, response string, answered_at timestamp"
DAY_ONE = "2024-01-01 00:00:00"


def response_stream_join(requests: DataFrame, responses: DataFrame, within: str = "1 hour",
                         watermark: str = "10 minutes") -> DataFrame:
    """J1 on streams: ``requests`` (``request_id``, ``asked_at`` and any other
    columns) with the response of ``responses`` (``request_id``, ``response``,
    ``answered_at``) that came no earlier than the request and at most ``within``
    after it. A null response is no response, and requests without an id are
    answered by none. Of several responses to one request the first to arrive
    counts. Adds ``response`` (empty if there is none) and ``has_response``.

    Rows later than ``watermark`` behind what their stream has shown are
    dropped, as Spark does; a stream at rest holds back the unanswered requests
    of the last ``within`` until something newer arrives in both."""
    asked = requests.withWatermark("asked_at", watermark)
    answered = (responses.filter("response IS NOT NULL AND request_id IS NOT NULL").withWatermark("answered_at", watermark)
                .select(F.col("request_id").alias("_answers"), "response", "answered_at")
                .dropDuplicatesWithinWatermark(["_answers"]))
    on = F.expr(f"request_id = _answers AND answered_at >= asked_at AND answered_at <= asked_at + INTERVAL {within}")
    joined = asked.join(answered, on, "left_outer")
    return joined.withColumn("has_response", F.col("response").isNotNull()).withColumn(
        "response", F.coalesce("response", F.lit(""))).drop("_answers", "answered_at")


def deliver(pairs: DataFrame, steps: int, home: str) -> int:
    """Write the rows of ``pairs`` (``conv_id, turn, request_id, input, response,
    has_response``) as requests and responses that arrive in ``steps`` days,
    conversation by conversation. The last answers of a day's requests are
    delivered with the next day's files, and a last row in each folder says that
    the time has passed. Returns the number of files of the larger folder."""
    day = F.pmod(F.xxhash64("conv_id"), F.lit(steps)).cast("int")
    seconds = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(1800)).cast("int")
    at = F.lit(DAY_ONE).cast("timestamp") + F.make_dt_interval(day, F.lit(0), F.lit(0), seconds)
    rows = pairs.withColumn("asked_at", at).withColumn("day", day)
    late = (F.pmod(F.xxhash64("request_id"), F.lit(3)) == 0).cast("int")
    answers = rows.filter("has_response").select(
        "request_id", "response", (F.col("asked_at") + F.expr("INTERVAL 20 MINUTES")).alias("answered_at"),
        (F.col("day") + late).alias("day"))
    spark, over = pairs.sparkSession, f"TIMESTAMP '{DAY_ONE}' + INTERVAL {steps + 30} DAYS"
    rows = rows.select("request_id", "input", "asked_at", "day").unionByName(
        spark.sql(f"SELECT CAST(NULL AS STRING) AS request_id, '' AS input, {over} AS asked_at, {steps + 1} AS day"))
    answers = answers.unionByName(
        spark.sql(f"SELECT '' AS request_id, '' AS response, {over} AS answered_at, {steps + 1} AS day"))
    for name, table in (("requests", rows), ("responses", answers)):
        table.hint("rebalance", "day").write.partitionBy("day").parquet(f"{home}/days/{name}")
        for d in range(steps + 2):
            day_rows = spark.read.schema(table.schema).parquet(f"{home}/days/{name}").filter(F.col("day") == d)
            day_rows.drop("day").write.mode("append").parquet(f"{home}/{name}")
    return max(len(spark.read.parquet(f"{home}/{name}").inputFiles()) for name in ("requests", "responses"))


def delivered_streams(pairs: DataFrame, steps: int = 3) -> DataFrame:
    """The stream-stream join over ``pairs`` delivered in several batches. The
    row that says that the time has passed comes out too, without an id: a
    filter here would be pushed below the watermark."""
    spark, home = pairs.sparkSession, scratch_path(pairs.sparkSession, "exchange")
    each = max(1, deliver(pairs, steps, home) // (steps + 2))
    asked, said = (spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(f"{home}/{name}")
                   for name, schema in (("requests", REQUEST_COLUMNS), ("responses", RESPONSE_COLUMNS)))
    return response_stream_join(asked, said, "1 hour", f"{24 * (steps + 1)} hours")
