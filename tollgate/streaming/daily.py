"""Daily counts of a stream in which event time acts.

Each micro-batch folds its rows into a small table of open days. A day closes
when the newest event time, less the allowed delay, has passed its end; it is
then published once and never changes. A row of a day that has closed, or
without a time, is not lost: it is set aside, whole, in a side table.

Each batch owns a folder in each table and replaces it when replayed. It reads
the open days and the floor of its predecessor only; older ones are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, remove_path

DAYS = "day date, count long"


def _day_end(time: str):
    return (F.to_date(time) + F.lit(1)).cast("timestamp")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def fold_days(bdf: DataFrame, batch_id: int, path: str, delay: str = "1 hour", time: str = "created_at") -> None:
    """Sink of a stream: ``late``, ``open`` and ``closed`` under ``path``. The
    floor that judges a batch comes from the batches before it, as with Spark's
    own watermark, so the rows of one batch are never late for each other."""
    spark, before = bdf.sparkSession, batch_id - 1
    row = _read(spark, f"{path}/floor/batch_id={before}", "floor timestamp").first()
    floor = F.lit(row["floor"] if row else None).cast("timestamp")
    late = F.col(time).isNull() | F.coalesce(_day_end(time) <= floor, F.lit(False))
    bdf.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
    fresh = bdf.filter(~late)
    newest = fresh.agg(F.greatest(floor, F.max(time) - F.expr(f"INTERVAL {delay}")).alias("floor"))
    newest.write.mode("overwrite").parquet(f"{path}/floor/batch_id={batch_id}")
    now = F.lit(spark.read.parquet(f"{path}/floor/batch_id={batch_id}").first()["floor"]).cast("timestamp")
    counts = fresh.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("count"))
    days = counts.unionByName(_read(spark, f"{path}/open/batch_id={before}", DAYS)).groupBy("day").agg(F.sum("count").alias("count"))
    days = days.withColumn("_closed", F.coalesce(_day_end("day") <= now, F.lit(False)))
    for name, rows in (("closed", days.filter("_closed")), ("open", days.filter("NOT _closed"))):
        rows.drop("_closed").coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
    for name in ("open", "floor"):
        remove_path(spark, f"{path}/{name}/batch_id={batch_id - 2}")


def closed_days(spark: SparkSession, path: str) -> DataFrame:
    """``day, count`` of the days that have closed, each once."""
    return _read(spark, f"{path}/closed", DAYS).select("day", "count")


def open_days(spark: SparkSession, path: str) -> DataFrame:
    """``day, count`` so far of the days still open after the newest batch."""
    rows = _read(spark, f"{path}/open", DAYS + ", batch_id long")
    return rows.join(rows.agg(F.max("batch_id").alias("batch_id")), "batch_id", "left_semi").drop("batch_id")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows set aside, with the batch that brought them."""
    return spark.read.parquet(f"{path}/late")
