"""Policies in force by time (S4, J3): stored rule rows as versions.

A stored rule row holds from its ``created_at`` until the next row of its type.
Each request takes the rules in force at its own time. Nothing is collected:
the versions become one row per day that has requests (those carried into the
day and those that begin in it), written to the shared folder, and requests
look their day up. That table grows with days and rule changes, not with
requests; its written size decides whether Spark broadcasts it, in which case
no request text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .policy import INPUT_TYPES, OUTPUT_TYPES

CONFIG_SCHEMA = "action string, enforce boolean, fields array<string>"
TYPES = INPUT_TYPES + OUTPUT_TYPES


def rule_versions(table: DataFrame) -> DataFrame:
    """``type, since, enabled, action, enforce, fields`` of the stored rule
    rows (``POLICY_TABLE_SCHEMA``) of known types. The JSON of ``config`` is read
    in the JVM; what cannot be read, or lacks an action, has a null action. A
    null ``enabled`` disables (R1a). Rows without a time hold from the start. Of
    rows that begin at once, the smallest id counts."""
    known = table.filter(F.col("type").isin(*TYPES))
    since = F.coalesce("created_at", F.lit("0001-01-01 00:00:00").cast("timestamp"))
    config = F.from_json("config", CONFIG_SCHEMA)
    rows = known.select("type", since.alias("since"), F.col("id").alias("_id"),
                        F.struct(F.coalesce("enabled", F.lit(False)).alias("enabled"), config.alias("config")).alias("_v"))
    first = rows.groupBy("type", "since").agg(F.min_by("_v", "_id").alias("_v"))
    return first.select("type", "since", "_v.enabled", F.nullif(F.col("_v.config.action"), F.lit("")).alias("action"),
                        "_v.config.enforce", "_v.config.fields")


def _timeline(days: DataFrame, versions: DataFrame) -> DataFrame:
    """``day, versions``: for each day the versions that count in it, by time."""
    version = F.struct("since", "type", "enabled", "action", "enforce", "fields")
    begun = versions.select(F.to_date("since").alias("day"), "type", version.alias("v"))
    asked = days.select("day", F.explode(F.array(*[F.lit(t) for t in TYPES])).alias("type"), F.lit(None).cast(
        begun.schema["v"].dataType).alias("v"))
    # a day's question goes before what begins in it, so it finds what it is carried
    order = Window.partitionBy("type").orderBy("day", F.col("v").isNotNull(), "v.since")
    carried = asked.unionByName(begun).withColumn("_in", F.last("v", ignorenulls=True).over(order)).filter("v IS NULL")
    counts = carried.select("day", F.col("_in").alias("v")).unionByName(begun.join(days, "day", "left_semi").select("day", "v"))
    return counts.filter("v IS NOT NULL").groupBy("day").agg(F.array_sort(F.collect_list("v")).alias("versions"))


def rules_in_force(requests: DataFrame, table: DataFrame, at: str = "created_at", name: str = "rules_in_force") -> DataFrame:
    """``requests`` with ``name``, an array of ``type, enabled, action, enforce,
    fields``: the version of each rule type in force at the time ``at`` (a
    version holds from its very first moment). A type without one is left out,
    so the base policy counts; a request without a time has an empty array."""
    spark = requests.sparkSession
    days = requests.select(F.to_date(at).alias("day")).filter("day IS NOT NULL").distinct()
    path = scratch_path(spark, "rules-in-force")
    _timeline(days, rule_versions(table)).write.parquet(path)
    found = requests.withColumn("_day", F.to_date(at)).join(
        spark.read.parquet(path).withColumnsRenamed({"day": "_day", "versions": "_versions"}), "_day", "left")

    def newest(t: str) -> Column:
        return F.try_element_at(F.filter("_versions", lambda v: (v["type"] == t) & (v["since"] <= F.col(at))), F.lit(-1))

    rules = F.array_compact(F.array(*[newest(t) for t in TYPES]))
    kept = F.transform(rules, lambda v: F.struct(*[v[c].alias(c) for c in ("type", "enabled", "action", "enforce", "fields")]))
    empty = F.array().cast("array<struct<type:string,enabled:boolean,action:string,enforce:boolean,fields:array<string>>>")
    return found.withColumn(name, F.coalesce(kept, empty)).drop("_day", "_versions")
