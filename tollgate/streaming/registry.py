"""Request ids that stay unique in a growing sink.

A registry owns the ids of one audit sink. It is a stream of its own: a writer
puts the ids of its micro-batch into the folder ``claims``, the registry keeps
the first claim to each id (``dropDuplicates`` on state in RocksDB that never
expires) and writes it under the claimant's ``query`` and ``batch_id``. A batch
thus costs what its own ids cost: it reads its own claims and its own wins, and
looks ids up in the state by key, however many the sink holds. Claims that have
been decided are deleted.

One registry decides for all writers of a sink, one batch at a time, so two
queries that write at once never both keep an id. Writers of one application
share it; the registry of a second application over the same sink fails on the
checkpoint, with an error instead of a repeated id. A batch that is replayed
claims again, loses the new claims to its own old ones and reads the same wins.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists

CLAIM_SCHEMA = "request_id string, query string, batch_id long"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # all stores of an executor share one bounded memory, and no disk is reserved for what is not written yet
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

_running: dict[str, "IdRegistry"] = {}
_starting = threading.Lock()


class IdRegistry:
    """The running registry of one sink; see the module."""

    def __init__(self, spark: SparkSession, sink: str):
        self.sink, self.home = sink, f"{sink}/_ids"
        self.lock = threading.Lock()
        self.session = spark.newSession()
        for k, v in STATE_CONF.items():
            self.session.conf.set(k, v)
        self.session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
        if not path_exists(spark, f"{self.home}/claims"):
            self._first_claims(spark)
        claims = (self.session.readStream.schema(CLAIM_SCHEMA).option("cleanSource", "delete")
                  .parquet(f"{self.home}/claims"))
        self.query = (claims.dropDuplicates(["request_id"]).writeStream.queryName(f"ids of {sink}")
                      .option("checkpointLocation", f"{self.home}/_checkpoint")
                      .foreachBatch(self._decide).trigger(processingTime="100 milliseconds").start())
        self.query.processAllAvailable()

    def _first_claims(self, spark: SparkSession) -> None:
        """Ids of a sink that has none registered are claimed by the batches that hold them."""
        if path_exists(spark, self.sink):
            old = spark.read.schema(CLAIM_SCHEMA).parquet(self.sink)
        else:
            old = spark.createDataFrame([], CLAIM_SCHEMA)
        old.select("request_id", "query", "batch_id").write.mode("append").parquet(f"{self.home}/claims")

    def _decide(self, won: DataFrame, batch_id: int) -> None:
        """A replay of this batch sees the same claims, all of one writer's
        batch, and replaces the same folders."""
        (won.withColumn("decision", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("query", "batch_id", "decision").parquet(f"{self.home}/won"))

    def claim(self, ids: DataFrame, query: str, batch_id: int) -> DataFrame:
        """The ids (one column, ``request_id``) that this batch holds first."""
        spark = ids.sparkSession
        claims = ids.select("request_id", F.lit(query).alias("query"), F.lit(batch_id).cast("long").alias("batch_id"))
        with self.lock:
            claims.write.mode("append").parquet(f"{self.home}/claims")
            self.query.processAllAvailable()
        mine = f"{self.home}/won/query={query}/batch_id={batch_id}"
        if not path_exists(spark, mine):
            return spark.createDataFrame([], "request_id string")
        return spark.read.schema("request_id string").parquet(mine).select("request_id")


def registry(spark: SparkSession, sink: str) -> IdRegistry:
    """The registry of ``sink``, started if it does not run."""
    with _starting:
        found = _running.get(sink)
        if found is None or not found.query.isActive:
            found = _running[sink] = IdRegistry(spark, sink)
        return found


def close_registry(sink: str) -> None:
    """Stop the registry of ``sink``; the next writer starts it again."""
    with _starting:
        found = _running.pop(sink, None)
    if found is not None:
        with found.lock:
            found.query.stop()
