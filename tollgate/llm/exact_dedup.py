"""Exact deduplication with a stateful stream.

Documents flow through Structured Streaming keyed by the digest of their
normalised text. The state lives in RocksDB on disk, has no watermark and so
never expires, and holds per digest the stable identifier (smallest id seen),
its content locator and the number of rows; a micro-batch reduces its rows
per digest before the shuffle, so a digest that a third of all rows share
costs one row per task. Each micro-batch appends the changed state entries to
the shared folder; the newest entry of a digest is its current state.

A digest that counts more than one row is a hit. For hits the full bytes are
read through the locators and compared: every row of a hit digest is fetched
by its locator (a join on the locator, spread evenly) and the smallest and
largest normalised texts of the digest must be the same bytes. Digests whose
texts differ are split by the bytes themselves.

Texts are equal when identical after replacing each run of white space
(bytes 20 and 09-0D) by one space.

Defined results: null text counts as empty; of equal texts the row with the
smallest id stays, rows with a null id after all others; a repeated id is
a row of its own and only one row of a group stays; an empty table gives no
rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import LOCATOR, by_value, keep_rows, locator, stored, written

by_value(__name__)

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    # many small stores: do not reserve disk space ahead of use
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
DIGEST_BITS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digest(norm: Column, bits: int = DIGEST_BITS) -> Column:
    """SHA-256 of the normalised text in lowercase hex, its first ``bits``
    bits (shorter only to provoke collisions in tests)."""
    return F.substring(F.sha2(norm.cast("binary"), 256), 1, bits // 4)


def state_stream(entries: DataFrame) -> DataFrame:
    """The keyed state over a stream of ``(digest, locator, id)``: smallest
    ``(id, locator)`` and row count per digest, kept without expiry."""
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")
    return entries.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))


def run_state(spark: SparkSession, path: str, schema, checkpoint: str, sink: str, per_batch: int | None = None) -> None:
    """Run the stream over all files now in ``path``; a later call with the
    same checkpoint takes only new files and goes on with the same state.
    A replayed batch overwrites its own output."""
    session = spark.newSession()
    partitions = "spark.sql.shuffle.partitions"
    for k, v in {**STATE_CONF, partitions: spark.conf.get(partitions)}.items():
        session.conf.set(k, v)
    reader = session.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader.option("maxBytesPerTrigger", 1 << 30)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.select("digest", "first.id", "first.locator", "n").write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    query = (state_stream(reader.parquet(path)).writeStream.outputMode("update")
             .option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start())
    query.awaitTermination()


def current_state(spark: SparkSession, sink: str) -> DataFrame:
    """Newest entry per digest: ``digest, keep_id, keep_locator, n``."""
    schema = f"digest string, id long, locator {LOCATOR}, n long, batch_id long"
    rows = spark.read.schema(schema).parquet(sink)
    newest = F.max_by(F.struct("id", "locator", "n"), "batch_id")
    return rows.groupBy("digest").agg(newest.alias("s")).select(
        "digest", F.col("s.id").alias("keep_id"), F.col("s.locator").alias("keep_locator"), F.col("s.n").alias("n"))


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), locator(docs).alias("locator"),
                       normalised(F.col(text_col)).alias("norm"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = DIGEST_BITS,
                per_batch: int | None = None) -> DataFrame:
    """``id, locator, digest, keep_id, keep_locator, group_size`` for every
    row of ``docs``; the row stays where ``locator`` equals
    ``keep_locator``."""
    spark, docs = docs.sparkSession, stored(docs)
    base = scratch_path(spark, "exact-dedup")
    rows = _located(docs, id_col, text_col)
    rows.select("id", "locator", digest(F.col("norm"), bits).alias("digest")).write.parquet(base + "/entries")
    entries = spark.read.schema(f"id long, locator {LOCATOR}, digest string").parquet(base + "/entries")
    if entries.isEmpty():
        return entries.select("id", "locator", "digest", F.col("id").alias("keep_id"),
                              F.col("locator").alias("keep_locator"), F.lit(1).cast("long").alias("group_size"))
    run_state(spark, base + "/entries", entries.schema, base + "/checkpoint", base + "/state", per_batch)
    state = written(current_state(spark, base + "/state"), "exact-dedup-state")
    found = entries.join(state, "digest")
    hits = found.filter("n > 1").select("locator", "digest")
    full = rows.join(hits, "locator").select("id", "locator", "digest", "norm")
    differing = written(full.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
                        .filter("a <> b").select("digest"), "exact-dedup-differing")
    if not differing.isEmpty():
        split = full.join(differing, "digest", "left_semi")
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "locator"))
        groups = written(split.groupBy("digest", "norm").agg(first.alias("f"), F.count(F.lit(1)).alias("m")), "exact-dedup-split")
        exact = split.join(groups, ["digest", "norm"]).select(
            "locator", F.col("f.id").alias("x_id"), F.col("f.locator").alias("x_locator"), "m")
        found = found.join(exact, "locator", "left").withColumns({
            "keep_id": F.when(F.col("m").isNull(), F.col("keep_id")).otherwise(F.col("x_id")),
            "keep_locator": F.coalesce("x_locator", "keep_locator"), "n": F.coalesce("m", "n")})
    return found.select("id", "locator", "digest", "keep_id", "keep_locator", F.col("n").alias("group_size"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, all columns of ``docs``."""
    docs = stored(docs)
    return keep_rows(docs, deduplicate(docs, id_col, text_col).filter("locator = keep_locator"))


def exact_dedup_query(docs: DataFrame) -> DataFrame:
    out = deduplicate(docs)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size",
                      (F.col("locator") == F.col("keep_locator")).alias("kept"), F.col("digest").alias("text_sha256"))


EXACT_DEDUP_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
