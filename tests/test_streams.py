"""Streams in several batches: unique ids, the request/response join, event time."""

import datetime as dt
import os
import threading

from pyspark.sql import functions as F

from tollgate.session import scratch_path
from tollgate.streaming import exchange, screen
from tollgate.streaming.registry import close_registry, registry
from tollgate.sources.tables import AUDIT_SCHEMA

T0 = dt.datetime(2024, 1, 1)


def _rows(spark, ids):
    return spark.createDataFrame([(f"log-{i}", i, "input", "x", None, "allowed", None, None, 1, None, T0) for i in ids], AUDIT_SCHEMA)


def test_two_writers_never_both_keep_an_id(spark):
    sink = scratch_path(spark, "test-two-writers")
    failed = []

    def write(query):
        try:
            for b in range(3):
                screen.idempotent_append(_rows(spark, [f"r{i}" for i in range(b * 10, b * 10 + 20)]), b, sink, query)
        except Exception as e:  # pragma: no cover
            failed.append(e)

    writers = [threading.Thread(target=write, args=(x,)) for x in ("one", "two")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    got = [r["request_id"] for r in spark.read.parquet(sink).select("request_id").collect()]
    assert sorted(got) == sorted({f"r{i}" for i in range(40)})
    # a batch delivered again, after a restart of the registry, changes nothing
    close_registry(sink)
    before = spark.read.parquet(sink).select("request_id", "query", "batch_id").collect()
    screen.idempotent_append(_rows(spark, [f"r{i}" for i in range(10, 30)]), 1, sink, "two")
    after = spark.read.parquet(sink).select("request_id", "query", "batch_id").collect()
    assert sorted(before) == sorted(after)
    close_registry(sink)


def test_a_batch_reads_the_same_files_however_large_the_sink(spark):
    sink = scratch_path(spark, "test-flat")
    read = []
    for b in range(6):
        ids = registry(spark, sink).claim(_rows(spark, [f"b{b}-{i}" for i in range(5)] + ["again"]).select("request_id"), "one", b)
        read.append(len(ids.inputFiles()))
        assert {r["request_id"] for r in ids.collect()} == {f"b{b}-{i}" for i in range(5)} | ({"again"} if b == 0 else set())
    assert max(read) <= spark.sparkContext.defaultParallelism and read[-1] <= read[0] + 1
    close_registry(sink)
    claims = [f for f in os.listdir(f"{sink}/_ids/claims") if f.endswith(".parquet")]
    assert len(claims) <= 3 * spark.sparkContext.defaultParallelism


def test_a_sink_written_without_registry_keeps_its_ids(spark):
    sink = scratch_path(spark, "test-older")
    _rows(spark, ["a", "b"]).write.parquet(f"{sink}/query=old/batch_id=0")
    screen.idempotent_append(_rows(spark, ["b", "c"]), 0, sink, "new")
    close_registry(sink)
    assert sorted(r["request_id"] for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]


def test_unanswered_requests_come_once(spark, tmp_path):
    asked, said = str(tmp_path / "asked"), str(tmp_path / "said")
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)

    def put(path, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    Q, A = "request_id string, input string, asked_at timestamp", "request_id string, response string, answered_at timestamp"
    put(asked, [("a", "x", at(0)), ("b", "y", at(1)), ("c", "z", at(2)), ("d", "w", at(3)), (None, "v", at(3))], Q)
    put(said, [("a", "first", at(5)), ("a", "second", at(6)), ("c", None, at(5)), (None, "n", at(5))], A)
    out = str(tmp_path / "out")

    def run():
        j = exchange.response_stream_join(spark.readStream.schema(Q).parquet(asked), spark.readStream.schema(A).parquet(said))
        (j.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start().awaitTermination())
        return sorted((r["request_id"] or "", r["response"], r["has_response"]) for r in spark.read.parquet(out).collect())

    assert run() == [("a", "first", True)]
    put(said, [("b", "in time", at(30)), ("d", "too late", at(90))], A)   # another batch, after a restart
    assert run() == [("a", "first", True), ("b", "in time", True)]
    put(asked, [("end", "", at(600))], Q)
    put(said, [("end", None, at(600)), ("none", "x", at(600))], A)
    run()
    assert run() == [("", "", False), ("a", "first", True), ("b", "in time", True), ("c", "", False), ("d", "", False)]


def test_late_rows_are_set_aside_and_days_close_once(spark):
    from tollgate.streaming import daily

    path, day = scratch_path(spark, "test-days"), lambda d, h=12: dt.datetime(2024, 1, d, h)

    def batch(n, times):
        daily.fold_days(spark.createDataFrame([(t,) for t in times], "created_at timestamp"), n, path)

    def days(rows):
        return {(r["day"].day, r["count"]) for r in rows.collect()}

    batch(0, [day(1), day(1), day(2, 0)])              # an hour of grace: the first day stays open
    assert days(daily.closed_days(spark, path)) == set() and days(daily.open_days(spark, path)) == {(1, 2), (2, 1)}
    batch(1, [day(1, 23), day(3), None])               # in time, though older than what came before
    assert days(daily.closed_days(spark, path)) == {(1, 3), (2, 1)} and days(daily.open_days(spark, path)) == {(3, 1)}
    for _ in range(2):                                 # a batch and its replay
        batch(2, [day(2), day(3), day(3)])
    assert days(daily.closed_days(spark, path)) == {(1, 3), (2, 1)} and days(daily.open_days(spark, path)) == {(3, 3)}
    assert sorted((r["batch_id"], r["created_at"] and r["created_at"].day) for r in daily.late_rows(spark, path).collect()) == [(1, None), (2, 2)]
    batch(3, [])
    assert days(daily.open_days(spark, path)) == {(3, 3)}
    assert len(os.listdir(f"{path}/open")) <= 2 and len(os.listdir(f"{path}/floor")) <= 2


def test_a_table_stream_reads_a_file_and_a_folder(spark, tmp_path):
    rows = spark.range(10).withColumn("doc_id", F.col("id"))
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for sf, n in ((str(tmp_path), 10), ("/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count())):
        out = screen.run_to_table(spark, screen.table_stream(spark, sf, "documents").select("doc_id"), "test-table")
        assert spark.read.parquet(out).count() == n
