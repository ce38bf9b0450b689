"""Dashboard aggregates, audit rows, dedupe, append, clear."""

import os

from pyspark.sql import functions as F

from tollgate.operators import audit, dashboard
from tollgate.session import scratch_path
from tollgate.sources.tables import AUDIT_SCHEMA
from tollgate.streaming import screen


def _log(spark, rows):
    return spark.createDataFrame(rows, AUDIT_SCHEMA)


def test_to_fixed(spark):
    vals = [23 / 80 * 100, 0.15, 28.65, 0.25, 0.75, 12.25, 100.0, 1 / 3 * 100, 0.05]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.s for r in df.select(dashboard.to_fixed_1(F.col("x")).alias("s")).collect()]
    assert got == ["28.7", "0.1", "28.6", "0.3", "0.8", "12.3", "100.0", "33.3", "0.1"]


def test_empty_log_stats(spark):
    s = dashboard.dash_stats(_log(spark, [])).collect()[0]
    assert (s.total, s.block_rate, s.avg_latency, s.max_latency) == (0, "0", 0, 0)


def test_recent_and_pii(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [(f"i{i}", f"r{i:03d}", "input", "t", None, "allowed", None, None, i, "[]" if i % 2 else ('[{"x":1}]' if i % 3 else None),
             base + dt.timedelta(minutes=i // 2)) for i in range(120)]
    log = _log(spark, rows)
    rec = dashboard.recent_requests(log).collect()
    assert len(rec) == 50 and rec[0].request_id == "r118" and rec[1].request_id == "r119"
    n = dashboard.recent_pii_count(log).collect()[0].pii_rows
    want = sum(1 for r in rec if r.pii_found not in (None, "", "[]"))
    assert n == want


def test_blocked_by_chart(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    log = _log(spark, [("a", "1", "input", "x", None, "blocked", "prompt_injection", None, 1, None, t),
                       ("b", "2", "input", "x", None, "blocked", "topic_relevance", None, 1, None, t),
                       ("c", "3", "input", "x", None, "blocked", None, None, 1, None, t)])
    got = {r.label: r["count"] for r in dashboard.blocked_by_chart(log).collect()}
    assert got == {"Prompt Injection": 1, "Topic Relevance": 1}


def test_dedupe_hot_key_and_append(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(f"id{i}", "hot" if i % 3 else f"k{i}", "input", "x", None, "allowed", None, None, i, None,
             t + dt.timedelta(seconds=1000 - i)) for i in range(300)]
    log = _log(spark, rows)
    d = {r.request_id: r for r in audit.dedupe_requests(log).collect()}
    assert len(d) == 1 + 100
    assert d["hot"].id == "id299"  # the earliest created_at
    path = scratch_path(spark, "test-log")
    audit.append_audit_log(spark, log, path)
    audit.append_audit_log(spark, log, path)  # replay: nothing new
    back = spark.read.parquet(path)
    assert back.count() == 101
    assert audit.clear_log(spark, path).count() == 0


def test_audit_shapes(spark):
    from tollgate.operators.pairs import screen_requests

    df = spark.createDataFrame(
        [("a", "card 4111111111111111", "fine", True), ("b", "plain", "fine", True),
         ("c", "card 4111111111111111", "fine", False), ("d", "jailbreak", "x", False),
         ("e", "plain", "all cats must die", False)],
        "request_id string, input string, response string, dry_run boolean",
    )
    s = screen_requests(df, dry_run="dry_run")
    rows = {r.request_id: r for r in audit.audit_rows(s, "live", dry_run="dry_run").collect()}
    assert (rows["a"].direction, rows["a"].status, rows["a"].blocked_by) == ("input", "modified", "pii")
    assert rows["a"].pii_found is not None
    assert (rows["b"].status, rows["b"].pii_found, rows["b"].reason) == ("allowed", None, None)
    assert (rows["c"].direction, rows["c"].status, rows["c"].output_text) == ("output", "allowed", "fine")
    assert rows["c"].pii_found is not None
    assert (rows["d"].direction, rows["d"].status, rows["d"].blocked_by) == ("input", "blocked", "prompt_injection")
    assert (rows["e"].status, rows["e"].blocked_by, rows["e"].output_text) == ("blocked", "toxicity", None)


def test_request_validation(spark):
    from tollgate.sources.tables import rejected_requests, valid_requests

    df = spark.createDataFrame([("a", "hello"), ("b", ""), ("c", None), ("d", "   ")], "request_id string, input string")
    assert {r.request_id for r in valid_requests(df).collect()} == {"a", "d"}      # whitespace passes
    assert {r.request_id for r in valid_requests(df, strict=True).collect()} == {"a"}
    rej = {r.request_id: r.error for r in rejected_requests(df).collect()}
    assert rej == {"b": "Input text is required.", "c": "Input text is required."}


def test_daily_window_inclusive_and_grains(spark):
    import datetime as dt

    as_of = dt.datetime(2024, 1, 31)
    stamps = [as_of - dt.timedelta(days=7), as_of - dt.timedelta(days=7, microseconds=1),
              as_of - dt.timedelta(days=1), as_of - dt.timedelta(days=1)]
    log = _log(spark, [(f"i{i}", f"r{i}", "input", "x", None, "allowed", None, None, 1, None, ts)
                       for i, ts in enumerate(stamps)])
    day = {r.day: r["count"] for r in dashboard.daily_counts(log, F.lit(as_of)).collect()}
    assert day == {"2024-01-24": 1, "2024-01-30": 2}
    exact = {r.created_at: r["count"] for r in dashboard.daily_counts(log, F.lit(as_of), grain="exact").collect()}
    assert exact == {"2024-01-24 00:00:00.000000": 1, "2024-01-30 00:00:00.000000": 2}


def test_results_are_published_whole_and_in_order(spark, tmp_path):
    path = str(tmp_path / "stats")
    for batch in (7, 8, 9, 10, 0, 1):  # the last two by a query started anew
        screen.overwrite_result(spark.createDataFrame([(batch,)], "n int"), batch, path)
        assert [r["n"] for r in screen.newest_result(spark, path).collect()] == [batch]
    assert len(os.listdir(f"{path}/data")) == screen.KEEP_VERSIONS
    assert len([d for d in os.listdir(f"{path}/commits") if d.startswith("seq=")]) == screen.KEEP_VERSIONS
    # data of a version that is being written, or whose writer was lost, is not on offer
    spark.createDataFrame([(99,)], "n int").write.parquet(f"{path}/data/unfinished")
    assert [r["n"] for r in screen.newest_result(spark, path).collect()] == [1]
