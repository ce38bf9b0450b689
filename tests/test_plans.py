"""Plan shapes that the scale design relies on."""

from pyspark.sql import functions as F

from tollgate.functions import pii as piif
from tollgate.functions.rules import PII_PATTERNS
from tollgate.operators.audit import dedupe_requests, write_audit_log
from tollgate.operators.dashboard import recent_requests
from tollgate.operators.pairs import conversation_pairs
from tollgate.operators.verdict import screen_input
from tollgate.sources.tables import audit_log_from_events, read_audit_log


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_regex_once_even_under_filters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    s = screen_input(docs, "text")
    q = s.filter(F.col("input_status") == "blocked").select("doc_id", F.explode("pii").alias("p"))
    plan = _optimized(q)
    assert plan.count("regexp_extract_all") == len(PII_PATTERNS)
    # the filter stops at the fenced detection columns
    assert "Filter" in plan


def test_explode_inferred_filter_not_pushed_to_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    long = piif.pii_long(piif.with_pii(docs, "text", "pii"), ["doc_id"])
    plan = _optimized(long)
    assert plan.count("regexp_extract_all") == len(PII_PATTERNS)
    scan_line = [l for l in plan.split("\n") if "Relation" in l][0]
    assert "regexp" not in scan_line


def test_pairing_splits_long_conversations(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
        plan = _physical(conversation_pairs(conv, "left"))
        # turns are dealt by turn or by bucket; only one row per bucket is
        # dealt by conversation alone
        part = [l for l in plan.split("\n") if "hashpartitioning" in l]
        alone = [l for l in part if "turn" not in l and "_b" not in l]
        assert part and len(alone) <= 1
        assert "partial_min" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_dedupe_aggregates_before_the_shuffle(spark):
    plan = _physical(dedupe_requests(audit_log_from_events(spark, "/root/testdata/sf0.001")))
    assert "partial_min" in plan
    ex = plan.index("Exchange hashpartitioning(request_id")
    assert plan.index("partial_min") > ex  # printed below the exchange = runs before it


def test_dashboard_scan_is_pruned(spark):
    from tollgate.operators.dashboard import dash_stats

    plan = _physical(dash_stats(audit_log_from_events(spark, "/root/testdata/sf0.001")))
    scan = [l for l in plan.split("\n") if "FileScan parquet" in l][0]
    assert "props" not in scan and "event_id" not in scan


def test_spread_is_off_unless_asked(spark):
    from tollgate.sources.tables import spread

    one = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "RoundRobinPartitioning" not in _physical(spread(one))
    assert "RoundRobinPartitioning" in _physical(spread(one, 8))


def test_json_text_is_parsed_twice_at_most(spark):
    import __spark_entry__ as E

    for name in ("json_valid", "json_required", "screen_pairs", "output_verdict_library"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.lower().count("parsejson") <= 2, name


def test_recent_feed_finds_keys_before_texts(spark, tmp_path):
    path = str(tmp_path / "log")
    write_audit_log(audit_log_from_events(spark, "/root/testdata/sf0.001"), path, "overwrite")
    df = recent_requests(read_audit_log(spark, path))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    schemas = [l for l in plan.split("\n") if l.startswith("ReadSchema")]
    assert sum("input_text" in s for s in schemas) == 1 and sum("_text" not in s for s in schemas) >= 1
    assert [l for l in plan.split("\n") if l.startswith("PartitionFilters") and "Subquery" in l]
    whole = read_audit_log(spark, path).orderBy(F.col("created_at").desc(), "request_id").limit(50)
    assert [r["request_id"] for r in df.collect()] == [r["request_id"] for r in whole.collect()]


def test_written_log_has_files_by_size_not_by_task(spark, tmp_path):
    log = audit_log_from_events(spark, "/root/testdata/sf0.01").repartition(40)
    write_audit_log(log, str(tmp_path / "log"), "overwrite")
    written = read_audit_log(spark, str(tmp_path / "log"))
    days = written.select("created_date").distinct().count()
    assert len(written.inputFiles()) <= 2 * days and written.count() == log.count()
