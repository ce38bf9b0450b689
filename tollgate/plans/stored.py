"""Registered queries over tables that Spark writes and reads back (request
files, a written log), and over policies and rows that show every outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, dashboard
from ..operators.pairs import screen_requests
from ..operators.policy import DEFAULT_POLICY, POLICY_TABLE_SCHEMA
from ..operators.policy_history import rules_in_force
from ..operators.suite import expected_vs_actual, suite_results, suite_summary
from ..operators.verdict import screen_input, screen_output
from ..session import scratch_path
from ..sources.seeds import seeded
from ..sources.tables import (
    INPUT_REQUIRED,
    UNREADABLE,
    read_audit_log,
    read_requests,
    read_table,
    rejected_requests,
    request_outcomes,
    valid_requests,
)
from . import oracle_sql as O
from .catalog import (
    _STATS_SQL,
    AS_OF,
    EVENTS_LOG_SQL,
    PAIRS_SQL,
    SCHEMA_POLICY,
    SEEDED_LANG_SQL,
    SEEDED_SQL,
    _screen_pairs_sql,
    _screen_select,
    _verdict_select,
    _verdict_sql,
    conversations,
    docs_lang,
    events_log,
    json_candidates,
    overrides_by_lang,
    pairs,
    register,
    seeded_docs,
)
from .catalog import JSON_SQL as BODY_SQL

# --------------------------------------------------------------------------
# Request files
# --------------------------------------------------------------------------


def request_lines(docs):
    """A line of JSON for each document: with overrides, without, with an
    empty list, with something that is no list, cut off, and with no input."""
    kind = F.col("doc_id") % 6
    named = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("request_id")
    rest = (F.col("text").alias("input"), F.col("lang").isin("en", "de").alias("dry_run"))
    rules = overrides_by_lang()
    line = (
        F.when(kind == 0, F.to_json(F.struct(named, *rest, rules.alias("rules"))))
        .when(kind == 1, F.to_json(F.struct(named, *rest)))
        .when(kind == 2, F.to_json(F.struct(named, *rest, F.lit("all").alias("rules"))))
        .when(kind == 3, F.substring(F.to_json(F.struct(named, *rest)), 1, 45))
        .when(kind == 4, F.to_json(F.struct(named, *rest, F.array().cast(rules_type()).alias("rules"))))
        .otherwise(F.to_json(F.struct(named, F.lit("").alias("input"), rest[1])))
    )
    return docs.select(line.alias("value"))


def rules_type() -> str:
    return "array<struct<type:string,enabled:boolean>>"


def stored_requests(spark, sf):
    """The lines written as files and read as requests."""
    path = scratch_path(spark, "requests")
    request_lines(seeded(docs_lang(spark, sf))).write.text(path)
    return request_outcomes(read_requests(spark, path))


_READ_SQL = f"""SELECT 'doc-' || doc_id::VARCHAR AS request_id,
  CASE WHEN doc_id % 6 IN (2, 3) THEN '{UNREADABLE}' WHEN doc_id % 6 = 5 THEN '{INPUT_REQUIRED}' END AS error,
  CASE WHEN doc_id % 6 = 4 THEN 0 WHEN doc_id % 6 = 0 THEN CASE WHEN lang = 'fr' THEN 1 WHEN lang IN ('de', 'es') THEN 2
       WHEN lang = 'en' THEN NULL ELSE 0 END END::INTEGER AS n_rules,
  CASE WHEN doc_id % 6 NOT IN (2, 3) THEN coalesce(lang IN ('en', 'de'), false) END AS dry_run,
  CASE WHEN doc_id % 6 NOT IN (2, 3) THEN CASE WHEN doc_id % 6 = 5 THEN 0 ELSE length(text) END END::BIGINT AS n_chars
FROM ({SEEDED_LANG_SQL})"""


@register("read_requests", _READ_SQL)
def q_read_requests(spark, sf):
    """Every line comes back, readable or not, with its error."""
    r = stored_requests(spark, sf)
    readable = F.col("error").isNull() | (F.col("error") != UNREADABLE)
    return r.select("request_id", "error",
                    F.when(readable & F.col("rules").isNotNull(), F.size("rules")).cast("int").alias("n_rules"),
                    F.when(readable, F.coalesce("dry_run", F.lit(False))).alias("dry_run"),
                    F.when(readable, F.length("input")).cast("bigint").alias("n_chars"))


_SENT = f"SELECT doc_id, lang, text, doc_id % 6 AS kind FROM ({SEEDED_LANG_SQL}) WHERE doc_id % 6 IN (0, 1, 4)"
_SENT_PII = "(kind <> 0 OR lang IS NULL OR lang NOT IN ('fr', 'es'))"
_SENT_INJ = "(kind <> 0 OR lang IS NULL OR lang <> 'de')"


@register("read_requests_verdict", f"""SELECT 'doc-' || doc_id::VARCHAR AS request_id, input_status, blocked_by, pii_count
FROM ({O.input_verdict_sql(_SENT, 'doc_id', 'text', 'live', None, _SENT_PII, _SENT_INJ)})""")
def q_read_requests_verdict(spark, sf):
    """S1 into V1: the accepted requests of the files under their overrides."""
    s = screen_input(stored_requests(spark, sf).filter("error IS NULL"), "input", overrides="rules")
    return s.select("request_id", "input_status", "blocked_by", F.size("pii").cast("bigint").alias("pii_count"))


_BLANKED_SQL = """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN NULL ELSE text END AS input FROM conversations"""


@register("request_validation", f"""SELECT conv_id, turn, input IS NOT NULL AND length(input) > 0 AS accepted,
  input IS NOT NULL AND length(trim(input)) > 0 AS accepted_strict,
  CASE WHEN input IS NULL OR length(trim(input)) = 0 THEN '{INPUT_REQUIRED}' END AS error FROM ({_BLANKED_SQL})""")
def q_request_validation(spark, sf):
    """P1, P2 over requests of which some are empty, blank or missing: both
    sides of both checks."""
    kind = F.col("turn") % 4
    c = conversations(spark, sf).select("conv_id", "turn", F.when(kind == 0, "").when(kind == 1, "   ")
                                        .when(kind == 2, F.lit(None)).otherwise(F.col("text")).alias("input"))
    loose = valid_requests(c).select("conv_id", "turn", F.lit(True).alias("accepted")).unionByName(
        rejected_requests(c).select("conv_id", "turn", F.lit(False).alias("accepted")))
    strict = valid_requests(c, strict=True).select("conv_id", "turn", F.lit(True).alias("accepted_strict"), F.lit(None).cast("string").alias("error")
                                                   ).unionByName(rejected_requests(c, strict=True).select(
                                                       "conv_id", "turn", F.lit(False).alias("accepted_strict"), "error"))
    return loose.join(strict, ["conv_id", "turn"])


# --------------------------------------------------------------------------
# A written log
# --------------------------------------------------------------------------


def stored_log(spark, sf):
    path = scratch_path(spark, "stored-log")
    audit.write_audit_log(events_log(spark, sf), path, "overwrite")
    return read_audit_log(spark, path)


@register("stored_log_stats", _STATS_SQL)
def q_stored_log_stats(spark, sf):
    """The counters over a log written and read back."""
    return dashboard.dash_stats(stored_log(spark, sf))


@register("stored_log_daily", f"""SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS count FROM ({EVENTS_LOG_SQL})
WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS GROUP BY 1""")
def q_stored_log_daily(spark, sf):
    """S2, A6 over a written log: only the date folders of the window are read."""
    return dashboard.daily_counts(stored_log(spark, sf), F.lit(AS_OF).cast("timestamp"))


@register("stored_log_recent", f"""SELECT request_id, status, input_text, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM ({EVENTS_LOG_SQL}) ORDER BY created_at DESC, request_id LIMIT {dashboard.RECENT_LIMIT}""")
def q_stored_log_recent(spark, sf):
    """S2, T1 over a written log: keys first, texts of the newest rows after."""
    return dashboard.recent_requests(stored_log(spark, sf)).select(
        "request_id", "status", "input_text", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))


# --------------------------------------------------------------------------
# Actions left out, silent warnings
# --------------------------------------------------------------------------

NO_ACTION_POLICY = DEFAULT_POLICY.with_rule("prompt_injection", action=None).with_rule("pii", action=None)


@register("input_verdict_no_action", _verdict_sql(SEEDED_SQL, "library", NO_ACTION_POLICY))
def q_input_verdict_no_action(spark, sf):
    """Rules without an action block injections and mask personal data."""
    return _verdict_select(screen_input(seeded_docs(spark, sf), "text", NO_ACTION_POLICY, "library"))


WARN_POLICY = SCHEMA_POLICY.with_rule("json_schema", action="warn")
_WARN = O.output_verdict_sql("body", "library", WARN_POLICY)
_BLOCK = O.output_verdict_sql("body", "library", SCHEMA_POLICY)


@register("output_verdict_schema_warn", f"""SELECT event_id, {_WARN['output_status']} AS output_status, {_WARN['schema_error']} AS schema_error,
  {_BLOCK['output_status']} AS status_if_blocking, {_BLOCK['schema_error']} AS error_if_blocking FROM ({BODY_SQL})""")
def q_output_verdict_schema_warn(spark, sf):
    """The schema rule set to warn passes what it would block."""
    body = json_candidates(spark, sf)
    quiet = screen_output(body, "body", WARN_POLICY, "library").select("event_id", "body", "output_status", "schema_error")
    loud = screen_output(quiet.withColumnsRenamed({"output_status": "__status", "schema_error": "__error"}), "body", SCHEMA_POLICY, "library")
    return loud.select("event_id", F.col("__status").alias("output_status"), F.col("__error").alias("schema_error"),
                       F.col("output_status").alias("status_if_blocking"), F.col("schema_error").alias("error_if_blocking"))


# --------------------------------------------------------------------------
# The suite over labelled documents with every outcome
# --------------------------------------------------------------------------


def suite_cases(spark, sf):
    """Labelled documents as cases: toxic ones are expected to be blocked,
    poor ones masked, the others to pass."""
    expected = F.when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 0, "modified").otherwise("allowed")
    labels = read_table(spark, sf, "labels", ["doc_id", "quality", "toxic"]).select("doc_id", expected.alias("expected"))
    return seeded_docs(spark, sf).join(labels, "doc_id").select("doc_id", F.col("text").alias("prompt"), "expected")


_CASES_SQL = f"""SELECT s.doc_id, s.text, CASE WHEN l.toxic = 1 THEN 'blocked' WHEN l.quality = 0 THEN 'modified' ELSE 'allowed' END AS expected
FROM ({SEEDED_SQL}) s JOIN labels l ON l.doc_id = s.doc_id"""
_RESULTS_SQL = f"""SELECT doc_id, expected, input_status AS actual, input_status = expected AS passed, pii_count,
  detected AS injection_detected, reason AS details, blocked_by AS log_blocked_by
FROM ({O.input_verdict_sql(_CASES_SQL, 'doc_id', 'text', 'suite')})"""


@register("suite_results", _RESULTS_SQL)
def q_suite_results(spark, sf):
    """Each case with its verdict, PII count, injection flag and details."""
    return suite_results(suite_cases(spark, sf)).select(
        "doc_id", "expected", "actual", "passed", F.col("pii_count").cast("bigint").alias("pii_count"), "injection_detected", "details",
        "log_blocked_by")


@register("suite_summary", f"""SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed,
  {O.to_fixed_1_sql('(count(*) FILTER (WHERE passed))::DOUBLE / count(*)::DOUBLE * 100.0')} AS pass_rate,
  sum(doc_id % 7)::BIGINT AS total_latency_ms FROM ({_RESULTS_SQL})""")
def q_suite_summary(spark, sf):
    """A8 over those results, with supplied latencies."""
    cases = suite_cases(spark, sf).withColumn("took", (F.col("doc_id") % 7).cast("int"))
    return suite_summary(suite_results(cases, latency_ms="took"))


_SEEDED_OV = O.output_verdict_sql("text", "live")


@register("suite_outputs", f"""SELECT s.doc_id, CASE WHEN l.toxic = 1 THEN 'blocked' ELSE 'allowed' END AS expected, s.actual,
  (CASE WHEN l.toxic = 1 THEN 'blocked' ELSE 'allowed' END) = s.actual AS passed
FROM (SELECT doc_id, {_SEEDED_OV['output_status']} AS actual FROM ({SEEDED_SQL})) s JOIN labels l ON l.doc_id = s.doc_id""")
def q_suite_outputs(spark, sf):
    """J4 over outputs of which some are blocked and some allowed."""
    labels = read_table(spark, sf, "labels", ["doc_id", "toxic"]).select(
        "doc_id", F.when(F.col("toxic") == 1, "blocked").otherwise("allowed").alias("expected"))
    actual = screen_output(seeded_docs(spark, sf), "text").select("doc_id", F.col("output_status").alias("actual"))
    return expected_vs_actual(labels, actual, "doc_id").select("doc_id", "expected", "actual", "passed")


# --------------------------------------------------------------------------
# End to end, library profile, every outcome (V3)
# --------------------------------------------------------------------------

_LIB = O.input_verdict_sql(PAIRS_SQL, "request_id", "input", "library")
_LIB_OV = O.output_verdict_sql("response", "library")


@register("screen_pairs_library", _screen_pairs_sql(_LIB, _LIB_OV))
def q_screen_pairs_library(spark, sf):
    """V3, library profile under the default policy: allowed, masked and
    blocked inputs, allowed and blocked outputs."""
    return _screen_select(screen_requests(pairs(spark, sf), "input", "response", DEFAULT_POLICY, "library"))


# --------------------------------------------------------------------------
# Policies in force by time
# --------------------------------------------------------------------------

_MASK, _BLOCK_PII, _OFF, _ON, _END = "2024-01-02 00:00:00", "2024-01-08 12:00:00", "2024-01-10 06:00:00", "2024-01-15 00:00:00", "2024-01-18 03:00:00"
STORED_RULES = [
    ("r1", "pii", True, '{"action": "mask"}', _MASK),
    ("r2", "pii", True, '{"action": "block"}', _BLOCK_PII),
    ("r3", "pii", True, '{"action": "mask"}', _BLOCK_PII),  # begins at once with r2, which counts
    ("r4", "prompt_injection", False, "not JSON", _OFF),
    ("r5", "prompt_injection", True, '{"action": "block"}', _ON),
    ("r6", "pii", None, None, _END),
    ("r7", "unknown", True, "{}", _MASK),
]


def stored_rules(spark):
    rows = [(i, i, "input", t, on, config, since) for i, t, on, config, since in STORED_RULES]
    table = spark.createDataFrame(rows, "id string, name string, category string, type string, enabled boolean, config string, since string")
    table = table.withColumn("created_at", F.col("since").cast("timestamp")).withColumn("updated_at", F.col("created_at")).drop("since")
    return table.to(spark.createDataFrame([], POLICY_TABLE_SCHEMA).schema)


_ASKED_SQL = f"""SELECT doc_id, lang, text, TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id % 20)::INTEGER)
  + to_hours((doc_id // 20 % 24)::INTEGER) AS asked FROM ({SEEDED_LANG_SQL})"""
_FORCE_PII = f"(asked < TIMESTAMP '{_END}')"
_FORCE_INJ = f"NOT (asked >= TIMESTAMP '{_OFF}' AND asked < TIMESTAMP '{_ON}')"


def _in_force_sql(profile: str) -> str:
    blocking = DEFAULT_POLICY.with_rule("pii", action="block")
    return " UNION ALL ".join(
        f"SELECT doc_id, input_status, blocked_by, reason FROM ({sql})" for sql in (
            O.input_verdict_sql(f"SELECT * FROM ({_ASKED_SQL}) WHERE asked < TIMESTAMP '{_BLOCK_PII}'", "doc_id", "text", profile,
                                None, _FORCE_PII, _FORCE_INJ),
            O.input_verdict_sql(f"SELECT * FROM ({_ASKED_SQL}) WHERE asked >= TIMESTAMP '{_BLOCK_PII}'", "doc_id", "text", profile,
                                blocking, _FORCE_PII, _FORCE_INJ)))


def _screened_in_force(spark, sf, profile):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(
        (F.col("doc_id") % 20).cast("int"), (F.floor(F.col("doc_id") / 20) % 24).cast("int"))
    asked = seeded(docs_lang(spark, sf)).withColumn("asked", at)
    ruled = rules_in_force(asked, stored_rules(spark), "asked")
    s = screen_input(ruled, "text", profile=profile, overrides="rules_in_force", actions="rules_in_force")
    return s.select("doc_id", "input_status", "blocked_by", "reason")


@register("policy_in_force", _in_force_sql("live"))
def q_policy_in_force(spark, sf):
    """Each document under the stored rules in force at its time."""
    return _screened_in_force(spark, sf, "live")


@register("policy_in_force_library", _in_force_sql("library"))
def q_policy_in_force_library(spark, sf):
    """S4, library profile: disabled rules are not run."""
    return _screened_in_force(spark, sf, "library")


# --------------------------------------------------------------------------
# Streams in several batches
# --------------------------------------------------------------------------

_CAME_SQL = f"SELECT *, request_id::BIGINT % 10 = 3 AS held, date_trunc('day', created_at) AS day FROM ({EVENTS_LOG_SQL})"


@register("stream_daily_closed", f"""WITH came AS ({_CAME_SQL}), floors AS (
  SELECT max(created_at) FILTER (WHERE NOT held) - INTERVAL 1 HOUR AS floor, max(created_at) - INTERVAL 1 HOUR AS all_floor FROM came),
  judged AS (SELECT day, held AND day + INTERVAL 1 DAY <= floor AS late, created_at FROM came, floors),
  final AS (SELECT max(created_at) FILTER (WHERE NOT late) - INTERVAL 1 HOUR AS f FROM judged)
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (WHERE NOT late) AS count, count(*) FILTER (WHERE late) AS late,
  day + INTERVAL 1 DAY <= any_value(f) AS closed FROM judged, final GROUP BY judged.day""")
def q_stream_daily_closed(spark, sf):
    """A tenth of the log comes after the rest; its rows of days that have
    closed are set aside."""
    from ..streaming.screen import stream_daily_closed

    log, held = events_log(spark, sf), F.col("request_id").cast("long") % 10 == 3
    early = F.col("created_at") < F.lit("2024-01-12 09:00:00").cast("timestamp")
    return stream_daily_closed(spark, [log.filter(~held & early), log.filter(~held & ~early), log.filter(held)])


@register("stream_dedup_expiry", f"""SELECT request_id, id FROM ({EVENTS_LOG_SQL})
UNION ALL SELECT request_id, id || '-months-later' AS id FROM ({EVENTS_LOG_SQL})""")
def q_stream_dedup_expiry(spark, sf):
    """Each request comes again after a minute, which is dropped, and
    again after months, when its id has expired. Two rows in between tell the
    stream that time has passed."""
    from ..streaming.screen import stream_dedup_expiry

    log = events_log(spark, sf).select("request_id", "id", "created_at")

    def again(interval, suffix):
        return log.select("request_id", F.concat("id", F.lit(suffix)).alias("id"), (F.col("created_at") + F.expr(interval)).alias("created_at"))

    def clock(days):
        return log.agg((F.max("created_at") + F.expr(f"INTERVAL {days} DAYS")).alias("created_at")).select(
            F.lit(f"clock-{days}").alias("request_id"), F.lit(None).cast("string").alias("id"), "created_at")

    steps = [log, again("INTERVAL 1 MINUTE", "-again"), clock(1), clock(2), again("INTERVAL 400 DAYS", "-months-later")]
    return stream_dedup_expiry(spark, steps).filter("id IS NOT NULL")
