"""Registered queries against their DuckDB oracles on the smallest tables,
plus the driver entry points."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

FAST = [
    "pii_spans", "pii_mask", "pii_json", "inj_result", "toxicity", "json_required", "input_verdict",
    "input_verdict_suite", "policy_override", "output_verdict_library", "screen_conversations",
    "audit_log_rows", "dash_stats", "daily_counts", "recent_requests", "audit_log_dedup", "stream_stats", "stream_conversations", "stream_audit",
    "response_json_docs", "suite_labels", "read_requests", "read_requests_verdict", "request_validation", "stored_log_stats",
    "stored_log_daily", "stored_log_recent", "input_verdict_no_action", "output_verdict_schema_warn", "suite_results", "suite_summary",
    "suite_outputs", "screen_pairs_library", "policy_in_force", "policy_in_force_library",
    "stream_daily_closed", "stream_dedup_expiry",
]

#: Queries that show each outcome at least once, at any size of the tables.
OUTCOMES = {
    "read_requests": ("error", {None, "Request could not be read.", "Input text is required."}),
    "request_validation": ("accepted_strict", {True, False}),
    "policy_in_force": ("blocked_by", {None, "pii", "prompt_injection"}),
    "stream_daily_closed": ("closed", {True, False}),
    "suite_results": ("actual", {"allowed", "modified", "blocked"}),
    "suite_outputs": ("actual", {"allowed", "blocked"}),
    "screen_pairs_library": ("response_status", {"allowed", "blocked_input", "blocked_output"}),
    "input_verdict_no_action": ("input_status", {"allowed", "modified", "blocked"}),
    "output_verdict_schema_warn": ("status_if_blocking", {"allowed", "blocked"}),
}


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def n(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return None if v is None else str(v)
    return sorted((tuple(n(r[i]) for i in order) for r in rows), key=lambda t: tuple("" if x is None else x for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["events", "documents", "pages", "conversations", "benchmark", "labels"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(rel.fetchall(), rel.columns)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["lang", "input_status", "blocked_by", "rows"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    own = set(E.queries()) - set(E.LLM_QUERIES)
    assert own == set(E.oracle_sql()) - set(E.LLM_SQL)


@pytest.mark.parametrize("missing", ["tollgate.llm", "tokenizers", "corpus_pipeline"])
def test_entry_survives_what_cannot_be_imported(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as E; "
            "from tollgate.plans.catalog import QUERIES; q = E.queries(); assert set(QUERIES) <= set(q); assert 'pipeline' not in q; "
            "assert set(E.oracle_sql()) <= set(q)")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


@pytest.mark.parametrize("name", list(OUTCOMES))
def test_every_outcome_occurs(spark, name):
    column, outcomes = OUTCOMES[name]
    got = {r[column] for r in E.queries()[name](spark, SF_SMALL).select(column).distinct().collect()}
    assert got == outcomes


def test_a_silent_warning_passes_what_blocking_stops(spark):
    rows = E.queries()["output_verdict_schema_warn"](spark, SF_SMALL).collect()
    assert all(r["output_status"] == "allowed" or r["status_if_blocking"] == "blocked" for r in rows)
    assert any(r["output_status"] == "allowed" and r["status_if_blocking"] == "blocked" and r["schema_error"] is None for r in rows)
