"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB
oracle per operator of the inventory.

Every query reads the driver tables (or rows Spark derives from them) in
full; nothing is sampled, capped or filtered by id. Columns are flat scalars
named the same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import injection as inj
from ..functions import output as outf
from ..functions import pii as piif
from ..functions.dialect import sql_string
from ..functions.rules import (
    INJECTION_RULES,
    PII_PATTERNS,
    TOXICITY_RULES,
    custom_injection_rule,
    custom_pii_pattern,
)
from ..operators import audit, dashboard
from ..operators.pairs import conversation_pairs, keyword_route, recorded_requests, response_join, screen_requests
from ..operators.policy import DEFAULT_POLICY
from ..operators.verdict import display_status, screen_input, screen_output
from ..sources.seeds import SEED_PHRASES, seeded, seeded_sql, seeded_text
from ..sources.tables import audit_log_from_events, read_audit_log, read_table, spread, valid_requests
from . import oracle_sql as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Session setting: parts to spread a small table into (unset: as scanned).
SPREAD_CONF = "spark.tollgate.spread"


def balanced(spark, df):
    parts = spark.conf.get(SPREAD_CONF, None)
    return spread(df, int(parts) if parts else None)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


q = sql_string

# --------------------------------------------------------------------------
# Sources
# --------------------------------------------------------------------------


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return balanced(spark, read_table(spark, sf, "documents", ["doc_id", "text"]))


def docs_lang(spark: SparkSession, sf: str) -> DataFrame:
    return balanced(spark, read_table(spark, sf, "documents", ["doc_id", "lang", "text"]))


def seeded_docs(spark: SparkSession, sf: str) -> DataFrame:
    return seeded(docs(spark, sf))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return balanced(spark, read_table(spark, sf, "pages", ["page_id", "html"]))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return balanced(spark, read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"]))


DOCS_SQL = "SELECT doc_id, text FROM documents"
DOCS_LANG_SQL = "SELECT doc_id, lang, text FROM documents"
SEEDED_SQL = seeded_sql("documents", "doc_id", "text", "doc_id")
PAGES_SQL = "SELECT page_id, html FROM pages"
RAW_PAIRS_SQL = """SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS request_id,
  input, coalesce(response, '') AS response, response IS NOT NULL AS has_response
FROM (SELECT conv_id, turn, role, text AS input,
        CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS response
      FROM (SELECT conv_id, turn, role, text FROM conversations
            QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) = 1)
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user'"""
# Every user turn and every answer with a phrase of its own appended, so that
# screening meets each kind of input and output.
_PHRASES = "[" + ", ".join(sql_string(p) for p in SEED_PHRASES) + "]"
PAIRS_SQL = f"""SELECT * REPLACE (input || ' ' || ({_PHRASES})[((conv_id * 7 + turn) % {len(SEED_PHRASES)}) + 1] AS input,
  CASE WHEN has_response THEN response || ' ' || ({_PHRASES})[((conv_id * 11 + turn * 5 + 16) % {len(SEED_PHRASES)}) + 1]
       ELSE response END AS response)
FROM ({RAW_PAIRS_SQL})"""

# --------------------------------------------------------------------------
# PII (D1-D15, J5, U1)
# --------------------------------------------------------------------------

_BY_TYPE = {p.type: p for p in PII_PATTERNS}


def _spans_query(src_fn, pats, key="doc_id", text="text"):
    def run(spark, sf):
        df = piif.with_pii(src_fn(spark, sf).select(key, text), text, "pii", pats)
        return piif.pii_long(df, [key], "pii")

    return run


for _t, _qname, _src, _ssql in [
    ("credit_card", "pii_credit_card", docs, DOCS_SQL),
    ("email", "pii_email", docs, DOCS_SQL),
    ("phone", "pii_phone", docs, DOCS_SQL),
    ("bitcoin", "pii_bitcoin", docs, DOCS_SQL),
    ("ip_address", "pii_ip", docs, DOCS_SQL),
    ("ssn", "pii_ssn", seeded_docs, SEEDED_SQL),
    ("api_key", "pii_api_key", seeded_docs, SEEDED_SQL),
    ("aws_key", "pii_aws_key", seeded_docs, SEEDED_SQL),
]:
    register(_qname, O.spans_sql(_ssql, "doc_id", "text", [_BY_TYPE[_t]]))(
        _spans_query(_src, [_BY_TYPE[_t]])
    )

register("pii_spans", O.spans_sql(SEEDED_SQL, "doc_id", "text"))(_spans_query(seeded_docs, PII_PATTERNS))
register("pii_pages", O.spans_sql(PAGES_SQL, "page_id", "html"))(
    _spans_query(pages, PII_PATTERNS, "page_id", "html")
)

# An extra detector appended to the shipped list.
# The second takes in the space around a number (trimmed after) and bears the
# type with a digit floor, so short numbers drop out.
CUSTOM_PII = [
    custom_pii_pattern("url", "URL", r"\bhttps?://[A-Za-z0-9./?=&#%_-]+"),
    custom_pii_pattern("phone", "Spaced Number", r"\s\d[\d ]*\s"),
]
register("pii_custom", O.spans_sql(SEEDED_SQL, "doc_id", "text", list(PII_PATTERNS) + CUSTOM_PII))(
    _spans_query(seeded_docs, list(PII_PATTERNS) + CUSTOM_PII)
)


@register("pii_mask", O.mask_sql(SEEDED_SQL, "doc_id", "text"))
def q_pii_mask(spark, sf):
    df = piif.with_pii(seeded_docs(spark, sf), "text", "pii", parts="__parts")
    return piif.with_mask(df, "text", "pii", "__parts", "masked").select("doc_id", "masked")


@register(
    "pii_json",
    f"""WITH src AS ({SEEDED_SQL}), sp AS ({O.spans_sql(SEEDED_SQL, 'doc_id', 'text')}),
    j AS (SELECT doc_id, to_json(list({{'type': type, 'label': label, 'value': value, 'start': start::INTEGER,
                 'end': "end"::INTEGER}} ORDER BY pos))::VARCHAR AS pii_found FROM sp GROUP BY doc_id)
    SELECT src.doc_id, j.pii_found FROM src LEFT JOIN j ON src.doc_id = j.doc_id""",
)
def q_pii_json(spark, sf):
    df = piif.with_pii(seeded_docs(spark, sf), "text", "pii")
    return df.select("doc_id", piif.pii_json(F.col("pii")).alias("pii_found"))


@register(
    "pii_counts",
    f"""WITH src AS ({DOCS_SQL}), sp AS ({O.spans_sql(DOCS_SQL, 'doc_id', 'text')})
    SELECT src.doc_id, (SELECT count(*) FROM sp WHERE sp.doc_id = src.doc_id)::BIGINT AS pii_count FROM src""",
)
def q_pii_counts(spark, sf):
    df = piif.with_pii(docs(spark, sf), "text", "pii")
    return df.select("doc_id", piif.pii_count(F.col("pii")).cast("bigint").alias("pii_count"))


@register(
    "pii_reason",
    f"""WITH sp AS ({O.spans_sql(SEEDED_SQL, 'doc_id', 'text')})
    SELECT doc_id, 'PII detected: ' || string_agg(label, ', ' ORDER BY pos) AS reason FROM sp GROUP BY doc_id""",
)
def q_pii_reason(spark, sf):
    df = piif.with_pii(seeded_docs(spark, sf), "text", "pii")
    return df.filter(F.size("pii") > 0).select("doc_id", piif.pii_reason(F.col("pii")).alias("reason"))


# --------------------------------------------------------------------------
# Injection
# --------------------------------------------------------------------------

_INJ_NAMES = [
    "inj_ignore", "inj_override", "inj_forget", "inj_leak", "inj_template",
    "inj_delimiter", "inj_jailbreak", "inj_encoding", "inj_multi_turn", "inj_indirect",
]


def _inj_rule_query(idx: int, src_fn):
    def run(spark, sf):
        df = src_fn(spark, sf)
        return df.select("doc_id", inj.rule_hit(F.col("text"), INJECTION_RULES[idx]).alias("hit"))

    return run


for _i, _name in enumerate(_INJ_NAMES):
    _natural = _name == "inj_jailbreak"
    _ssql = DOCS_SQL if _natural else SEEDED_SQL
    register(
        _name,
        f"SELECT doc_id, coalesce({O.rule_hit_sql('text', INJECTION_RULES[_i])}, false) AS hit FROM ({_ssql})",
    )(_inj_rule_query(_i, docs if _natural else seeded_docs))

_IF = O.inj_fields_sql("hits")
INJ_RESULT_SQL = f"""SELECT doc_id, {_IF['detected']} AS detected, {_IF['confidence']} AS confidence,
  {_IF['type']} AS type, {_IF['reason']} AS reason
FROM (SELECT doc_id, {O.inj_hits_sql('text')} AS hits FROM ({SEEDED_SQL}))"""


@register("inj_result", INJ_RESULT_SQL)
def q_inj_result(spark, sf):
    df = inj.with_injection(seeded_docs(spark, sf), "text", "injection")
    return df.select("doc_id", "injection.detected", "injection.confidence", "injection.type", "injection.reason")


@register(
    "inj_display",
    f"""SELECT doc_id, floor(confidence * 100 + 0.5)::INTEGER AS confidence_pct, replace(type, '_', ' ') AS type_label
    FROM ({INJ_RESULT_SQL}) WHERE detected""",
)
def q_inj_display(spark, sf):
    df = inj.with_injection(seeded_docs(spark, sf), "text", "injection")
    return df.filter("injection.detected").select(
        "doc_id",
        inj.confidence_percent(F.col("injection.confidence")).alias("confidence_pct"),
        inj.type_label(F.col("injection.type")).alias("type_label"),
    )


@register(
    "inj_long",
    f"""SELECT doc_id, (g.i - 1)::BIGINT AS pos, g.h.type AS type, g.h.reason AS reason FROM (
      SELECT doc_id, unnest(list_transform(hits, lambda h, i: {{'h': h, 'i': i}})) AS g
      FROM (SELECT doc_id, {O.inj_hits_sql('text')} AS hits FROM ({SEEDED_SQL})))""",
)
def q_inj_long(spark, sf):
    df = inj.with_injection(seeded_docs(spark, sf), "text", "injection")
    return df.select("doc_id", F.posexplode("injection_hits").alias("pos", "h")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("h.type").alias("type"), F.col("h.reason").alias("reason")
    )


@register(
    "inj_type_counts",
    f"""SELECT doc_id, len(list_distinct(list_transform(hits, lambda h: h.type)))::BIGINT AS n_types
    FROM (SELECT doc_id, {O.inj_hits_sql('text')} AS hits FROM ({SEEDED_SQL}))""",
)
def q_inj_type_counts(spark, sf):
    df = inj.with_injection(seeded_docs(spark, sf), "text", "injection")
    return df.select("doc_id", inj.distinct_type_count(F.col("injection_hits")).cast("bigint").alias("n_types"))


CUSTOM_INJ = [custom_injection_rule("markup_injection", r"<script\b", "Script markup in input")]
_CIF = O.inj_fields_sql("hits")


@register(
    "inj_custom",
    f"""SELECT page_id, {_CIF['detected']} AS detected, {_CIF['confidence']} AS confidence, {_CIF['type']} AS type
    FROM (SELECT page_id, {O.inj_hits_sql('html', list(INJECTION_RULES) + CUSTOM_INJ)} AS hits FROM pages)""",
)
def q_inj_custom(spark, sf):
    df = inj.with_injection(pages(spark, sf), "html", "injection", list(INJECTION_RULES) + CUSTOM_INJ)
    return df.select("page_id", "injection.detected", "injection.confidence", "injection.type")


# --------------------------------------------------------------------------
# Output screening
# --------------------------------------------------------------------------


@register("toxicity", f"SELECT doc_id, {O.toxicity_sql('text')} AS reason FROM ({SEEDED_SQL})")
def q_toxicity(spark, sf):
    return seeded_docs(spark, sf).select("doc_id", outf.toxicity_reason(F.col("text")).alias("reason"))


for _i, _name in enumerate(["tox_violence", "tox_harmful", "tox_hate", "tox_genocide"]):
    register(
        _name,
        f"SELECT doc_id, regexp_matches(text, {q(outf.toxicity_re2(TOXICITY_RULES[_i]))}) AS hit FROM ({SEEDED_SQL})",
    )(
        (lambda i: (lambda spark, sf: seeded_docs(spark, sf).select("doc_id", outf.toxicity_rule_hit(F.col("text"), i).alias("hit"))))(_i)
    )


@register("topic_relevance", f"SELECT doc_id, {O.topic_sql('text', DEFAULT_POLICY.blocked_topics)} AS reason FROM ({SEEDED_SQL})")
def q_topic(spark, sf):
    return seeded_docs(spark, sf).select("doc_id", outf.topic_reason(F.col("text")).alias("reason"))


CUSTOM_TOPICS = ["refund", "shipping cost", "jail.?break", "step \\d"]


@register("topic_custom", f"SELECT doc_id, {O.topic_sql('text', CUSTOM_TOPICS)} AS reason FROM ({SEEDED_SQL})")
def q_topic_custom(spark, sf):
    return seeded_docs(spark, sf).select("doc_id", outf.topic_reason(F.col("text"), CUSTOM_TOPICS).alias("reason"))


# JSON candidates derived from every event row, each holding its whole props
# object: as is, with trailing text, as one of two required fields, quoted as
# a scalar, beside a null field, as an array, as the second of both required
# fields, and after a bare word.
JSON_FIELDS = ["k", "v"]
_JSON_K = 8


def json_candidates(spark, sf):
    ev = balanced(spark, read_table(spark, sf, "events", ["event_id", "user_id", "event_type", "props"]))
    k = F.col("event_id") % _JSON_K
    quoted = F.replace(F.replace("props", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    text = (
        F.when(k == 0, F.col("props"))
        .when(k == 1, F.concat(F.col("props"), F.lit(" trailing")))
        .when(k == 2, F.concat(F.lit('{"k": '), F.col("props"), F.lit("}")))
        .when(k == 3, F.concat(F.lit('"'), quoted, F.lit('"')))
        .when(k == 4, F.concat(F.lit('{"k": null, "v": '), F.col("props"), F.lit("}")))
        .when(k == 5, F.concat(F.lit("["), F.col("props"), F.lit("]")))
        .when(k == 6, F.concat(F.lit('{"k": '), F.col("user_id").cast("string"), F.lit(', "v": '), F.col("props"), F.lit("}")))
        .otherwise(F.concat("event_type", F.lit(" "), "props"))
    )
    return ev.select("event_id", text.alias("body"))


JSON_SQL = f"""SELECT event_id, CASE event_id % {_JSON_K}
  WHEN 0 THEN props WHEN 1 THEN props || ' trailing' WHEN 2 THEN '{{"k": ' || props || '}}'
  WHEN 3 THEN '"' || replace(replace(props, '\\', '\\\\'), '"', '\\"') || '"'
  WHEN 4 THEN '{{"k": null, "v": ' || props || '}}' WHEN 5 THEN '[' || props || ']'
  WHEN 6 THEN '{{"k": ' || CAST(user_id AS VARCHAR) || ', "v": ' || props || '}}'
  ELSE event_type || ' ' || props END AS body FROM events"""


@register(
    "json_valid",
    f"SELECT event_id, {O.json_reason_sql('body', [])} IS NULL AS passed, {O.json_reason_sql('body', [])} AS reason FROM ({JSON_SQL})",
)
def q_json_valid(spark, sf):
    checked = json_candidates(spark, sf).select("event_id", piif.fence(outf.json_validate(F.col("body"))).alias("v"))
    return checked.select("event_id", "v.passed", "v.reason")


@register(
    "json_required",
    f"SELECT event_id, {O.json_reason_sql('body', JSON_FIELDS)} IS NULL AS passed, {O.json_reason_sql('body', JSON_FIELDS)} AS reason FROM ({JSON_SQL})",
)
def q_json_required(spark, sf):
    checked = json_candidates(spark, sf).select("event_id", piif.fence(outf.json_validate(F.col("body"), JSON_FIELDS)).alias("v"))
    return checked.select("event_id", "v.passed", "v.reason")


# --------------------------------------------------------------------------
# Verdicts (V1, V2), policy (R1), routing (V4)
# --------------------------------------------------------------------------

_VERDICT_COLS = ["doc_id", "input_status", "blocked_by", "reason", "pii_count", "detected", "confidence", "inj_type"]


def _verdict_select(df):
    return df.select(
        "doc_id", "input_status", "blocked_by", "reason",
        F.size("pii").cast("bigint").alias("pii_count"),
        F.col("injection.detected").alias("detected"),
        F.col("injection.confidence").alias("confidence"),
        F.col("injection.type").alias("inj_type"),
    )


def _verdict_sql(src, profile, policy=None, pii_on="true", inj_on="true"):
    return f"SELECT {', '.join(_VERDICT_COLS)} FROM ({O.input_verdict_sql(src, 'doc_id', 'text', profile, policy, pii_on, inj_on)})"


@register("input_verdict", _verdict_sql(SEEDED_SQL, "live"))
def q_input_verdict(spark, sf):
    return _verdict_select(screen_input(seeded_docs(spark, sf), "text"))


# Library profile under a policy whose injection action is "warn": such rows
# fall through to the PII step, which only the library honours.
LIBRARY_POLICY = DEFAULT_POLICY.with_rule("prompt_injection", action="warn")


@register("input_verdict_library", _verdict_sql(SEEDED_SQL, "library", LIBRARY_POLICY))
def q_input_verdict_library(spark, sf):
    return _verdict_select(screen_input(seeded_docs(spark, sf), "text", LIBRARY_POLICY, "library"))


@register("input_verdict_suite", _verdict_sql(SEEDED_SQL, "suite"))
def q_input_verdict_suite(spark, sf):
    return _verdict_select(screen_input(seeded_docs(spark, sf), "text", profile="suite"))


PII_BLOCK_POLICY = DEFAULT_POLICY.with_rule("pii", action="block")


@register("input_verdict_pii_block", _verdict_sql(SEEDED_SQL, "live", PII_BLOCK_POLICY))
def q_input_verdict_pii_block(spark, sf):
    return _verdict_select(screen_input(seeded_docs(spark, sf), "text", PII_BLOCK_POLICY))


def overrides_by_lang() -> F.Column:
    """Per-row rule overrides derived from the document language: French
    turns PII off, German turns injection off (and repeats PII on), Spanish
    sends a PII override without ``enabled`` followed by one with it (the
    first wins and disables); other rows carry an empty list."""
    ov = "array<struct<type:string,enabled:boolean>>"

    def o(t, e):
        return F.struct(F.lit(t).alias("type"), F.lit(e).cast("boolean").alias("enabled"))

    lang = F.col("lang")
    return (
        F.when(lang == "fr", F.array(o("pii", False)))
        .when(lang == "de", F.array(o("prompt_injection", False), o("pii", True)))
        .when(lang == "es", F.array(o("pii", None), o("pii", True)))
        .when(lang == "en", F.lit(None).cast(ov))
        .otherwise(F.array().cast(ov))
        .cast(ov)
    )


SEEDED_LANG_SQL = seeded_sql("documents", "doc_id", "text", "doc_id, lang")
_PII_ON = "(lang IS NULL OR lang NOT IN ('fr', 'es'))"
_INJ_ON = "(lang IS NULL OR lang <> 'de')"


@register("policy_override", _verdict_sql(SEEDED_LANG_SQL, "live", None, _PII_ON, _INJ_ON))
def q_policy_override(spark, sf):
    df = seeded(docs_lang(spark, sf)).withColumn("rules", overrides_by_lang())
    return _verdict_select(screen_input(df, "text", overrides="rules"))


@register("policy_override_library", _verdict_sql(SEEDED_LANG_SQL, "library", None, _PII_ON, _INJ_ON))
def q_policy_override_library(spark, sf):
    df = seeded(docs_lang(spark, sf)).withColumn("rules", overrides_by_lang())
    return _verdict_select(screen_input(df, "text", profile="library", overrides="rules"))


@register(
    "keyword_route",
    f"""SELECT doc_id, {O.route_sql('processed_input')} AS intent
    FROM ({O.input_verdict_sql(SEEDED_SQL, 'doc_id', 'text', 'live')})""",
)
def q_keyword_route(spark, sf):
    s = screen_input(seeded_docs(spark, sf), "text")
    return s.select("doc_id", keyword_route(F.col("processed_input")).alias("intent"))


_OV = O.output_verdict_sql("text", "live")


@register(
    "output_verdict",
    f"SELECT doc_id, {_OV['output_status']} AS output_status, {_OV['output_blocked_by']} AS output_blocked_by, "
    f"{_OV['output_reason']} AS output_reason FROM ({SEEDED_SQL})",
)
def q_output_verdict(spark, sf):
    s = screen_output(seeded_docs(spark, sf), "text")
    return s.select("doc_id", "output_status", "output_blocked_by", "output_reason")


# Library output profile with the JSON-schema rule switched on, enforced and
# blocking, requiring fields "k" and "v".
SCHEMA_POLICY = DEFAULT_POLICY.with_rule(
    "json_schema", enabled=True, action="block", config={"enforce": True, "fields": JSON_FIELDS}
)
_OVL = O.output_verdict_sql("body", "library", SCHEMA_POLICY)


@register(
    "output_verdict_library",
    "SELECT event_id, " + ", ".join(f"{v} AS {k}" for k, v in _OVL.items()) + f" FROM ({JSON_SQL})",
)
def q_output_verdict_library(spark, sf):
    s = screen_output(json_candidates(spark, sf), "body", SCHEMA_POLICY, "library")
    return s.select("event_id", "output_status", "output_blocked_by", "output_reason", "toxicity", "topic_violation", "schema_error")


@register(
    "output_verdict_library_text",
    "SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in O.output_verdict_sql("text", "library", SCHEMA_POLICY).items())
    + f" FROM ({SEEDED_SQL})",
)
def q_output_verdict_library_text(spark, sf):
    s = screen_output(seeded_docs(spark, sf), "text", SCHEMA_POLICY, "library")
    return s.select("doc_id", "output_status", "output_blocked_by", "output_reason", "toxicity", "topic_violation", "schema_error")


# --------------------------------------------------------------------------
# Requests, pairs, end to end
# --------------------------------------------------------------------------


def requests_from_docs(spark, sf):
    """S1 over the driver tables: each seeded document is a request; dry runs
    and overrides derive from the language."""
    d = seeded(docs_lang(spark, sf))
    return d.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("request_id"),
        "doc_id", "lang",
        F.col("text").alias("input"),
        F.col("lang").isin("en", "de").alias("dry_run"),
        overrides_by_lang().alias("rules"),
    )


REQ_SQL = f"""SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS request_id, doc_id, lang, text AS input,
  coalesce(lang IN ('en', 'de'), false) AS dry_run FROM ({SEEDED_LANG_SQL})"""


@register(
    "scan_requests",
    f"""SELECT request_id, dry_run, CASE WHEN lang = 'en' THEN NULL WHEN lang = 'fr' THEN 1 WHEN lang IN ('de', 'es') THEN 2
    ELSE 0 END::INTEGER AS n_rules, length(input)::BIGINT AS n_chars FROM ({REQ_SQL})""",
)
def q_scan_requests(spark, sf):
    r = requests_from_docs(spark, sf)
    return r.select("request_id", "dry_run", F.size("rules").alias("n_rules"), F.length("input").cast("bigint").alias("n_chars")).withColumn(
        "n_rules", F.when(F.col("n_rules") >= 0, F.col("n_rules")).cast("int")
    )


@register("valid_requests", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND length(text) > 0")
def q_valid_requests(spark, sf):
    return valid_requests(conversations(spark, sf), "text").select("conv_id", "turn")


@register("valid_requests_strict", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND length(trim(text)) > 0")
def q_valid_requests_strict(spark, sf):
    return valid_requests(conversations(spark, sf), "text", strict=True).select("conv_id", "turn")


_DRY_STATUS_SQL = f"""SELECT request_id,
  CASE WHEN input_status = 'blocked' THEN 'blocked_input' WHEN dry_run AND input_status = 'modified' THEN 'modified'
       ELSE 'allowed' END AS response_status, input_status
  FROM ({O.input_verdict_sql(REQ_SQL, 'doc_id', 'input', 'live', None, _PII_ON, _INJ_ON)})"""


@register("dry_run", None)
def q_dry_run(spark, sf):
    """P3 (input screening only; full-run rows carry their input status)."""
    r = requests_from_docs(spark, sf)
    s = screen_input(r, "input", overrides="rules")
    status = (
        F.when(F.col("input_status") == "blocked", "blocked_input")
        .when(F.col("dry_run") & (F.col("input_status") == "modified"), "modified")
        .otherwise("allowed")
    )
    return s.select("request_id", status.alias("response_status"), "input_status")


ORACLES["dry_run"] = _DRY_STATUS_SQL


def pairs(spark, sf, how="left"):
    """Paired turns, spread after the join (the join output is what the
    detectors work on; a sort-merge join at scale already has enough
    partitions, a broadcast join keeps the scan's few)."""
    conv = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    raw = conversation_pairs(conv, how, keyless=True)
    answered = F.col("has_response") if "has_response" in raw.columns else F.lit(True)
    conv_id, turn = (F.coalesce(F.col(c), F.lit(0)) for c in ("conv_id", "turn"))
    raw = raw.withColumn("_in", conv_id * 7 + turn).withColumn("_out", conv_id * 11 + turn * 5 + 16)
    both = seeded(raw, "_in", "input", "input")
    both = both.withColumn("response", F.when(answered, seeded_text("_out", "response")).otherwise(F.col("response")))
    return balanced(spark, both.drop("_in", "_out"))


_PAIR_OV = O.output_verdict_sql("response", "live")
_PAIR_LIVE = O.input_verdict_sql(PAIRS_SQL, "request_id", "input", "live")


def _screen_pairs_sql(verdict_sql, ov, dry="false", library=False):
    gate = f"(input_status <> 'blocked' AND NOT {dry})"
    resp = (
        f"CASE WHEN input_status = 'blocked' THEN 'blocked_input' "
        f"WHEN {dry} AND input_status = 'modified' THEN 'modified' WHEN {dry} THEN 'allowed' "
        f"WHEN ({ov['output_status']}) = 'blocked' THEN 'blocked_output' ELSE 'allowed' END"
    )
    return f"""SELECT request_id, input_status, blocked_by, {resp} AS response_status,
      CASE WHEN {gate} THEN {ov['output_status']} END AS output_status,
      CASE WHEN {gate} THEN {ov['output_blocked_by']} END AS output_blocked_by,
      CASE WHEN {gate} THEN {ov['output_reason']} END AS output_reason,
      ({gate} AND ({resp}) = 'allowed') AS has_output,
      {O.route_sql('processed_input')} AS intent
    FROM ({verdict_sql})"""


_SCREEN_COLS = ["request_id", "input_status", "blocked_by", "response_status", "output_status",
                "output_blocked_by", "output_reason", "has_output", "intent"]


def _screen_select(s):
    return s.select(*_SCREEN_COLS[:-2], F.col("output").isNotNull().alias("has_output"), "intent")


@register("screen_conversations", _screen_pairs_sql(_PAIR_LIVE, _PAIR_OV))
def q_screen_conversations(spark, sf):
    """Flagship: every user turn with its answer, screened end to end."""
    return _screen_select(screen_requests(pairs(spark, sf), "input", "response"))


_PAIR_LIB = O.input_verdict_sql(PAIRS_SQL, "request_id", "input", "library", SCHEMA_POLICY)
_PAIR_OV_LIB = O.output_verdict_sql("response", "library", SCHEMA_POLICY)


@register("screen_pairs", _screen_pairs_sql(_PAIR_LIB, _PAIR_OV_LIB))
def q_screen_pairs(spark, sf):
    """V3, library profile (JSON-schema step on, blocking)."""
    return _screen_select(screen_requests(pairs(spark, sf), "input", "response", SCHEMA_POLICY, "library"))


@register(
    "response_join",
    f"SELECT request_id, has_response, length(response)::BIGINT AS response_chars FROM ({RAW_PAIRS_SQL})",
)
def q_response_join(spark, sf):
    c = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    reqs, resps = recorded_requests(c)
    j = response_join(reqs, resps)
    return j.select("request_id", "has_response", F.length("response").cast("bigint").alias("response_chars"))


@register(
    "screen_conversation_pairs",
    f"""SELECT request_id FROM ({PAIRS_SQL}) WHERE has_response""",
)
def q_screen_conversation_pairs(spark, sf):
    """Answered user turns only (inner pairing)."""
    return pairs(spark, sf, "inner").select("request_id")


# --------------------------------------------------------------------------
# Audit log (K1-K4) and dashboard
# --------------------------------------------------------------------------

AS_OF = "2024-01-31 00:00:00"
_AUDIT_TS = "2024-01-15 12:00:00"


def conversation_audit(spark, sf):
    """K1: audit rows of the screened conversations, live profile; the first
    user turn of each conversation is a dry run."""
    p = pairs(spark, sf).withColumn("dry_run", F.col("turn") == 0)
    s = screen_requests(p, "input", "response", dry_run="dry_run")
    return audit.audit_rows(s, "live", "input", "response", dry_run="dry_run",
                            created_at=F.lit(_AUDIT_TS).cast("timestamp"))


_AUD_DRY = "(turn = 0)"
_AUD_LIVE = O.input_verdict_sql(PAIRS_SQL, "request_id", "input", "live")
_AUD_SQL = f"""SELECT 'log-' || request_id AS id, request_id,
  CASE WHEN input_status = 'blocked' OR {_AUD_DRY} THEN 'input' ELSE 'output' END AS direction,
  CASE WHEN input_status = 'blocked' THEN 'blocked'
       WHEN {_AUD_DRY} THEN CASE WHEN input_status = 'modified' THEN 'modified' ELSE 'allowed' END
       WHEN ({_PAIR_OV['output_status']}) = 'blocked' THEN 'blocked' ELSE 'allowed' END AS status,
  CASE WHEN input_status = 'blocked' THEN blocked_by
       WHEN {_AUD_DRY} THEN CASE WHEN input_status = 'modified' THEN 'pii' END
       WHEN ({_PAIR_OV['output_status']}) = 'blocked' THEN {_PAIR_OV['output_blocked_by']} END AS blocked_by,
  CASE WHEN input_status = 'blocked' THEN reason
       WHEN {_AUD_DRY} THEN CASE WHEN input_status = 'modified' THEN reason END
       WHEN ({_PAIR_OV['output_status']}) = 'blocked' THEN {_PAIR_OV['output_reason']} END AS reason,
  CASE WHEN input_status <> 'blocked' AND NOT {_AUD_DRY} AND ({_PAIR_OV['output_status']}) = 'allowed' THEN response END AS output_text,
  CASE WHEN {_AUD_DRY} AND input_status = 'allowed' THEN NULL WHEN pii_count > 0 THEN 'pii' END AS pii_flag
FROM ({_AUD_LIVE})"""


@register("audit_log_rows", _AUD_SQL)
def q_audit_log_rows(spark, sf):
    a = conversation_audit(spark, sf)
    return a.select(
        "id", "request_id", "direction", "status", "blocked_by", "reason", "output_text",
        F.when(F.col("pii_found").isNotNull(), F.lit("pii")).alias("pii_flag"),
    )


def events_log(spark, sf):
    return audit_log_from_events(spark, sf)


EVENTS_LOG_SQL = """SELECT 'evt-' || CAST(event_id AS VARCHAR) AS id, CAST(event_id AS VARCHAR) AS request_id,
  'input' AS direction, props AS input_text, CAST(NULL AS VARCHAR) AS output_text,
  CASE event_type WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'modified' WHEN 'signup' THEN 'blocked' ELSE 'allowed' END AS status,
  CASE event_type WHEN 'error' THEN 'prompt_injection' WHEN 'purchase' THEN 'pii' WHEN 'signup' THEN 'toxicity' END AS blocked_by,
  CASE WHEN event_type IN ('error', 'purchase', 'signup') THEN 'event: ' || event_type END AS reason,
  floor(value)::INTEGER AS latency_ms, CASE WHEN event_type = 'purchase' THEN props END AS pii_found,
  ts AS created_at FROM events"""

_TS_FMT_SQL = "strftime(created_at, '%Y-%m-%d %H:%M:%S.%f')"


def _ts_str(c="created_at"):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


@register(
    "scan_audit_log",
    f"SELECT request_id, status, blocked_by, reason, latency_ms, pii_found, {_TS_FMT_SQL} AS created_at FROM ({EVENTS_LOG_SQL})",
)
def q_scan_audit_log(spark, sf):
    log = events_log(spark, sf)
    return log.select("request_id", "status", "blocked_by", "reason", "latency_ms", "pii_found", _ts_str().alias("created_at"))


_STATS_SQL = f"""SELECT total, blocked, modified, allowed,
  CASE WHEN total > 0 THEN {O.to_fixed_1_sql('blocked::DOUBLE / total::DOUBLE * 100.0')} ELSE '0' END AS block_rate,
  floor(coalesce(avg_l, 0.0) + 0.5)::BIGINT AS avg_latency, coalesce(max_l, 0)::BIGINT AS max_latency
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'blocked') AS blocked,
  count(*) FILTER (WHERE status = 'modified') AS modified, count(*) FILTER (WHERE status = 'allowed') AS allowed,
  avg(latency_ms) AS avg_l, max(latency_ms) AS max_l FROM ({EVENTS_LOG_SQL}))"""


@register("dash_stats", _STATS_SQL)
def q_dash_stats(spark, sf):
    return dashboard.dash_stats(events_log(spark, sf))


@register("block_rate_alarm", f"SELECT *, block_rate::DOUBLE > 20.0 AS alarm FROM ({_STATS_SQL})")
def q_block_rate_alarm(spark, sf):
    return dashboard.block_rate_alarm(dashboard.dash_stats(events_log(spark, sf)))


@register(
    "dash_stats_screened",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'blocked') AS blocked,
      count(*) FILTER (WHERE status = 'modified') AS modified, count(*) FILTER (WHERE status = 'allowed') AS allowed
    FROM ({_AUD_SQL})""",
)
def q_dash_stats_screened(spark, sf):
    return dashboard.dash_stats(conversation_audit(spark, sf)).select("total", "blocked", "modified", "allowed")


_BLOCKED_BY_SQL = f"""SELECT coalesce(blocked_by, 'unknown') AS type, count(*) AS count FROM ({EVENTS_LOG_SQL})
  WHERE status = 'blocked' AND blocked_by IS NOT NULL GROUP BY blocked_by"""


@register("blocked_by_counts", _BLOCKED_BY_SQL)
def q_blocked_by_counts(spark, sf):
    return dashboard.blocked_by_counts(events_log(spark, sf))


@register("blocked_by_chart", f"SELECT {O.title_label_sql('type')} AS label, count FROM ({_BLOCKED_BY_SQL})")
def q_blocked_by_chart(spark, sf):
    return dashboard.blocked_by_chart(events_log(spark, sf))


@register(
    "daily_counts",
    f"""SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS count FROM ({EVENTS_LOG_SQL})
    WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1""",
)
def q_daily_counts(spark, sf):
    return dashboard.daily_counts(events_log(spark, sf), F.lit(AS_OF).cast("timestamp"))


@register(
    "exact_ts_counts",
    f"""SELECT {_TS_FMT_SQL} AS created_at, count(*) AS count FROM ({EVENTS_LOG_SQL})
    WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1""",
)
def q_exact_ts_counts(spark, sf):
    return dashboard.daily_counts(events_log(spark, sf), F.lit(AS_OF).cast("timestamp"), grain="exact")


@register(
    "status_distribution",
    f"""SELECT name, value FROM (SELECT 'Allowed' AS name, allowed AS value FROM ({_STATS_SQL})
      UNION ALL SELECT 'Blocked', blocked FROM ({_STATS_SQL}) UNION ALL SELECT 'Modified', modified FROM ({_STATS_SQL}))
    WHERE value > 0""",
)
def q_status_distribution(spark, sf):
    return dashboard.status_distribution(events_log(spark, sf))


@register(
    "recent_requests",
    f"""SELECT request_id, direction, input_text, output_text, status, blocked_by, reason, latency_ms, pii_found,
      {_TS_FMT_SQL} AS created_at FROM ({EVENTS_LOG_SQL}) ORDER BY created_at DESC, request_id LIMIT 50""",
)
def q_recent_requests(spark, sf):
    r = dashboard.recent_requests(events_log(spark, sf))
    return r.withColumn("created_at", _ts_str())


@register(
    "recent_pii_count",
    f"""SELECT count(*) FILTER (WHERE pii_found IS NOT NULL AND pii_found <> '' AND pii_found <> '[]') AS pii_rows
    FROM (SELECT * FROM ({EVENTS_LOG_SQL}) ORDER BY created_at DESC, request_id LIMIT 50)""",
)
def q_recent_pii_count(spark, sf):
    return dashboard.recent_pii_count(events_log(spark, sf))


@register(
    "display_status",
    f"""SELECT CASE WHEN response_status IN ('blocked_input', 'blocked_output') THEN 'blocked' ELSE response_status END
      AS display_status, count(*) AS count FROM ({_screen_pairs_sql(_PAIR_LIVE, _PAIR_OV)}) GROUP BY 1""",
)
def q_display_status(spark, sf):
    s = screen_requests(pairs(spark, sf), "input", "response")
    return s.groupBy(display_status(F.col("response_status")).alias("display_status")).agg(F.count(F.lit(1)).alias("count"))


@register(
    "log_status",
    f"""SELECT request_id, CASE WHEN response_status IN ('blocked_input', 'blocked_output') THEN 'blocked'
      ELSE response_status END AS log_status FROM ({_screen_pairs_sql(_PAIR_LIVE, _PAIR_OV)})""",
)
def q_log_status(spark, sf):
    s = screen_requests(pairs(spark, sf), "input", "response")
    return s.select("request_id", dashboard.log_status(F.col("response_status")).alias("log_status"))


# K2: the events log delivered twice (at-least-once delivery); the replay
# arrives a minute later with another latency. One row per request survives:
# the first delivery.
def replayed_log(spark, sf):
    log = events_log(spark, sf)
    replay = log.select(
        F.concat(F.col("id"), F.lit("-r")).alias("id"), "request_id", "direction", "input_text", "output_text",
        "status", "blocked_by", "reason", (F.col("latency_ms") + 1).alias("latency_ms"), "pii_found",
        (F.col("created_at") + F.expr("INTERVAL 1 MINUTE")).alias("created_at"),
    )
    return log.unionByName(replay)


@register(
    "audit_log_dedup",
    f"""SELECT request_id, id, latency_ms, {_TS_FMT_SQL} AS created_at FROM ({EVENTS_LOG_SQL})""",
)
def q_audit_log_dedup(spark, sf):
    d = audit.dedupe_requests(replayed_log(spark, sf))
    return d.select("request_id", "id", "latency_ms", _ts_str().alias("created_at"))


@register(
    "clear_log",
    f"SELECT count(*) AS rows_before, 0::BIGINT AS rows_after FROM ({EVENTS_LOG_SQL})",
)
def q_clear_log(spark, sf):
    """K3: write the events log, clear it, and count its rows before and after."""
    from ..session import scratch_path

    path = scratch_path(spark, "clear-log")
    audit.write_audit_log(events_log(spark, sf), path, "overwrite")
    before = read_audit_log(spark, path).agg(F.count(F.lit(1)).alias("rows_before")).first()["rows_before"]
    return audit.clear_log(spark, path).agg(F.lit(before).alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))


def _response_json_sql(verdict_sql: str, ov: dict) -> str:
    gate = "(input_status <> 'blocked')"
    resp = (
        f"CASE WHEN input_status = 'blocked' THEN 'blocked_input' "
        f"WHEN ({ov['output_status']}) = 'blocked' THEN 'blocked_output' ELSE 'allowed' END"
    )
    return _RJ_TEMPLATE.format(gate=gate, resp=resp, os=ov["output_status"], ob=ov["output_blocked_by"],
                               orr=ov["output_reason"], src=verdict_sql)


_RJ_TEMPLATE = """SELECT request_id, regexp_replace(to_json({{
    'requestId': request_id, 'status': {resp},
    'inputStatus': {{'status': input_status, 'pii': pii_list,
       'injection': {{'detected': detected, 'confidence': confidence, 'type': inj_type, 'reason': inj_reason}},
       'maskedInput': masked_input, 'blockedBy': blocked_by, 'reason': reason}},
    'originalInput': input, 'processedInput': processed_input, 'latencyMs': CAST(NULL AS INTEGER),
    'outputStatus': CASE WHEN {gate} THEN {{'status': {os}, 'blockedBy': {ob}, 'reason': {orr}}} END,
    'output': CASE WHEN {gate} AND ({resp}) = 'allowed' THEN response END}}),
  ',"(maskedInput|blockedBy|reason|latencyMs|outputStatus|output)":null', '', 'g') AS body
FROM ({src})"""


@register("response_json", _response_json_sql(_PAIR_LIVE, _PAIR_OV))
def q_response_json(spark, sf):
    """K5: response rows as JSON text (null keys omitted)."""
    from ..operators.pairs import response_json

    s = screen_requests(pairs(spark, sf), "input", "response")
    return s.select("request_id", response_json(s).alias("body"))


_DOC_RESP_SQL = f"""SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS request_id, doc_id, text AS input, '' AS response
FROM ({SEEDED_SQL})"""


@register(
    "response_json_docs",
    _response_json_sql(O.input_verdict_sql(_DOC_RESP_SQL, "doc_id", "input", "live"), O.output_verdict_sql("response", "live")),
)
def q_response_json_docs(spark, sf):
    """K5 over seeded documents as requests with an absent (empty) answer:
    span lists, masked inputs and blocked inputs all appear."""
    from ..operators.pairs import response_json

    reqs = seeded_docs(spark, sf).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("request_id"),
        F.col("text").alias("input"), F.lit("").alias("response"),
    )
    s = screen_requests(reqs, "input", "response")
    return s.select("request_id", response_json(s).alias("body"))


# --------------------------------------------------------------------------
# Minimum slice / flagship summary (section 7.1)
# --------------------------------------------------------------------------


def verdict_summary(docs_df: DataFrame) -> DataFrame:
    """Rows per (lang, input_status, blocked_by) of the live input verdict."""
    s = screen_input(docs_df, "text")
    return s.groupBy("lang", "input_status", "blocked_by").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "verdict_summary",
    f"""SELECT lang, input_status, blocked_by, count(*) AS rows
    FROM ({O.input_verdict_sql(DOCS_LANG_SQL, 'doc_id', 'text', 'live')}) GROUP BY ALL""",
)
def q_verdict_summary(spark, sf):
    return verdict_summary(docs_lang(spark, sf))


# --------------------------------------------------------------------------
# Streaming (W1-W5): run to completion, read back, compare with batch SQL
# --------------------------------------------------------------------------


@register(
    "stream_screen",
    f"SELECT doc_id, input_status, blocked_by, reason, pii_count FROM ({O.input_verdict_sql(DOCS_SQL, 'doc_id', 'text', 'live')})",
)
def q_stream_screen(spark, sf):
    from ..streaming.screen import stream_screen

    return stream_screen(spark, sf)


_DOC_REQ_SQL = "SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS request_id, doc_id, text FROM documents"


@register(
    "stream_audit",
    f"""SELECT request_id, input_status AS status, blocked_by, reason,
      CASE WHEN pii_count > 0 THEN 'pii' END AS pii_flag
    FROM ({O.input_verdict_sql(_DOC_REQ_SQL, 'doc_id', 'text', 'live')})""",
)
def q_stream_audit(spark, sf):
    from ..streaming.screen import stream_audit

    a = stream_audit(spark, sf)
    return a.select("request_id", "status", "blocked_by", "reason",
                    F.when(F.col("pii_found").isNotNull(), F.lit("pii")).alias("pii_flag"))


@register("stream_conversations", _screen_pairs_sql(_PAIR_LIVE, _PAIR_OV))
def q_stream_conversations(spark, sf):
    """V3, J1 on streams: equal to the batch screen of the same pairs."""
    from ..streaming.screen import stream_conversations

    return _screen_select(stream_conversations(pairs(spark, sf)))


@register("stream_stats", _STATS_SQL)
def q_stream_stats(spark, sf):
    from ..streaming.screen import stream_stats

    return stream_stats(spark, sf)


@register(
    "stream_daily",
    f"SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS count FROM ({EVENTS_LOG_SQL}) GROUP BY 1",
)
def q_stream_daily(spark, sf):
    from ..streaming.screen import stream_daily

    return stream_daily(spark, sf)


@register("stream_dedup", f"SELECT request_id FROM ({EVENTS_LOG_SQL})")
def q_stream_dedup(spark, sf):
    from ..streaming.screen import stream_dedup

    return stream_dedup(spark, sf)


# --------------------------------------------------------------------------
# Further inventory entries: the injection result read column by column
# (N12-N14), the long span form under its own name (J5), a toggled policy
# (R4), the dry-run policy echo (P4), the JSON field-list fallback (O5) and
# the rejected side of request validation.
# --------------------------------------------------------------------------

for _col in ["confidence", "type", "reason"]:
    register(f"inj_{_col}", f"SELECT doc_id, {_col} FROM ({INJ_RESULT_SQL})")(
        (lambda c: (lambda spark, sf: q_inj_result(spark, sf).select("doc_id", c)))(_col)
    )

register("pii_long", O.spans_sql(SEEDED_SQL, "doc_id", "text"))(_spans_query(seeded_docs, PII_PATTERNS))

TOGGLED_POLICY = DEFAULT_POLICY.toggle("pii")


@register("policy_toggle", _verdict_sql(SEEDED_SQL, "live", TOGGLED_POLICY))
def q_policy_toggle(spark, sf):
    """The PII rule switched off by a toggle; PII is still detected
    (live profile) but no longer changes the verdict."""
    return _verdict_select(screen_input(seeded_docs(spark, sf), "text", TOGGLED_POLICY))


def _echo_json(policy) -> str:
    import json as _json

    def rules(rs):
        return [{"type": r.type, "enabled": r.enabled, "action": r.action} for r in rs]

    return _json.dumps(
        {"inputRules": rules(policy.input_rules), "outputRules": rules(policy.output_rules),
         "blockedTopics": list(policy.blocked_topics)},
        separators=(",", ":"),
    )


@register(
    "policy_echo",
    f"""SELECT request_id, CASE WHEN input_status <> 'blocked' AND dry_run THEN {q(_echo_json(DEFAULT_POLICY))} END AS policy
    FROM ({O.input_verdict_sql(REQ_SQL, 'doc_id', 'input', 'live')})""",
)
def q_policy_echo(spark, sf):
    """Dry-run responses (input not blocked) echo the policy in force."""
    from ..operators.policy import policy_echo

    s = screen_input(requests_from_docs(spark, sf).drop("rules"), "input")
    return s.select(
        "request_id",
        F.when((F.col("input_status") != "blocked") & F.col("dry_run"), F.to_json(policy_echo(DEFAULT_POLICY))).alias("policy"),
    )


# The policy's own field list ("k") wins over the rule's configured list
# ("k", "v"); compare output_verdict_library, which uses the configured one.
FALLBACK_POLICY = SCHEMA_POLICY.__class__(
    input_rules=SCHEMA_POLICY.input_rules,
    output_rules=SCHEMA_POLICY.output_rules,
    blocked_topics=SCHEMA_POLICY.blocked_topics,
    require_json=False,
    json_required_fields=("k",),
)
_OVF = O.output_verdict_sql("body", "library", FALLBACK_POLICY)


@register(
    "json_field_fallback",
    f"SELECT event_id, {_OVF['output_status']} AS output_status, {_OVF['schema_error']} AS schema_error FROM ({JSON_SQL})",
)
def q_json_field_fallback(spark, sf):
    s = screen_output(json_candidates(spark, sf), "body", FALLBACK_POLICY, "library")
    return s.select("event_id", "output_status", "schema_error")


@register(
    "rejected_requests",
    "SELECT conv_id, turn, 'Input text is required.' AS error FROM conversations WHERE text IS NULL OR length(text) = 0",
)
def q_rejected_requests(spark, sf):
    """P1, the rejected side (empty on the driver tables, which carry no
    empty texts; the unit tests cover rejections)."""
    from ..sources.tables import rejected_requests

    return rejected_requests(conversations(spark, sf), "text").select("conv_id", "turn", "error")


# --------------------------------------------------------------------------
# The suite operators on labelled driver data (J4, A8, A9): a labelled
# document is expected to be blocked on output when marked toxic, allowed
# otherwise; expected and actual meet in an inner join on the document id.
# --------------------------------------------------------------------------


def labelled_suite(spark, sf):
    from ..operators.suite import expected_vs_actual

    labels = read_table(spark, sf, "labels", ["doc_id", "toxic"]).select(
        "doc_id", F.when(F.col("toxic") == 1, "blocked").otherwise("allowed").alias("expected")
    )
    actual = screen_output(docs(spark, sf), "text").select("doc_id", F.col("output_status").alias("actual"),
                                                         F.col("output_reason").alias("details"))
    return expected_vs_actual(labels, actual, "doc_id")


_LOV = O.output_verdict_sql("d.text", "live")
_LABEL_SQL = f"""SELECT l.doc_id, CASE WHEN l.toxic = 1 THEN 'blocked' ELSE 'allowed' END AS expected,
  {_LOV['output_status']} AS actual, {_LOV['output_reason']} AS details
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


@register("suite_labels", f"SELECT *, expected = actual AS passed FROM ({_LABEL_SQL})")
def q_suite_labels(spark, sf):
    return labelled_suite(spark, sf).select("doc_id", "expected", "actual", "details", "passed")


@register(
    "suite_summary_labels",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed,
      {O.to_fixed_1_sql('(count(*) FILTER (WHERE passed))::DOUBLE / count(*)::DOUBLE * 100.0')} AS pass_rate,
      0::BIGINT AS total_latency_ms
    FROM (SELECT *, expected = actual AS passed FROM ({_LABEL_SQL}))""",
)
def q_suite_summary_labels(spark, sf):
    from ..operators.suite import suite_summary

    return suite_summary(labelled_suite(spark, sf).withColumn("latency_ms", F.lit(None).cast("int")))


# Queries over written tables and further policies register themselves.
from . import stored  # noqa: E402, F401
