"""DuckDB SQL builders for the oracle side of every registered query.

The oracle is written independently of the Spark plans: RE2 patterns from
the same rule tables (``dialect.to_re2``), span offsets from
``regexp_split_to_array`` gap lengths, the mask as a ``list_reduce`` fold,
verdicts as ``CASE`` chains. DuckDB lambdas use the ``lambda x: ...`` form.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions import injection as inj
from ..functions import output as outf
from ..functions import pii as piif
from ..functions.dialect import sql_string, topic_re2
from ..functions.rules import (
    INJECTION_CONFIDENCE_BASE,
    INJECTION_CONFIDENCE_CAP,
    INJECTION_CONFIDENCE_STEP,
    INJECTION_RULES,
    JSON_INVALID_REASON,
    JSON_MISSING_PREFIX,
    PII_PATTERNS,
    ROUTE_DEFAULT,
    ROUTES,
    TOPIC_REASON_TEMPLATE,
    TOXICITY_RULES,
    InjectionRule,
    PiiPattern,
)

q = sql_string


def list_lit(items: Sequence[str]) -> str:
    return "[" + ", ".join(q(s) for s in items) + "]"


def spans_sql(src: str, key: str, text: str, pats: Sequence[PiiPattern] = PII_PATTERNS) -> str:
    """(key, pos, type, label, value, start, end) for every match of every
    pattern; ``pos`` is the position in the row's ordered span list."""
    parts = []
    for i, p in enumerate(pats):
        rp = q(piif.re2_pattern(p))
        parts.append(
            f"SELECT {key} AS k, {i} AS pidx, regexp_extract_all({text}, {rp}) AS mm, "
            f"regexp_split_to_array({text}, {rp}) AS gg FROM src"
        )
    types = list_lit([p.type for p in pats])
    labels = list_lit([p.label for p in pats])
    floors = []
    for i, p in enumerate(pats):
        if p.min_digits is not None and not p.floor_implied:
            floors.append(
                f"NOT (pidx = {i} AND length(regexp_replace(value, '[^0-9]', '', 'g')) < {p.min_digits})"
            )
    where = (" WHERE " + " AND ".join(floors)) if floors else ""
    # a detector whose matches may be padded keeps the trimmed value
    padded = ", ".join(str(i) for i, p in enumerate(pats) if p.may_pad)
    trimmed = f"CASE WHEN pidx IN ({padded}) THEN regexp_replace(mm[i], '^\\s+|\\s+$', '', 'g') ELSE mm[i] END" if padded else "mm[i]"
    return f"""
WITH src AS ({src}),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT k, pidx, mm, gg, unnest(range(1, len(mm) + 1)) AS i FROM m WHERE len(mm) > 0),
s AS (
  SELECT k, pidx, i, {trimmed} AS value,
    (list_sum(list_transform(gg[1:i], lambda x: length(x)))
     + coalesce(list_sum(list_transform(mm[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM e),
f AS (SELECT * FROM s{where})
SELECT k AS {key},
  (row_number() OVER (PARTITION BY k ORDER BY pidx, i) - 1)::BIGINT AS pos,
  {types}[pidx + 1] AS type, {labels}[pidx + 1] AS label, value, start,
  (start + length(value))::BIGINT AS "end"
FROM f"""


def mask_sql(src: str, key: str, text: str, pats: Sequence[PiiPattern] = PII_PATTERNS) -> str:
    """(key, masked) for every row of ``src``: right-to-left fold over spans
    sorted by start descending, list position ascending."""
    return f"""
WITH src AS ({src}),
sp AS ({spans_sql(src, key, text, pats)}),
agg AS (SELECT {key}, list({{'ns': -start, 'pos': pos, 's': start, 'e': "end", 'label': label}}) AS spans
        FROM sp GROUP BY {key})
SELECT src.{key},
  CASE WHEN agg.spans IS NULL THEN src.{text}
       ELSE list_reduce(list_sort(agg.spans),
              lambda acc, m: substring(acc, 1, m.s) || '[' || m.label || ']' || substring(acc, m.e + 1),
              src.{text}) END AS masked
FROM src LEFT JOIN agg ON src.{key} = agg.{key}"""


def rule_hit_sql(text: str, r: InjectionRule) -> str:
    return f"regexp_matches({text}, {q(inj.re2_pattern(r))})"


def inj_hits_sql(text: str, rules: Sequence[InjectionRule] = INJECTION_RULES) -> str:
    items = ", ".join(
        f"CASE WHEN {rule_hit_sql(text, r)} THEN {{'type': {q(r.type)}, 'reason': {q(r.reason)}}} END"
        for r in rules
    )
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def inj_fields_sql(hits: str = "hits") -> dict[str, str]:
    n_types = f"len(list_distinct(list_transform({hits}, lambda h: h.type)))"
    conf = (
        f"CASE WHEN len({hits}) > 0 THEN least({INJECTION_CONFIDENCE_CAP}::DOUBLE, "
        f"{INJECTION_CONFIDENCE_BASE}::DOUBLE + {n_types} * {INJECTION_CONFIDENCE_STEP}::DOUBLE) ELSE 0.0::DOUBLE END"
    )
    return {
        "detected": f"(len({hits}) > 0)",
        "confidence": conf,
        "type": f"coalesce({hits}[1].type, 'none')",
        "reason": f"coalesce(array_to_string(list_transform({hits}, lambda h: h.reason), '; '), '')",
    }


def toxicity_sql(text: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({text}, {q(outf.toxicity_re2(r))}) THEN {q(r.reason)}" for r in TOXICITY_RULES
    )
    return f"(CASE {whens} END)"


def topic_sql(text: str, topics: Sequence[str]) -> str:
    if not topics:
        return "CAST(NULL AS VARCHAR)"
    whens = " ".join(
        f"WHEN regexp_matches({text}, {q(topic_re2(t))}) THEN {q(TOPIC_REASON_TEMPLATE.format(topic=t))}"
        for t in topics
    )
    return f"(CASE {whens} END)"


def route_sql(text: str) -> str:
    whens = []
    for r in ROUTES:
        cond = " OR ".join(f"contains(lower({text}), {q(k)})" for k in r.keywords)
        whens.append(f"WHEN {cond} THEN {q(r.intent)}")
    return f"(CASE {' '.join(whens)} ELSE {q(ROUTE_DEFAULT)} END)"


def json_reason_sql(text: str, fields: Sequence[str]) -> str:
    """Reason of the strict JSON check (null = passed). Inputs are chosen so
    that DuckDB's json_valid agrees with strict JSON (no NaN, no trailing
    commas, no duplicate keys)."""
    if not fields:
        return f"(CASE WHEN NOT coalesce(json_valid({text}), false) THEN {q(JSON_INVALID_REASON)} END)"
    miss = []
    for f in fields:
        path = q("$." + '"' + f + '"')
        obj_ok = f"coalesce(json_type(json_extract({text}, {path})), 'NULL') <> 'NULL'"
        if f == "length":
            arr_ok = "true"
        elif f.isdigit() and (f == "0" or not f.startswith("0")):
            arr_ok = f"coalesce(json_type(json_extract({text}, '$[{int(f)}]')), 'NULL') <> 'NULL'"
        else:
            arr_ok = "false"
        ok = f"(CASE json_type({text}) WHEN 'OBJECT' THEN {obj_ok} WHEN 'ARRAY' THEN {arr_ok} ELSE false END)"
        miss.append(f"CASE WHEN NOT {ok} THEN {q(f)} END")
    missing = f"list_filter([{', '.join(miss)}], lambda x: x IS NOT NULL)"
    return (
        f"(CASE WHEN NOT coalesce(json_valid({text}), false) OR json_type({text}) NOT IN ('OBJECT', 'ARRAY') "
        f"THEN {q(JSON_INVALID_REASON)} "
        f"WHEN len({missing}) > 0 THEN {q(JSON_MISSING_PREFIX)} || array_to_string({missing}, ', ') END)"
    )


def to_fixed_1_sql(x: str) -> str:
    """JavaScript toFixed(1): printf rounds the exact binary value half-even;
    exact quarter ties go up."""
    return (
        f"(CASE WHEN ({x}) * 4 = floor(({x}) * 4) AND ({x}) * 2 <> floor(({x}) * 2) "
        f"THEN printf('%.1f', floor(({x}) * 10 + 0.5) / 10) ELSE printf('%.1f', {x}) END)"
    )


def title_label_sql(x: str) -> str:
    s = f"replace({x}, '_', ' ')"
    return (
        f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: "
        f"CASE WHEN (i = 1 OR NOT regexp_matches(substring({s}, i - 1, 1), '^[A-Za-z0-9_]$')) "
        f"AND regexp_matches(substring({s}, i, 1), '^[a-z]$') THEN upper(substring({s}, i, 1)) "
        f"ELSE substring({s}, i, 1) END), '')"
    )


def input_verdict_sql(src: str, key: str, text: str, profile: str = "live", policy=None,
                      pii_on: str = "true", inj_on: str = "true", extra_cols: str = "") -> str:
    """Rows of ``src`` with ``input_status, blocked_by, reason, pii_count,
    detected, confidence, inj_type, processed_input`` (live/library/suite).
    ``pii_on``/``inj_on`` are SQL booleans for per-row rule switches."""
    from ..operators.policy import DEFAULT_POLICY, default_action

    policy = policy or DEFAULT_POLICY
    pr = policy.input_rule("pii")
    ir = policy.input_rule("prompt_injection")
    if pr is None or not pr.enabled:
        pii_on = "false"
    if ir is None or not ir.enabled:
        inj_on = "false"
    f = inj_fields_sql("hits")
    blocking = "(ir.detected AND ir.confidence >= 0.5)"
    has = "(coalesce(pa.n, 0) > 0)"
    labels = "coalesce(pa.labels, '')"
    if profile == "live":
        bi = f"(({inj_on}) AND {blocking})"
        ph = f"(({pii_on}) AND {has})"
        act = pr.action if pr else None
        st = [f"WHEN {bi} THEN 'blocked'"]
        bb = [f"WHEN {bi} THEN 'prompt_injection'"]
        rs = [f"WHEN {bi} THEN ir.reason"]
        if act == "mask":
            st.append(f"WHEN {ph} THEN 'modified'"); bb.append(f"WHEN {ph} THEN 'pii'")
            rs.append(f"WHEN {ph} THEN 'PII detected: ' || {labels}")
        elif act == "block":
            st.append(f"WHEN {ph} THEN 'blocked'"); bb.append(f"WHEN {ph} THEN 'pii'")
            rs.append(f"WHEN {ph} THEN 'PII blocked: ' || {labels}")
        status = f"CASE {' '.join(st)} ELSE 'allowed' END"
        blocked_by = f"CASE {' '.join(bb)} END"
        reason = f"CASE {' '.join(rs)} END"
    elif profile == "library":
        ia = default_action(ir, "block")
        pa_ = default_action(pr, "mask")
        bi = f"(({inj_on}) AND {blocking})"
        ph = f"(({pii_on}) AND {has})"
        st, bb, rs = [], [], []
        if ia == "block":
            st.append(f"WHEN {bi} THEN 'blocked'"); bb.append(f"WHEN {bi} THEN 'prompt_injection'")
            rs.append(f"WHEN {bi} THEN ir.reason")
        if pa_ == "mask":
            st.append(f"WHEN {ph} THEN 'modified'"); bb.append(f"WHEN {ph} THEN 'pii'")
            rs.append(f"WHEN {ph} THEN 'PII detected: ' || {labels}")
        elif pa_ == "block":
            st.append(f"WHEN {ph} THEN 'blocked'"); bb.append(f"WHEN {ph} THEN 'pii'")
            rs.append(f"WHEN {ph} THEN 'PII blocked: ' || {labels}")
        status = f"CASE {' '.join(st)} ELSE 'allowed' END" if st else "'allowed'"
        blocked_by = f"CASE {' '.join(bb)} END" if bb else "CAST(NULL AS VARCHAR)"
        reason = f"CASE {' '.join(rs)} END" if rs else "CAST(NULL AS VARCHAR)"
    else:
        masks = pr is not None and pr.action == "mask"
        st_p = "'modified'" if masks else "'blocked'"
        pre = "PII masked: " if masks else "PII blocked: "
        status = f"CASE WHEN {blocking} THEN 'blocked' WHEN {has} THEN {st_p} ELSE 'allowed' END"
        reason = (f"CASE WHEN {blocking} THEN 'Injection: ' || ir.reason WHEN {has} THEN {q(pre)} || {labels} "
                  f"ELSE 'All checks passed' END")
        blocked_by = f"CASE WHEN ({status}) = 'blocked' THEN CASE WHEN ir.detected THEN 'prompt_injection' ELSE 'pii' END END"
    lib = profile == "library"
    n_expr = f"CASE WHEN {pii_on} THEN coalesce(pa.n, 0) ELSE 0 END" if lib else "coalesce(pa.n, 0)"
    ir_det = f"(({inj_on}) AND ir.detected)" if lib else "ir.detected"
    ir_conf = f"CASE WHEN {inj_on} THEN ir.confidence ELSE 0.0::DOUBLE END" if lib else "ir.confidence"
    ir_type = f"CASE WHEN {inj_on} THEN ir.type ELSE 'none' END" if lib else "ir.type"
    masked = "CASE WHEN v.input_status = 'modified' THEN mk.masked ELSE v.input_text END" if profile != "suite" else "v.input_text"
    return f"""
WITH src AS ({src}),
sp AS ({spans_sql(src, key, text)}),
pa AS (SELECT {key}, count(*) AS n, string_agg(label, ', ' ORDER BY pos) AS labels,
        list({{'type': type, 'label': label, 'value': value, 'start': start::INTEGER, 'end': "end"::INTEGER}} ORDER BY pos) AS pii_list
        FROM sp GROUP BY {key}),
ih AS (SELECT {key}, {inj_hits_sql(text)} AS hits FROM src),
ir AS (SELECT {key}, {f['detected']} AS detected, {f['confidence']} AS confidence, {f['type']} AS type,
       {f['reason']} AS reason FROM ih),
mk AS ({mask_sql(src, key, text)}),
v AS (
  SELECT src.*, src.{text} AS input_text, {status} AS input_status, {blocked_by} AS blocked_by, {reason} AS reason,
    ({n_expr})::BIGINT AS pii_count, {ir_det} AS detected, {ir_conf} AS confidence, {ir_type} AS inj_type,
    CASE WHEN {inj_on if lib else 'true'} THEN ir.reason ELSE '' END AS inj_reason,
    CASE WHEN {pii_on if lib else 'true'} THEN coalesce(pa.pii_list, []) ELSE [] END AS pii_list
    {extra_cols}
  FROM src LEFT JOIN pa ON src.{key} = pa.{key} JOIN ir ON src.{key} = ir.{key})
SELECT v.*, {masked} AS processed_input,
  CASE WHEN v.input_status = 'modified' THEN mk.masked END AS masked_input
FROM v LEFT JOIN mk ON v.{key} = mk.{key}"""


def output_verdict_sql(text: str, profile: str = "live", policy=None, tox_on: str = "true",
                       topic_on: str = "true") -> dict[str, str]:
    """SQL expressions for output_status, output_blocked_by, output_reason
    (and the library detail columns) over a text expression."""
    from ..operators.policy import DEFAULT_POLICY, default_action

    policy = policy or DEFAULT_POLICY
    tr = policy.output_rule("toxicity")
    pr = policy.output_rule("topic_relevance")
    sr = policy.output_rule("json_schema")
    if tr is None or not tr.enabled:
        tox_on = "false"
    if pr is None or not pr.enabled:
        topic_on = "false"
    t = f"coalesce({text}, '')"
    tox = f"CASE WHEN {tox_on} THEN {toxicity_sql(t)} END"
    topic = f"CASE WHEN {topic_on} THEN {topic_sql(t, policy.blocked_topics)} END"
    schema = "CAST(NULL AS VARCHAR)"
    if profile == "library" and sr is not None and sr.enabled:
        enforce = policy.require_json or bool(sr.config.get("enforce"))
        if enforce and default_action(sr, "warn") == "block":
            fields = outf.resolve_json_fields(policy.json_required_fields, sr.config.get("fields"))
            schema = json_reason_sql(t, fields)
    blocked_by = (f"CASE WHEN ({tox}) IS NOT NULL THEN 'toxicity' WHEN ({topic}) IS NOT NULL THEN 'topic_relevance' "
                  f"WHEN ({schema}) IS NOT NULL THEN 'json_schema' END")
    reason = f"coalesce({tox}, {topic}, {schema})"
    out = {
        "output_status": f"CASE WHEN ({blocked_by}) IS NOT NULL THEN 'blocked' ELSE 'allowed' END",
        "output_blocked_by": blocked_by,
        "output_reason": reason,
    }
    if profile == "library":
        out["toxicity"] = tox
        out["topic_violation"] = f"CASE WHEN ({tox}) IS NULL THEN {topic} END"
        out["schema_error"] = f"CASE WHEN ({tox}) IS NULL AND ({topic}) IS NULL THEN {schema} END"
    return out
