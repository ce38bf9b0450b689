"""Input and output verdicts (V1, V2) for the three profiles.

``live``    the reachable HTTP behaviour: detectors always run, rule
            ``enabled`` gates only the verdict, actions are not read for
            injection, PII ``warn`` allows.
``library`` the engine module: a disabled rule skips detection, actions are
            honoured with defaults (injection block, PII mask, schema warn),
            output adds the JSON-schema step.
``suite``   the built-in test suite: rule ``enabled`` never read, anything
            but PII ``mask`` blocks, ``details`` always set.

Policy values are driver constants, so branches that a policy rules out are
not even planned; per-row overrides stay columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import injection as inj
from ..functions import output as outf
from ..functions import pii as piif
from ..functions.rules import (
    INJECTION_BLOCK_THRESHOLD,
    INJECTION_RULES,
    PII_PATTERNS,
    SUITE_ALL_PASSED,
    SUITE_PREFIX_BLOCK,
    SUITE_PREFIX_INJECTION,
    SUITE_PREFIX_MASK,
    InjectionRule,
    PiiPattern,
)
from .policy import DEFAULT_POLICY, Policy, default_action, enabled_col

PROFILES = ("live", "library", "suite")
_PARTS = "__pii_parts"  # internal: spans with their neighbouring text, for the linear mask


def _lit_str(s: str | None) -> Column:
    return F.lit(s).cast("string")


def _row_action(actions: str, t: str, fallback: str) -> Column:
    rule = F.get(F.filter(F.col(actions), lambda r: r["type"] == t), 0)
    return F.coalesce(rule["action"], F.lit(fallback))


def screen_input(
    df: DataFrame,
    text: str = "input",
    policy: Policy = DEFAULT_POLICY,
    profile: str = "live",
    overrides: str | None = None,
    mask_mode: str = "reference",
    threshold: float = INJECTION_BLOCK_THRESHOLD,
    pii_patterns: Sequence[PiiPattern] = PII_PATTERNS,
    injection_rules: Sequence[InjectionRule] = INJECTION_RULES,
    actions: str | None = None,
) -> DataFrame:
    """Add ``pii, injection, injection_hits, input_status, blocked_by, reason,
    masked_input, processed_input`` to ``df``.

    ``overrides`` names an ``array<struct<type,enabled>>`` column of per-row
    rule overrides (live/library only; the suite never reads them). ``actions``
    names an array with ``type`` and ``action`` (as ``rules_in_force`` makes it)
    whose non-null actions replace those of the policy in these two profiles."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    ov = F.col(overrides) if (overrides and profile != "suite") else None
    pii_on = enabled_col(policy, "pii", ov)
    inj_on = enabled_col(policy, "prompt_injection", ov)
    pii_rule = policy.input_rule("pii")
    inj_rule = policy.input_rule("prompt_injection")

    if profile == "library":
        # A disabled rule skips detection; with a constant policy the
        # detector is not planned at all.
        if ov is None and not (pii_rule and pii_rule.enabled):
            staged = df.withColumn("pii", F.array().cast(piif.SPANS_TYPE))
        else:
            staged = piif.with_pii(df, text, "pii", pii_patterns, enabled=pii_on if ov is not None else None,
                                   parts=_PARTS)
        if ov is None and not (inj_rule and inj_rule.enabled):
            staged = staged.withColumn(
                "injection_hits", F.array().cast("array<struct<type:string,reason:string>>")
            ).withColumn("injection", inj.no_injection())
        else:
            staged = inj.with_injection(staged, text, "injection", injection_rules, enabled=inj_on if ov is not None else None)
    else:
        staged = piif.with_pii(df, text, "pii", pii_patterns, parts=_PARTS if profile != "suite" else None)
        staged = inj.with_injection(staged, text, "injection", injection_rules)

    pii = F.col("pii")
    injc = F.col("injection")
    has_pii = F.size(pii) > 0
    blocking = inj.is_blocking(injc, threshold)

    if actions and profile != "suite":
        # each row has actions of its own
        fallback = "allow" if profile == "live" else "mask"
        pii_action = _row_action(actions, "pii", default_action(pii_rule, fallback))
        block_inj, pii_hit = inj_on & blocking, pii_on & has_pii
        if profile == "library":
            block_inj &= _row_action(actions, "prompt_injection", default_action(inj_rule, "block")) == "block"
        masks, blocks = pii_hit & (pii_action == "mask"), pii_hit & (pii_action == "block")
        status = F.when(block_inj, "blocked").when(masks, "modified").when(blocks, "blocked").otherwise("allowed")
        blocked_by = F.when(block_inj, "prompt_injection").when(masks | blocks, "pii")
        reason = F.when(block_inj, injc["reason"]).when(masks, piif.pii_reason("pii")).when(blocks, piif.pii_block_reason("pii"))
    elif profile == "live":
        block_inj = inj_on & blocking
        pii_hit = pii_on & has_pii
        action = pii_rule.action if pii_rule is not None else None
        status = F.when(block_inj, "blocked")
        blocked_by = F.when(block_inj, "prompt_injection")
        reason = F.when(block_inj, injc["reason"])
        if action == "mask":
            status = status.when(pii_hit, "modified")
            blocked_by = blocked_by.when(pii_hit, "pii")
            reason = reason.when(pii_hit, piif.pii_reason("pii"))
        elif action == "block":
            status = status.when(pii_hit, "blocked")
            blocked_by = blocked_by.when(pii_hit, "pii")
            reason = reason.when(pii_hit, piif.pii_block_reason("pii"))
        status = status.otherwise("allowed")
    elif profile == "library":
        inj_action = default_action(inj_rule, "block")
        pii_action = default_action(pii_rule, "mask")
        status = F.when(F.lit(False), _lit_str(None))
        blocked_by = F.when(F.lit(False), _lit_str(None))
        reason = F.when(F.lit(False), _lit_str(None))
        if inj_action == "block":
            status = F.when(blocking, "blocked")
            blocked_by = F.when(blocking, "prompt_injection")
            reason = F.when(blocking, injc["reason"])
        if pii_action == "mask":
            status = status.when(has_pii, "modified")
            blocked_by = blocked_by.when(has_pii, "pii")
            reason = reason.when(has_pii, piif.pii_reason("pii"))
        elif pii_action == "block":
            status = status.when(has_pii, "blocked")
            blocked_by = blocked_by.when(has_pii, "pii")
            reason = reason.when(has_pii, piif.pii_block_reason("pii"))
        status = status.otherwise("allowed")
    else:  # suite
        masks = pii_rule is not None and pii_rule.action == "mask"
        status = (
            F.when(blocking, "blocked")
            .when(has_pii, "modified" if masks else "blocked")
            .otherwise("allowed")
        )
        prefix = SUITE_PREFIX_MASK if masks else SUITE_PREFIX_BLOCK
        reason = (
            F.when(blocking, F.concat(F.lit(SUITE_PREFIX_INJECTION), injc["reason"]))
            .when(has_pii, piif.pii_reason("pii", prefix))
            .otherwise(F.lit(SUITE_ALL_PASSED))
        )
        blocked_by = F.when(
            status == "blocked",
            F.when(injc["detected"], "prompt_injection").otherwise("pii"),
        )

    decided = staged.withColumns(
        {"input_status": status, "blocked_by": blocked_by.cast("string"), "reason": reason.cast("string")}
    )
    has_parts = _PARTS in decided.columns
    modified = F.col("input_status") == "modified"
    if profile == "suite":
        out = decided.withColumn("masked_input", _lit_str(None))
    elif has_parts and mask_mode == "reference":
        out = piif.with_mask(decided, text, "pii", _PARTS, "masked_input", when=modified)
    else:
        out = decided.withColumn("masked_input", F.when(modified, piif.pii_mask(text, "pii", mask_mode)))
    out = out.withColumn("processed_input", F.coalesce(F.col("masked_input"), F.col(text)))
    return out.drop(_PARTS) if has_parts else out


def screen_output(
    df: DataFrame,
    text: str = "output",
    policy: Policy = DEFAULT_POLICY,
    profile: str = "live",
    overrides: str | None = None,
    gate: Column | None = None,
    escape_topics: bool = False,
) -> DataFrame:
    """Add ``output_status, output_blocked_by, output_reason`` and the three
    detail columns ``toxicity, topic_violation, schema_error`` (library
    fills them; live leaves them null). First failure wins: toxicity, then
    topic, then (library) JSON schema. ``gate`` limits the checks to rows
    where it is true (e.g. input not blocked); other rows get nulls."""
    if profile not in ("live", "library"):
        raise ValueError("output screening exists for the live and library profiles")
    ov = F.col(overrides) if overrides else None
    t = F.coalesce(F.col(text), F.lit(""))
    tox_on = enabled_col(policy, "toxicity", ov)
    topic_on = enabled_col(policy, "topic_relevance", ov)
    schema_on = enabled_col(policy, "json_schema", ov)
    topics = policy.blocked_topics

    tox = F.when(tox_on, outf.toxicity_reason(t))
    checks = {"__tox": tox}
    if topics:
        checks["__topic"] = F.when(tox_on & F.col("__tox").isNotNull(), _lit_str(None)).otherwise(
            F.when(topic_on, outf.topic_reason(t, topics, escape_topics))
        )
    else:
        checks["__topic"] = _lit_str(None)

    schema_rule = policy.output_rule("json_schema")
    schema_reason = _lit_str(None)
    if profile == "library" and schema_rule is not None:
        enforce = policy.require_json or bool(schema_rule.config.get("enforce"))
        action = default_action(schema_rule, "warn")
        if enforce and action == "block":
            fields = outf.resolve_json_fields(policy.json_required_fields, schema_rule.config.get("fields"))
            schema_reason = piif.fence(F.when(schema_on, outf.json_validate(t, fields)["reason"]))
    checks["__schema"] = schema_reason

    staged = df
    for k, v in checks.items():
        staged = staged.withColumn(k, v if gate is None else F.when(gate, v))
    tox_c, topic_c, schema_c = F.col("__tox"), F.col("__topic"), F.col("__schema")
    blocked_by = (
        F.when(tox_c.isNotNull(), "toxicity")
        .when(topic_c.isNotNull(), "topic_relevance")
        .when(schema_c.isNotNull(), "json_schema")
    )
    reason = F.coalesce(tox_c, topic_c, schema_c)
    status = F.when(blocked_by.isNotNull(), "blocked").otherwise("allowed")
    if gate is not None:
        status = F.when(gate, status)
    lib = profile == "library"
    out = staged.withColumns(
        {
            "output_status": status,
            "output_blocked_by": blocked_by.cast("string"),
            "output_reason": reason.cast("string"),
            "toxicity": tox_c if lib else _lit_str(None),
            "topic_violation": F.when(tox_c.isNull(), topic_c) if lib else _lit_str(None),
            "schema_error": F.when(tox_c.isNull() & topic_c.isNull(), schema_c) if lib else _lit_str(None),
        }
    )
    return out.drop("__tox", "__topic", "__schema")


def response_status_input_only(status: Column) -> Column:
    """Response status after input screening (dry run / blocked input)."""
    return F.when(status == "blocked", "blocked_input").when(status == "modified", "modified").otherwise("allowed")


def display_status(response_status: Column) -> Column:
    """Both blocked forms show as ``blocked``."""
    return (
        F.when(response_status.isin("blocked_input", "blocked_output"), "blocked")
        .when(response_status == "modified", "modified")
        .otherwise("allowed")
    )
