"""Policy: rules, defaults, overrides, toggles.

A policy is small configuration (a closed set of rule types), resolved on the
driver into column expressions. Per-row overrides (a ``rules`` array column on
request rows) stay columns, so one plan serves rows with different
overrides.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import DEFAULT_BLOCKED_TOPICS

INPUT_TYPES = ("pii", "prompt_injection", "topic_block")
OUTPUT_TYPES = ("json_schema", "toxicity", "topic_relevance")

RULE_SCHEMA = "position int, category string, type string, enabled boolean, action string, config map<string,string>"
OVERRIDE_TYPE = "array<struct<type:string,enabled:boolean>>"
POLICY_TABLE_SCHEMA = (
    "id string, name string, category string, type string, enabled boolean, "
    "config string, created_at timestamp, updated_at timestamp"
)


@dataclass(frozen=True)
class Rule:
    type: str
    enabled: bool = True
    action: str | None = "block"
    config: dict = field(default_factory=dict, hash=False, compare=False)


@dataclass(frozen=True)
class Policy:
    input_rules: tuple[Rule, ...]
    output_rules: tuple[Rule, ...]
    blocked_topics: tuple[str, ...] = tuple(DEFAULT_BLOCKED_TOPICS)
    require_json: bool = False
    json_required_fields: tuple[str, ...] = ()

    def input_rule(self, t: str) -> Rule | None:
        """R2: first rule of the type wins; None if absent."""
        return next((r for r in self.input_rules if r.type == t), None)

    def output_rule(self, t: str) -> Rule | None:
        return next((r for r in self.output_rules if r.type == t), None)

    def with_rule(self, t: str, **changes) -> "Policy":
        """Copy with the first rule of type ``t`` changed (action included,
        which request overrides never change)."""
        def upd(rules):
            out, done = [], False
            for r in rules:
                if r.type == t and not done:
                    r = replace(r, **changes)
                    done = True
                out.append(r)
            return tuple(out)

        return replace(self, input_rules=upd(self.input_rules), output_rules=upd(self.output_rules))

    def toggle(self, t: str) -> "Policy":
        """Flip ``enabled`` of the rule(s) of a type."""
        def flip(rules):
            return tuple(replace(r, enabled=not r.enabled) if r.type == t else r for r in rules)

        return replace(self, input_rules=flip(self.input_rules), output_rules=flip(self.output_rules))

    def with_overrides(self, overrides: Sequence[dict] | None) -> "Policy":
        """R1 on the driver: per rule type the first override of that type
        replaces ``enabled`` only (a missing ``enabled`` disables); unknown
        types are ignored; None leaves the policy unchanged."""
        if overrides is None:
            return self

        def merge(rules):
            out = []
            for r in rules:
                m = next((o for o in overrides if o.get("type") == r.type), None)
                out.append(replace(r, enabled=bool(m.get("enabled"))) if m is not None else r)
            return tuple(out)

        return replace(self, input_rules=merge(self.input_rules), output_rules=merge(self.output_rules))


# FIXED VALUES: the default policy.
DEFAULT_POLICY = Policy(
    input_rules=(
        Rule("pii", True, "mask"),
        Rule("prompt_injection", True, "block"),
        Rule("topic_block", True, "block"),
    ),
    output_rules=(
        Rule("toxicity", True, "block"),
        Rule("topic_relevance", True, "block"),
        Rule("json_schema", False, "warn"),
    ),
    blocked_topics=tuple(DEFAULT_BLOCKED_TOPICS),
    require_json=False,
    json_required_fields=(),
)


def default_action(rule: Rule | None, fallback: str) -> str:
    """A missing or empty action falls back (injection ``block``, PII
    ``mask``, JSON schema ``warn``)."""
    return (rule.action if rule is not None else None) or fallback


def enabled_col(policy: Policy, t: str, overrides: Column | None = None) -> Column:
    """Boolean column: is rule ``t`` enabled for this row.

    With an override column (``array<struct<type,enabled>>``): the first
    override of the type decides, a null ``enabled`` disables, no matching
    override keeps the policy value; a null or empty array changes nothing.
    A rule absent from the policy is disabled whatever the override says."""
    rule = policy.input_rule(t) or policy.output_rule(t)
    base = F.lit(bool(rule.enabled) if rule is not None else False)
    if overrides is None or rule is None:
        return base
    match = F.get(F.filter(overrides, lambda o: o["type"] == F.lit(t)), 0)
    return F.when(match.isNotNull(), F.coalesce(match["enabled"], F.lit(False))).otherwise(base)


def rules_frame(spark: SparkSession, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """S3/R5 as a table: ``(position, category, type, enabled, action, config)``."""
    rows = []
    pos = 0
    for cat, rules in (("input", policy.input_rules), ("output", policy.output_rules)):
        for r in rules:
            rows.append((pos, cat, r.type, r.enabled, r.action, {k: json.dumps(v) if not isinstance(v, str) else v for k, v in r.config.items()}))
            pos += 1
    return spark.createDataFrame(rows, RULE_SCHEMA)


def topics_frame(spark: SparkSession, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return spark.createDataFrame(list(enumerate(policy.blocked_topics)), "position int, topic string")


def override_rules_table(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """R1/J3 as tables: ``overrides(position, type, enabled)``; the first
    override per type (lowest position) replaces ``enabled``. The override
    side is reduced to one row per rule type with a partial (map-side)
    ``min_by`` aggregate, so a hot type never lands whole in one task, and
    the reduced side is bounded by the closed set of types: safe to
    broadcast."""
    first = overrides.groupBy("type").agg(
        F.min_by("enabled", "position").alias("_ov_enabled"), F.lit(True).alias("_ov")
    )
    joined = rules.join(F.broadcast(first), "type", "left")
    return joined.select(
        *[
            F.when(F.col("_ov").isNotNull(), F.coalesce("_ov_enabled", F.lit(False))).otherwise(F.col("enabled")).alias("enabled")
            if c == "enabled"
            else F.col(c)
            for c in rules.columns
        ]
    )


def toggle_rules_table(rules: DataFrame, t: str) -> DataFrame:
    """R4 as a column update."""
    return rules.withColumn("enabled", F.when(F.col("type") == t, ~F.col("enabled")).otherwise(F.col("enabled")))


def policy_from_table(table: DataFrame, base: Policy = DEFAULT_POLICY) -> Policy:
    """Build a policy from a stored rule table (``POLICY_TABLE_SCHEMA``;
    ``config`` is JSON text with optional ``action``, ``fields``, ``enforce``).
    Rules of one type: the first by creation time, then id, counts. The table
    is reduced to one row per known rule type before it is read, so what
    reaches the driver is bounded by the closed set of types."""
    known = [("input", r.type) for r in base.input_rules] + [("output", r.type) for r in base.output_rules]
    wanted = F.struct("category", "type").isin([F.struct(F.lit(c), F.lit(t)) for c, t in known])
    place = F.struct(*[F.col(c) for c in ("created_at", "id") if c in table.columns], "enabled", "config")
    first = table.filter(wanted).groupBy("category", "type").agg(F.min_by(F.struct("enabled", "config"), place).alias("rule"))
    found = {(r["category"], r["type"]): r["rule"] for r in first.collect()}
    rows = [{"category": c, "type": t, **found[c, t].asDict()} for c, t in known if (c, t) in found]
    ins, outs = [], []
    for r in rows:
        cfg = json.loads(r["config"]) if r["config"] else {}
        action = cfg.pop("action", None)
        rule = Rule(r["type"], bool(r["enabled"]), action, cfg)
        (ins if r["category"] == "input" else outs).append(rule)
    return replace(base, input_rules=tuple(ins) or base.input_rules, output_rules=tuple(outs) or base.output_rules)


def policy_echo(policy: Policy) -> Column:
    """The dry-run policy echo as a struct column (type, enabled, action
    per rule, plus blocked topics)."""
    def rules_arr(rules):
        return F.array(*[
            F.struct(F.lit(r.type).alias("type"), F.lit(r.enabled).alias("enabled"), F.lit(r.action).alias("action"))
            for r in rules
        ])

    return F.struct(
        rules_arr(policy.input_rules).alias("inputRules"),
        rules_arr(policy.output_rules).alias("outputRules"),
        F.array(*[F.lit(t) for t in policy.blocked_topics]).alias("blockedTopics"),
    )
