"""Output screening: toxicity, blocked topics, JSON validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dialect
from .rules import (
    DEFAULT_BLOCKED_TOPICS,
    JSON_INVALID_REASON,
    JSON_MISSING_PREFIX,
    TOPIC_REASON_TEMPLATE,
    TOXICITY_RULES,
    ToxicityRule,
    first_char_guard,
)


def toxicity_java(r: ToxicityRule) -> str:
    return dialect.to_java(first_char_guard(r.first) + r.pattern, "i")


def toxicity_re2(r: ToxicityRule) -> str:
    return dialect.to_re2(r.pattern, "i")


def toxicity_reason(text: Column, rules: Sequence[ToxicityRule] = TOXICITY_RULES) -> Column:
    """Reason of the first matching rule, null when clean (O1). CASE WHEN
    short-circuits, so later rules do not run once one matched."""
    expr = None
    for r in rules:
        cond = text.rlike(toxicity_java(r))
        expr = F.when(cond, F.lit(r.reason)) if expr is None else expr.when(cond, F.lit(r.reason))
    return expr


def toxicity_rule_hit(text: Column, index: int) -> Column:
    """Boolean for one toxicity rule (O1a-O1d)."""
    return F.coalesce(text.rlike(toxicity_java(TOXICITY_RULES[index])), F.lit(False))


def topic_pattern_java(topic: str, escape: bool = False) -> str:
    import re

    t = re.escape(topic) if escape else topic
    return dialect.topic_java(t) if not escape else dialect.to_java(dialect.word_pattern(t), "i")


def topic_reason(text: Column, topics: Sequence[str] = DEFAULT_BLOCKED_TOPICS, escape: bool = False) -> Column:
    """``Output discusses blocked topic: "<topic>"`` for the first topic found
    as a whole word, case-insensitive; null when none (O2). Topic text is live
    regex as specified; ``escape=True`` treats it literally."""
    expr = None
    for tp in topics:
        cond = text.rlike(topic_pattern_java(tp, escape))
        reason = F.lit(TOPIC_REASON_TEMPLATE.format(topic=tp))
        expr = F.when(cond, reason) if expr is None else expr.when(cond, reason)
    return expr if expr is not None else F.lit(None).cast("string")


# Names every plain object answers to through its prototype; a required
# field with one of these names counts as present unless the object has its
# own key of that name set to null.
OBJECT_PROTOTYPE_KEYS = (
    "constructor", "hasOwnProperty", "isPrototypeOf", "propertyIsEnumerable",
    "toLocaleString", "toString", "valueOf", "__proto__", "__defineGetter__",
    "__defineSetter__", "__lookupGetter__", "__lookupSetter__",
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _wrapped(text: Column) -> tuple[Column, Column]:
    a = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    b = F.try_parse_json(F.concat(F.lit('{"w":'), text, F.lit("}")))
    return a, b


# ---- texts beyond the limits of the parser
#
# The parser gives up on numbers over 1,000 characters, nesting over 1,000,
# names over 50,000 and strings over 20 million, valid or not. Such a text is
# first written shorter, with the same validity and the same top level.

_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_STRING_UNIT = r'(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))'
_NUMBER = r"(?<![0-9.eE+\-])-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+(?![0-9.eE+\-])"
_HOLE = "\x01"  # in no valid text
_LEVELS = 3


@dataclass(frozen=True)
class ParserLimits:
    """What the parser surely takes: characters of a number, of a string, and
    nested brackets."""

    number: int = 900
    string: int = 40_000
    depth: int = 900


def _outside_strings(text: Column, pattern: str, by: str) -> Column:
    """Replace a pattern everywhere but in strings: every string and every
    match gets a mark, those of strings are taken away again."""
    marked = F.regexp_replace(text, f"({_STRING})|{pattern}", "$1" + _HOLE)
    return F.replace(F.regexp_replace(marked, f"({_STRING}){_HOLE}", "$1"), F.lit(_HOLE), F.lit(by))


def _brackets(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "[{", ""))


def _inner_value(levels: int) -> str:
    if not levels:
        return f"(?:{_STRING}|0|true|false|null)"
    v = _inner_value(levels - 1)
    return f"(?:{v}|{_container(v)})"


def _container(v: str) -> str:
    pair = f"{_STRING} ?: ?{v} ?"
    return rf"(?:\[ ?(?:{v} ?(?:, ?{v} ?)*+)?+\]|\{{ ?(?:{pair}(?:, ?{pair})*+)?+\}})"


def json_shortened(text: Column, limits: ParserLimits = ParserLimits()) -> Column:
    """``text`` with long strings empty, numbers as 0 and the innermost
    brackets as 0, level by level until few are left; never the outermost.
    Valid if and only if ``text`` is, with the same names at the top level
    (but for names over ``limits.string``, which become empty). Each round
    takes ``_LEVELS`` levels off, so the cost of one text grows with its length
    times its depth beyond ``limits.depth``."""
    short = F.regexp_replace(text, f'"(?:({_STRING_UNIT}{{0,{limits.string}}}+)"|{_STRING_UNIT}*+")', '"$1"')
    flat = _outside_strings(_outside_strings(short, _NUMBER, "0"), r"[ \t\n\r]++", " ")
    inner = r"(?<=[\[,:] ?)" + _container(_inner_value(_LEVELS - 1))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(_brackets(flat) / F.lit(_LEVELS)).cast("int")))

    def collapse(acc: Column, _: Column) -> Column:
        return F.when(_brackets(acc) <= limits.depth, acc).otherwise(_outside_strings(acc, inner, "0"))

    collapsed = _let(flat, lambda t: F.aggregate(rounds, t, collapse))
    return F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), text).otherwise(collapsed)


def _beyond(text: Column, limits: ParserLimits) -> Column:
    long = F.length(text) > limits.number
    return F.when(long, text.rlike(r'^[ \t\n\r]*[\[{"0-9-]') & (
        (F.length(text) > limits.string) | text.rlike(f"[0-9.eE+-]{{{limits.number}}}") | (_brackets(text) > limits.depth)))


def _parsed(text: Column, limits: ParserLimits = ParserLimits()) -> Column:
    """``struct<a, b>``: the text in both wrappers, null where it is not
    valid. Only a text that the parser refuses and that has something long in
    it is shortened and parsed again."""
    def attempt(found: Column, turn: Column) -> Column:
        a, b = _wrapped(F.when(turn == 1, text).otherwise(json_shortened(text, limits)))
        return F.when(found["a"].isNotNull() & found["b"].isNotNull(), found).otherwise(F.struct(a.alias("a"), b.alias("b")))

    nothing = F.lit(None).cast("variant")
    turns = F.when(_beyond(text, limits), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return F.aggregate(turns, F.struct(nothing.alias("a"), nothing.alias("b")), attempt)


def json_is_valid(text: Column) -> Column:
    """Strict JSON validity: exactly one JSON value, surrounding whitespace
    allowed, duplicates allowed. Wrapping in ``[ ]`` and in ``{"w": }`` and
    requiring both to parse rejects trailing text and lists like ``1,2``.
    Needs ``spark.sql.variant.allowDuplicateKeys=true`` (set by
    ``tollgate.session``)."""
    return _let(_parsed(text), lambda p: p["a"].isNotNull() & p["b"].isNotNull())


def _path_key(field: str) -> str:
    return "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _present(v: Column, path: str) -> Column:
    got = F.try_variant_get(v, path, "variant")
    return got.isNotNull() & ~F.is_variant_null(got)


def json_validate(text: Column, fields: Sequence[str] = ()) -> Column:
    """``struct<passed:boolean, reason:string>`` (O4, O4a-c).

    No fields: any valid JSON passes, scalars too. With fields: a scalar or
    null top level fails as invalid JSON (the membership test throws); an
    object needs each field as a non-null own key (or a prototype name); an
    array answers to ``length`` and its indices."""
    reason = _let(_parsed(text), lambda p: _json_reason(p["a"], p["a"].isNotNull() & p["b"].isNotNull(), fields))
    return _let(F.struct(reason.alias("reason")), lambda r: F.struct(r["reason"].isNull().alias("passed"), r["reason"].alias("reason")))


def _json_reason(a: Column, valid: Column, fields: Sequence[str]) -> Column:
    """Why a parsed text (in its array wrapper ``a``) fails, null if it passes."""
    if not fields:
        return F.when(~valid, F.lit(JSON_INVALID_REASON))
    # the value itself is the single element of the array wrapper: no
    # third parse
    return _let(F.struct(F.try_variant_get(a, "$[0]", "variant").alias("v"), valid.alias("valid")),
                lambda p: _field_reason(p["v"], p["valid"], fields))


def _field_reason(v: Column, valid: Column, fields: Sequence[str]) -> Column:
    kind = F.schema_of_variant(v)
    is_obj = kind.startswith("OBJECT")
    is_arr = kind.startswith("ARRAY")
    missing_items = []
    for f in fields:
        own = _present(v, _path_key(f))
        if f in OBJECT_PROTOTYPE_KEYS:
            own_key = F.try_variant_get(v, _path_key(f), "variant")
            obj_ok = own_key.isNull() | ~F.is_variant_null(own_key)
        else:
            obj_ok = own
        if f == "length":
            arr_ok = F.lit(True)
        elif f.isdigit() and (f == "0" or not f.startswith("0")):
            arr_ok = _present(v, f"$[{int(f)}]")
        else:
            arr_ok = F.lit(False)
        ok = F.when(is_obj, obj_ok).when(is_arr, arr_ok).otherwise(F.lit(False))
        missing_items.append(F.when(~ok, F.lit(f)))
    missing = F.filter(F.array(*missing_items), lambda x: x.isNotNull())
    container = is_obj | is_arr
    return (
        F.when(~valid | ~container, F.lit(JSON_INVALID_REASON))
        .when(F.size(missing) > 0, F.concat(F.lit(JSON_MISSING_PREFIX), F.array_join(missing, ", ")))
    )


def resolve_json_fields(policy_fields: Sequence[str], config_fields: Sequence[str] | None) -> tuple[str, ...]:
    """The policy list when non-empty, else the rule's ``fields`` config,
    else nothing."""
    if policy_fields:
        return tuple(policy_fields)
    return tuple(config_fields or ())
