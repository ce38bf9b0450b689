"""Rule tables for screening.

Everything between the two FIXED VALUES markers must stay exactly as written:
the patterns, labels, reasons, topics and keywords are the behaviour being
reproduced, so a changed character changes results. Patterns are kept in the
JavaScript regex dialect they were specified in; ``dialect.py`` turns them
into Java (Spark) and RE2 (DuckDB oracle) patterns with the same meaning.
Order matters everywhere: span lists, first-match-wins and mask ties all
follow list order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .dialect import to_java

# ---------------------------------------------------------------------------
# FIXED VALUES (begin) -- must equal the screened behaviour exactly.
# ---------------------------------------------------------------------------

# PII detectors, in list order: (type, label, pattern, flags)
PII_PATTERN_TABLE = [
    ("credit_card", "Credit Card Number", r"\b(?:\d[ -]*?){13,19}\b", ""),
    ("ssn", "Social Security Number", r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b", ""),
    ("email", "Email Address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", ""),
    ("phone", "Phone Number", r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", ""),
    ("api_key", "API Key", r"\b(sk|pk|api_key|apikey|secret|token)[_-][A-Za-z0-9_-]{20,}\b", "i"),
    ("aws_key", "AWS Access Key", r"\bAKIA[0-9A-Z]{16}\b", ""),
    ("bitcoin", "Bitcoin Address", r"\b(bc1|[13])[a-zA-HJ-NP-Z0-9]{25,39}\b", ""),
    ("ip_address", "IP Address", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", ""),
]

# Digit floors applied by type name after a match: fewer digits -> dropped.
PII_MIN_DIGITS = {"credit_card": 13, "phone": 10}

# Injection rules, in list order: (type, pattern, reason); all case-insensitive.
INJECTION_RULE_TABLE = [
    ("role_hijack", r"ignore (all )?(previous|above) (instructions?|prompts?|rules?)", "Attempt to ignore system instructions"),
    ("role_hijack", r"you are (now|no longer|a) (?:a |an )?(?:helpful|evil|jailbroken|unrestricted| DAN)", "Attempt to override system role"),
    ("role_hijack", r"forget (everything|all|your instructions|your rules)", "Attempt to reset system context"),
    ("system_prompt_leak", r"(?:reveal|show|print|display|output|repeat|tell me) (?:your |the )?(?:system |initial |original )?(?:prompt|instructions?|rules?)", "Attempt to extract system prompt"),
    ("system_prompt_leak", r"\{[\s\S]*?system[\s\S]*?prompt[\s\S]*?\}", "Possible system prompt extraction via template"),
    ("delimiter_attack", r"(?:```\s*system|<\|im_start\|>system|\[SYSTEM\])", "Attempt to inject system-level delimiter"),
    ("jailbreak", r"(?:jailbreak|jail.?break|DAN|do anything now)", "Known jailbreak technique detected"),
    ("encoding_bypass", r"(?:base64|rot13|unicode|url.?encod|html.?entit)", "Possible encoding-based bypass attempt"),
    ("multi_turn_attack", r"(?:step\s*\d+\s*[:.]|act\s+as\s+if|pretend\s+you)", "Multi-turn manipulation pattern detected"),
    ("indirect_injection", r"(?:read the (?:following|below) (?:text|data|content)|process this (?:document|file|data))", "Possible indirect prompt injection via data"),
]

# Confidence = min(CAP, BASE + STEP * distinct types); block when >= THRESHOLD.
INJECTION_CONFIDENCE_BASE = 0.5
INJECTION_CONFIDENCE_STEP = 0.15
INJECTION_CONFIDENCE_CAP = 0.95
INJECTION_BLOCK_THRESHOLD = 0.5

# Toxicity rules, first match wins: (pattern, reason); all case-insensitive.
TOXICITY_RULE_TABLE = [
    (r"i(?:'m| am) (?:going to|planning to|about to) (?:kill|hurt|harm|attack)", "Violent intent expression"),
    (r"(?:how to|instructions? to|step.?by.?step to) (?:make|create|build|cook) (?:a )?(?:bomb|weapon|drug|poison|meth)", "Harmful content generation request"),
    (r"i(?:'m| am) (?:an? )?(?:nazi|racist|supremacist|white nationalist)", "Hate speech self-identification"),
    (r"(?:all \w+ (?:should|must|deserve to|need to) (?:die|be killed|be eliminated))", "Genocidal language"),
]

# Default blocked topics, first match wins; matched as \b<topic>\b, case-insensitive.
DEFAULT_BLOCKED_TOPICS = [
    "competitor pricing",
    "internal roadmaps",
    "unreleased products",
    "employee salaries",
    "legal proceedings",
]

# Keyword routing of a processed prompt, first match wins (substring, lower-cased).
ROUTE_KEYWORDS = [
    ("returns", ["return", "refund"]),
    ("shipping", ["shipping", "deliver"]),
    ("pricing", ["price", "cost"]),
]
ROUTE_DEFAULT = "general"

# Reason texts and prefixes.
PII_REASON_PREFIX_MASK = "PII detected: "
PII_REASON_PREFIX_BLOCK = "PII blocked: "
SUITE_PREFIX_MASK = "PII masked: "
SUITE_PREFIX_BLOCK = "PII blocked: "
SUITE_PREFIX_INJECTION = "Injection: "
SUITE_ALL_PASSED = "All checks passed"
TOPIC_REASON_TEMPLATE = 'Output discusses blocked topic: "{topic}"'
JSON_INVALID_REASON = "Output is not valid JSON"
JSON_MISSING_PREFIX = "Missing required fields: "

# ---------------------------------------------------------------------------
# FIXED VALUES (end)
# ---------------------------------------------------------------------------

# Which pattern edges are certain to be word characters. Where an edge is
# surely a word character a one-sided ASCII look-around is equivalent to the
# ASCII word boundary and two to three times cheaper in Java (see dialect.py).
# Derived by reading each pattern: e.g. every credit_card match starts and
# ends on a digit, an email may start with '.' and end with '|'.
_PII_EDGES = {
    "credit_card": (True, True),
    "ssn": (True, True),
    "email": (False, False),
    "phone": (False, True),
    "api_key": (True, False),
    "aws_key": (True, True),
    "bitcoin": (True, True),
    "ip_address": (True, True),
}


@dataclass(frozen=True)
class PiiPattern:
    """One PII detector. ``lead_word``/``tail_word`` are optimisation hints;
    ``may_pad`` says a match can begin or end in whitespace (then it is
    trimmed, as specified); ``min_digits`` is the digit floor by type."""

    type: str
    label: str
    pattern: str
    flags: str = ""
    lead_word: bool = False
    tail_word: bool = False
    may_pad: bool = True
    min_digits: int | None = None
    # True when the pattern itself already guarantees ``min_digits`` digits,
    # so the floor is a no-op and can be skipped.
    floor_implied: bool = False
    # Cheap row-level checks that every match implies, all required, tried
    # before the regex: "digit" (some ASCII digit), "a|b" (one of the
    # literals), or a literal substring (case-sensitive byte search).
    requires: tuple[str, ...] = ()
    # A Java pattern of stretches in which no match can begin, or "". They
    # are consumed whole, so that a long one is read once and not again from
    # each of its characters. Every match holds ``anchor``, no stretch does.
    skip: str = ""
    anchor: str = ""


@dataclass(frozen=True)
class InjectionRule:
    type: str
    pattern: str
    reason: str
    # Every match contains all of these literal (case-sensitive,
    # non-letter) substrings; checked by byte search before the regex.
    needles: tuple[str, ...] = ()
    # The characters a match can start with (case-insensitive), or "" when
    # not worth stating; see ``first_char_guard``.
    first: str = ""
    # A Java pattern with the same answer in linear time, or "".
    java: str = ""


@dataclass(frozen=True)
class ToxicityRule:
    pattern: str
    reason: str
    first: str = ""


# First characters of the rules that open with an alternation, read off the
# patterns. Java's engine tries every alternative at every position; a
# look-ahead on this set is implied by the pattern (so it cannot change the
# leftmost match) and rejects most positions with one class test.
_INJECTION_FIRST = {3: "rspdot", 5: "`<[", 6: "jd", 7: "bruh", 8: "sap", 9: "rp"}
_TOXICITY_FIRST = {1: "his"}


def first_char_guard(first: str) -> str:
    """``(?=[...])`` for a set of possible first characters."""
    if not first:
        return ""
    cls = "".join("\\" + c if c in "[]\\^-" else c for c in first)
    return "(?=[" + cls + "])"


# Necessary conditions read off each pattern: the digit-based detectors need
# a digit (bitcoin needs a '1' or '3'), email an '@', the AWS key its fixed
# prefix, an IP address a dot, an API key a '_' or '-' separator. Only 7% of
# the test documents contain any digit, so most rows skip most regexes.
_PII_REQUIRES = {
    "credit_card": ("digit",),
    "ssn": ("digit",),
    "email": ("@",),
    "phone": ("digit",),
    "api_key": ("_|-",),
    "aws_key": ("AKIA",),
    "bitcoin": ("digit",),
    "ip_address": ("digit", "."),
}

#: Shortest run of address characters that is consumed whole.
LONG_RUN = 64


def email_skip(shortest: int = LONG_RUN) -> str:
    """Runs of the characters before an ``@`` that no ``@`` and domain follow.
    An address reaches from its first character to the ``@`` without a gap, so
    none begins in such a run. A run is taken from its start, or from the end
    of the match before."""
    pattern = next(p for t, _, p, _ in PII_PATTERN_TABLE if t == "email")
    local, rest = pattern.removeprefix("\\b").split("+@", 1)
    return f"(?:(?<!{local})|\\G){local}{{{shortest},}}+(?!@{to_java(rest)})"


_PII_SKIP = {"email": (email_skip(), "@")}

PII_PATTERNS: tuple[PiiPattern, ...] = tuple(
    PiiPattern(
        type=t,
        label=lbl,
        pattern=p,
        flags=f,
        lead_word=_PII_EDGES[t][0],
        tail_word=_PII_EDGES[t][1],
        # No shipped pattern can begin or end in whitespace.
        may_pad=False,
        min_digits=PII_MIN_DIGITS.get(t),
        # 13..19 digit repetitions and 3+3+4 digits already meet the floors.
        floor_implied=True,
        requires=_PII_REQUIRES.get(t, ()),
        skip=_PII_SKIP.get(t, ("", ""))[0],
        anchor=_PII_SKIP.get(t, ("", ""))[1],
    )
    for (t, lbl, p, f) in PII_PATTERN_TABLE
)

# The brace template rule needs both braces, and most text has none. Where it
# matches at all it matches from the first "{", the first "system" after that
# and the first "prompt" after that, so one pass without backtracking decides.
_INJECTION_NEEDLES = {4: ("{", "}")}
_INJECTION_JAVA = {4: r"(?is)^[^{]*+\{(?>.*?system)(?>.*?prompt).*?\}"}

INJECTION_RULES: tuple[InjectionRule, ...] = tuple(
    InjectionRule(type=t, pattern=p, reason=r, needles=_INJECTION_NEEDLES.get(i, ()), first=_INJECTION_FIRST.get(i, ""),
                  java=_INJECTION_JAVA.get(i, ""))
    for i, (t, p, r) in enumerate(INJECTION_RULE_TABLE)
)

TOXICITY_RULES: tuple[ToxicityRule, ...] = tuple(
    ToxicityRule(pattern=p, reason=r, first=_TOXICITY_FIRST.get(i, "")) for i, (p, r) in enumerate(TOXICITY_RULE_TABLE)
)


def custom_pii_pattern(type: str, label: str, pattern: str, flags: str = "") -> PiiPattern:
    """A user-supplied detector (U1). Nothing is assumed about its edges, so
    it gets the general ASCII boundary, trimming, and the digit floor of its
    type name."""
    return PiiPattern(
        type=type,
        label=label,
        pattern=pattern,
        flags=flags,
        may_pad=True,
        min_digits=PII_MIN_DIGITS.get(type),
        floor_implied=False,
    )


def custom_injection_rule(type: str, pattern: str, reason: str) -> InjectionRule:
    """A user-supplied injection rule (U2), case-insensitive like the rest."""
    return InjectionRule(type=type, pattern=pattern, reason=reason)


@dataclass(frozen=True)
class RouteRule:
    intent: str
    keywords: tuple[str, ...] = field(default_factory=tuple)


ROUTES: tuple[RouteRule, ...] = tuple(RouteRule(i, tuple(k)) for i, k in ROUTE_KEYWORDS)
