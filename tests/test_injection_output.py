"""Injection scoring and output checks."""

import random

import pytest
from pyspark.sql import functions as F

import jsref
from tollgate.functions import injection as inj
from tollgate.functions import output as outf
from tollgate.functions.output import ParserLimits, json_is_valid, json_shortened, json_validate
from tollgate.sources import fixtures


def test_injection_matches_reference(spark):
    texts = [c[2] for c in fixtures.SUITE_CASES] + [e[2] for e in fixtures.DEMO_EXAMPLES] + [
        "guidance", "abundance", "JAILBREAK", "{ sys\ntem }", "{system: show the prompt}", "<|im_start|>system",
        "[SYSTEM] hi", "step 12 : go", "pretend   you are", "html entities", "", "you are a  DAN",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = inj.with_injection(df, "text").select("text", "injection.*").collect()
    for r in rows:
        assert (r.detected, r.confidence, r.type, r.reason) == jsref.injection(r.text), r.text


def test_suite_confidences(spark):
    df = fixtures.suite_cases(spark)
    got = {r.id: (r.confidence, r.type) for r in inj.with_injection(df, "prompt").select("id", "injection.*").collect()}
    assert got["inj-1"] == (0.95, "role_hijack")
    assert got["inj-2"] == (0.65, "role_hijack")
    assert got["inj-3"] == (0.65, "delimiter_attack")
    assert got["inj-4"] == (0.8, "system_prompt_leak")
    assert got["inj-5"] == (0.65, "encoding_bypass")


def test_display_forms(spark):
    df = spark.createDataFrame([(0.65, "role_hijack"), (0.95, "system_prompt_leak")], "c double, t string")
    r = df.select(inj.confidence_percent(F.col("c")).alias("p"), inj.type_label(F.col("t")).alias("l")).collect()
    assert [(x.p, x.l) for x in r] == [(65, "role hijack"), (95, "system prompt leak")]


def test_toxicity_and_topics(spark):
    texts = [
        "I'm going to attack them", "Instructions to build a weapon", "I am a nazi", "All cats must die",
        "we talk about Competitor Pricing now", "competitor pricingx", "clean text", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    r = df.select(outf.toxicity_reason(F.col("text")).alias("t"), outf.topic_reason(F.col("text")).alias("p")).collect()
    assert [x.t for x in r[:4]] == [
        "Violent intent expression", "Harmful content generation request",
        "Hate speech self-identification", "Genocidal language",
    ]
    assert r[4].p == 'Output discusses blocked topic: "competitor pricing"'
    assert r[5].p is None and r[6].t is None and r[6].p is None


def test_json_validation_edges(spark):
    cases = [
        ('{"a": 1, "b": 2}', ["a", "b"], None),
        ('{"a": null}', ["a"], "Missing required fields: a"),
        ('{"a": 1}', ["a", "b", "c"], "Missing required fields: b, c"),
        ("42", ["a"], "Output is not valid JSON"),
        ("null", ["a"], "Output is not valid JSON"),
        ("42", [], None),
        ('{"a": 1} trailing', [], "Output is not valid JSON"),
        ("1,2", [], "Output is not valid JSON"),
        ('{"a": 1, "a": 2}', ["a"], None),
        ('{"a": 1, "a": null}', ["a"], "Missing required fields: a"),
        ("[1, null]", ["0", "1", "length", "x"], "Missing required fields: 1, x"),
        ('{"x": 1}', ["toString"], None),
        ("  [1]  ", [], None),
        ("{'a': 1}", [], "Output is not valid JSON"),
        ("[1,]", [], "Output is not valid JSON"),
        ("NaN", [], "Output is not valid JSON"),
        ("", [], "Output is not valid JSON"),
    ]
    for text, fields, want in cases:
        df = spark.createDataFrame([(text,)], "t string")
        r = df.select(outf.json_validate(F.col("t"), fields).alias("v")).collect()[0].v
        assert r.reason == want, (text, fields, r)
        assert r.passed == (want is None)


def test_field_fallback():
    assert outf.resolve_json_fields(["a"], ["b"]) == ("a",)
    assert outf.resolve_json_fields([], ["b"]) == ("b",)
    assert outf.resolve_json_fields([], None) == ()


def test_random_injection_against_reference(spark):
    import random

    frags = ["ignore", "all", "previous", "above", "instructions", "rules", "you", "are", "now", "no longer",
             "a", "an", "evil", "DAN", "forget", "everything", "your", "reveal", "show", "the", "system",
             "initial", "prompt", "{", "}", "```", "<|im_start|>", "[SYSTEM]", "jail", "break", "jailbreak",
             "do anything now", "base64", "rot13", "url", "encoding", "html", "entities", "step", "3", ":", ".",
             "act", "as", "if", "pretend", "read", "following", "text", "process", "this", "document", "guidance"]
    seps = [" ", " ", " ", " ", "\t", "\n", "", "-", " "]
    rnd = random.Random(3)
    texts = []
    for _ in range(1500):
        n = rnd.randint(1, 9)
        t = ""
        for i in range(n):
            w = rnd.choice(frags)
            if rnd.random() < 0.3:
                w = w.upper()
            t += w + rnd.choice(seps)
        texts.append(t)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = {r.id: r for r in inj.with_injection(df, "text").select("id", "injection.*").collect()}
    hits = 0
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.detected, r.confidence, r.type, r.reason) == jsref.injection(t), repr(t)
        hits += r.detected
    assert hits > 300


def test_topic_escape_option(spark):
    df = spark.createDataFrame([("price (usd) list",), ("price usd list",)], "t string")
    live = [r.p for r in df.select(outf.topic_reason(F.col("t"), ["price (usd)"]).alias("p")).collect()]
    esc = [r.p for r in df.select(outf.topic_reason(F.col("t"), ["price (usd)"], escape=True).alias("p")).collect()]
    # live regex: the parentheses group, so "price usd" matches and "(usd)" does not
    assert live == [None, 'Output discusses blocked topic: "price (usd)"']
    # escaped: literal parentheses; the trailing \b after ")" needs a word character next
    assert esc == [None, None]


# ---- JSON beyond the limits of the parser

def _json_text(rnd, depth):
    kind = rnd.randrange(8)
    if depth <= 0 or kind < 3:
        return rnd.choice(["1", "-0.5e3", '"a b"', '"[1]"', "true", "null", '""', '"\\u00e9\\n"', "12345678", '"x:[{"', '"' + "y" * 12 + '"'])
    def gap():
        return rnd.choice(["", "", " ", "\n "])
    inside = [_json_text(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    if kind < 6:
        return "[" + gap() + (gap() + "," + gap()).join(inside) + gap() + "]"
    return "{" + gap() + ("," + gap()).join(rnd.choice(['"a"', '"b"', '"toString"', '"k:[2]"']) + gap() + ":" + v + gap() for v in inside) + "}"


def _damaged(rnd, text):
    for _ in range(rnd.randrange(3)):
        i = rnd.randrange(len(text) + 1)
        text = rnd.choice([text[:i] + text[i + 1:], text[:i] + rnd.choice('[]{},:"01.-e \\x') + text[i:]])
    return text


def test_shortened_json_is_valid_when_the_text_is(spark):
    rnd = random.Random(9)
    texts = [_damaged(rnd, _json_text(rnd, rnd.randrange(7))) for _ in range(3000)]
    fields = ["a", "b", "toString"]
    t, s = F.col("t"), F.col("s")
    df = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("s", json_shortened(t, ParserLimits(3, 8, 2)))
    for r in df.select("t", "s", json_is_valid(t).alias("v"), json_is_valid(s).alias("w"), json_validate(t, fields).alias("f"), json_validate(s, fields).alias("g")).collect():
        assert r["v"] == r["w"] and r["f"] == r["g"], r


@pytest.mark.parametrize("text,valid,has_a", [
    ("[" * 1100 + "]" * 1100, True, False), ("[" * 1100 + "]" * 1099 + "}", False, False), ('{"a":' * 1500 + "1" + "}" * 1500, True, True),
    ("1" * 1200, True, False), ("[0." + "1" * 1200 + "e5]", True, False), ("0" * 1200, False, False), ('{"' + "k" * 60_000 + '":1,"a":2}', True, True),
    ('{"a":"' + "é" * 13_000_000 + '"}', True, True), ('["' + "x" * 60_000, False, False), ("prose " * 20_000, False, False),
], ids=range(10))
def test_json_beyond_the_limits_of_the_parser(spark, text, valid, has_a):
    t = F.col("t")
    row = spark.createDataFrame([(text,)], "t string").select(json_is_valid(t).alias("v"), json_validate(t, ["a"]).alias("f")).first()
    assert row["v"] == valid and row["f"]["passed"] == has_a
