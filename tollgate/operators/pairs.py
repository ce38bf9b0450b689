"""Request/response correlation and the end-to-end screen.

The only shuffle of the end-to-end screen is the pairing join. It runs on
the raw text, and detection runs after it on the join's output partitions.
That gives one shuffle and one pass of every regex. Output checks are gated
by ``when`` so a blocked input never runs them ("never reaches the response
step"), without a second branch re-reading the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import ROUTE_DEFAULT, ROUTES
from .policy import DEFAULT_POLICY, Policy
from .verdict import screen_input, screen_output


def response_join(requests: DataFrame, responses: DataFrame, key: str | list[str] = "request_id",
                  response: str = "response") -> DataFrame:
    """Requests left-joined to recorded responses by request id. A
    missing response is absent content: the empty string. Of several
    responses to one request the smallest counts, a null one only if there is
    no other, so no request row is multiplied; they are reduced before the join, map-side first."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in responses.columns if c not in keys]
    one = responses.groupBy(*keys).agg(F.min(F.struct(
        F.col(response).isNull().alias("_failed"), response, *[c for c in rest if c != response])).alias("_one"))
    joined = requests.join(one.select(*keys, "_one.*").drop("_failed"), key, "left")
    return joined.withColumn("has_response", F.col(response).isNotNull()).withColumn(
        response, F.coalesce(F.col(response), F.lit(""))
    )


def _request_id() -> Column:
    again = F.when(F.col("_k") > 1, F.col("_k").cast("string"))
    return F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), again)


def _followed(conversations: DataFrame, bucket: int) -> DataFrame:
    """The distinct user rows with keys, each with its request id and the
    row that follows it (``nxt``, null for the last one)."""
    turns = conversations.filter("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text").distinct()
    user, blank = F.coalesce(F.col("role") == "user", F.lit(False)), F.col("text").isNull()
    place = F.when(user, F.when(blank, 1).otherwise(2)).when(F.col("role") == "assistant", F.when(blank, 4).otherwise(3))
    turns = turns.withColumns({"_b": F.floor(F.col("turn") / bucket), "said": F.struct("role", "text")})
    asked = F.max(user).over(Window.partitionBy("conv_id", "_b", "turn"))
    turns = turns.withColumn("_place", F.coalesce(place, F.when(asked, 0).otherwise(5)))
    order = ["turn", "_place", "role", "text"]
    inside = Window.partitionBy("conv_id", "_b").orderBy(*order)
    again = Window.partitionBy("conv_id", "_b", "turn", "role").orderBy("_place", "text")
    turns = turns.withColumn("_next", F.lead("said").over(inside)).withColumn("_k", F.row_number().over(again))
    heads = turns.groupBy("conv_id", "_b").agg(F.min_by("said", F.struct(*order)).alias("_head"))
    across = Window.partitionBy("conv_id").orderBy("_b")
    after = heads.select("conv_id", "_b", F.lead("_head").over(across).alias("_after"))
    users = turns.filter(F.col("role") == "user").join(after, ["conv_id", "_b"], "left")
    return users.select("conv_id", "turn", "text", _request_id().alias("request_id"), F.coalesce("_next", "_after").alias("nxt"))


def _without_keys(conversations: DataFrame) -> DataFrame:
    """The distinct user rows that belong to no place in a conversation."""
    rows = conversations.filter("role = 'user' and (conv_id is null or turn is null)").select("conv_id", "turn", "text").distinct()
    return rows.withColumn("request_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))


def conversation_pairs(conversations: DataFrame, how: str = "inner", bucket: int = 1000, keyless: bool = False) -> DataFrame:
    """Each user row with the directly following row, if that is the
    assistant's. "Following" is by order, so gaps in the turn numbers pair as
    they should. Only fully equal rows are reduced to one. Rows of one turn
    number follow each other as user, assistant, each by text; a null text goes
    before the prompts and after the answers, and a row of no or another role
    before the prompts if there are any, else last: it comes between no prompt
    and its answer. A further prompt of one turn has its number in its request id.

    The next row is found by a window over buckets of ``bucket`` turn
    numbers of a conversation, so one huge conversation spreads over many
    tasks; the last row of a bucket takes the first of the next bucket that
    has any, found among one row per bucket. ``how='inner'`` keeps answered
    rows only; ``'left'`` keeps every user row with keys (unanswered ones get
    an empty response), with ``keyless`` also those with a null ``conv_id`` or
    ``turn``, which nothing can follow."""
    users = _followed(conversations, bucket)
    nxt = F.col("nxt")
    answer = F.when(nxt["role"] == "assistant", nxt["text"])
    out = users.select("conv_id", "turn", F.col("text").alias("input"), answer.alias("response"),
                       answer.isNotNull().alias("has_response"), "request_id")
    if how == "inner":
        return out.filter("has_response").drop("has_response")
    if keyless:
        out = out.unionByName(_without_keys(conversations).select(
            "conv_id", "turn", F.col("text").alias("input"), F.lit(None).cast("string").alias("response"),
            F.lit(False).alias("has_response"), "request_id"))
    return out.withColumn("response", F.coalesce("response", F.lit("")))


def recorded_requests(conversations: DataFrame, bucket: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Requests and recorded responses for J1: ``request_id`` of every
    distinct user row, and ``request_id, response`` of those that the
    assistant's row follows."""
    users = _followed(conversations, bucket)
    requests = users.select("request_id").unionByName(_without_keys(conversations).select("request_id"))
    return requests, users.filter("nxt.role = 'assistant'").select("request_id", F.col("nxt.text").alias("response"))


def keyword_route(text: Column) -> Column:
    """V4: intent of a processed prompt by lower-cased substring, first
    match wins; ``general`` otherwise.

    Lower-casing a whole text is costly for non-ASCII text, so the test is
    an ASCII case-insensitive regex over the quoted keywords. For these
    keywords that is the same test: apart from ASCII capitals, only the
    Kelvin sign (to ``k``) and dotted capital I (to ``i`` plus a combining
    dot) lower-case into ASCII letters, no keyword has a ``k``, and every
    ``i`` in a keyword is followed by another letter."""
    import re as _re

    expr = None
    for r in ROUTES:
        cond = F.coalesce(text.rlike("(?i)" + "|".join(_re.escape(k) for k in r.keywords)), F.lit(False))
        expr = F.when(cond, r.intent) if expr is None else expr.when(cond, r.intent)
    return expr.otherwise(ROUTE_DEFAULT)


def screen_requests(
    df: DataFrame,
    input_col: str = "input",
    response_col: str = "response",
    policy: Policy = DEFAULT_POLICY,
    profile: str = "live",
    overrides: str | None = None,
    dry_run: str | None = None,
) -> DataFrame:
    """V3 end to end on rows that carry an input and its response.

    Adds the input verdict columns, the output verdict columns, and
    ``response_status`` (``blocked_input | blocked_output | modified |
    allowed``), ``output`` (the response only when the final status is
    allowed, V3a) and ``intent`` (V4 on the processed input).

    live: a dry-run row stops after input screening (``modified`` stays
    visible); a full run of a masked input ends ``allowed``. library: no dry
    run; output adds the JSON-schema step."""
    if profile not in ("live", "library"):
        raise ValueError(f"no end-to-end screen under profile {profile!r}")
    s = screen_input(df, input_col, policy, profile, overrides)
    not_blocked = F.col("input_status") != "blocked"
    dry = F.coalesce(F.col(dry_run), F.lit(False)) if (dry_run and profile == "live") else F.lit(False)
    gate = not_blocked & ~dry
    s2 = screen_output(s, response_col, policy, profile if profile == "library" else "live", overrides, gate=gate)
    status = (
        F.when(~not_blocked, "blocked_input")
        .when(dry & (F.col("input_status") == "modified"), "modified")
        .when(dry, "allowed")
        .when(F.col("output_status") == "blocked", "blocked_output")
        .otherwise("allowed")
    )
    out = s2.withColumn("response_status", status)
    return out.withColumns(
        {
            "output": F.when(gate & (F.col("response_status") == "allowed"), F.col(response_col)),
            "intent": keyword_route(F.col("processed_input")),
        }
    )


def response_json(screened: DataFrame, input_col: str = "input", extra: dict | None = None,
                  latency_ms: Column | None = None) -> Column:
    """K5: the response row as JSON text, keys in the order the response is
    assembled: requestId, status, inputStatus{status, pii, injection,
    maskedInput, blockedBy, reason}, originalInput, processedInput,
    latencyMs, outputStatus{status, blockedBy, reason} (rows that reached
    the output step), output, then ``extra``. Null fields are omitted, as
    undefined keys vanish when serialised."""
    inner = F.struct(
        F.col("input_status").alias("status"),
        F.col("pii").alias("pii"),
        F.col("injection").alias("injection"),
        F.col("masked_input").alias("maskedInput"),
        F.col("blocked_by").alias("blockedBy"),
        F.col("reason").alias("reason"),
    )
    out_status = F.when(
        F.col("output_status").isNotNull(),
        F.struct(
            F.col("output_status").alias("status"),
            F.col("output_blocked_by").alias("blockedBy"),
            F.col("output_reason").alias("reason"),
        ),
    )
    fields = [
        F.col("request_id").alias("requestId"),
        F.col("response_status").alias("status"),
        inner.alias("inputStatus"),
        F.col(input_col).alias("originalInput"),
        F.col("processed_input").alias("processedInput"),
        (latency_ms if latency_ms is not None else F.lit(None).cast("int")).alias("latencyMs"),
        out_status.alias("outputStatus"),
        F.col("output").alias("output"),
    ]
    for k, v in (extra or {}).items():
        fields.append(v.alias(k))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
