"""PII detection with exact positions, and masking.

All JVM-side column expressions; no Python UDF.

Positions without a UDF: for one pattern ``regexp_extract_all`` yields the
matches m0..m(n-1) and ``split`` on the same pattern yields the n+1 gaps
g0..gn around them (both walk ``Matcher.find`` identically). The start of
m(j) is ``len(g0)+len(m0)+...+len(gj)``, a running sum folded with
``aggregate``. Offsets are in code points (Spark and DuckDB ``length``).

Cost control (scale): the detection is staged over three projections so that
every regex runs once per row: (1) matches per pattern behind a cheap
literal pre-filter, (2) the split only where something matched, (3) spans.
A filter on a derived column would be pushed below the projection and run
the regex again, so callers materialise or filter late.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dialect
from .rules import PII_PATTERNS, PII_REASON_PREFIX_BLOCK, PII_REASON_PREFIX_MASK, PiiPattern

SPAN_TYPE = "struct<type:string,label:string,value:string,start:int,end:int>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"


def ident(name: str) -> str:
    """A column name as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def sql_str(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _plain(p: PiiPattern) -> bool:
    """Detectors whose spans can be built by the SQL-text fold: no trim, no
    digit floor to apply. (The shipped ones; custom ones take the Column
    path.)"""
    return not p.may_pad and (p.min_digits is None or p.floor_implied)


# JavaScript String.prototype.trim() whitespace: \s plus line terminators.
_JS_TRIM = r"^[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+|[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+$"


def java_pattern(p: PiiPattern) -> str:
    return dialect.to_java(p.pattern, p.flags, p.lead_word, p.tail_word)


def search_pattern(p: PiiPattern) -> str:
    """What is searched for: the matches, and the stretches to step over."""
    return f"(?:{java_pattern(p)}|{p.skip})" if p.skip else java_pattern(p)


def _without_skipped(p: PiiPattern, m: str, g: str) -> tuple[Column, Column]:
    """Matches and gaps once the stretches stepped over are part of the gaps."""
    anchor = sql_str(p.anchor)
    kept = f"filter(sequence(0, size({m}) - 1), _i -> instr(get({m}, _i), {anchor}) > 0)"
    ends = f"concat(array(-1), {kept}, array(size({m})))"
    # the text after match _e of the list and before the next kept one
    before_next = f"transform(filter(sequence(_e + 1, get(_r.ends, _k + 1)), _i -> _i < get(_r.ends, _k + 1)), _i -> concat(get({g}, _i), get({m}, _i)))"
    gap = f"concat(array_join({before_next}, ''), get({g}, get(_r.ends, _k + 1)))"
    gaps = f"get(transform(array(named_struct('ends', {ends})), _r -> transform(slice(_r.ends, 1, size(_r.ends) - 1), (_e, _k) -> {gap})), 0)"
    stepped = f"exists({m}, _s -> instr(_s, {anchor}) = 0)"
    matches = f"filter({m}, _s -> instr(_s, {anchor}) > 0)"
    return F.expr(f"CASE WHEN {stepped} THEN {matches} ELSE {m} END"), F.expr(f"CASE WHEN {stepped} THEN {gaps} ELSE {g} END")


def re2_pattern(p: PiiPattern) -> str:
    return dialect.to_re2(p.pattern, p.flags)


def _check(text: Column, token: str) -> Column:
    if token == "digit":
        return text.rlike("[0-9]")
    if "|" in token:
        alts = [F.instr(text, a) > 0 for a in token.split("|")]
        out = alts[0]
        for a in alts[1:]:
            out = out | a
        return out
    return F.instr(text, token) > 0


def _gates(text: Column, pats: Sequence[PiiPattern]) -> dict[str, Column]:
    """One column per distinct cheap check used by the patterns."""
    tokens = []
    for p in pats:
        for tok in p.requires:
            if tok not in tokens:
                tokens.append(tok)
    return {f"__gate{i}": _check(text, tok) for i, tok in enumerate(tokens)}, tokens


def fence(c: Column) -> Column:
    """Mark a computed column as an optimisation fence.

    Spark pushes a filter through a projection only when every output of the
    projection is deterministic; it would otherwise substitute the span
    expression into a later filter on a verdict (or the filter it infers
    from an ``explode``) and run every regex twice, possibly before the
    repartition that spreads the work. ``spark_partition_id()`` is
    nondeterministic by definition and costs nothing, so the guarded column
    is computed exactly once, where it is defined. Filters on the input
    belong before screening (there they still reach the scan)."""
    return F.when(F.spark_partition_id() >= F.lit(0), c)


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def _scan_sql(values: str, combine: str, n: str) -> str:
    """Running combination over an array of ``n`` > 0 integers, as SQL text:
    at step k each element takes in the one 2^k places before it (``_x`` and
    ``_o`` in ``combine``), so n log n elements are touched and none is copied
    more than once a step."""
    other = "coalesce(get(_t, _i - shiftleft(1, _k)), 0)"
    return (f"aggregate(sequence(0, cast(floor(log2({n})) as int)), {values}, "
            f"(_t, _k) -> transform(_t, (_x, _i) -> {combine.replace('_o', other)}))")


def _spans_sql(p: PiiPattern, m: str, g: str) -> str:
    """Spans of one detector as SQL text: the ends of the matches are running
    sums of gap and match lengths, bound once (``_ends``) for the lambda that
    builds the spans."""
    steps = f"transform({m}, (_v, _i) -> length(get({g}, _i)) + length(_v))"
    ends = _scan_sql(steps, "_x + _o", f"size({m})")
    # a custom detector's value is the trimmed match; its start stays the raw one
    val = f"regexp_replace(_v, {sql_str(_JS_TRIM)}, '')" if p.may_pad else "_v"
    start = "(get(_ends, _j) - length(_v))"
    span = (f"named_struct('type', {sql_str(p.type)}, 'label', {sql_str(p.label)}, 'value', {val}, "
            f"'start', cast({start} as int), 'end', cast({start} + length({val}) as int))")
    body = f"get(transform(array({ends}), _ends -> transform({m}, (_v, _j) -> {span})), 0)"
    if p.min_digits is not None and not p.floor_implied:
        body = f"filter({body}, _f -> length(regexp_replace(_f.value, '[^0-9]', '')) >= {int(p.min_digits)})"
    return body


def with_pii(
    df: DataFrame,
    text: str = "text",
    out: str = "pii",
    patterns: Sequence[PiiPattern] = PII_PATTERNS,
    enabled: Column | None = None,
    parts: str | None = None,
) -> DataFrame:
    """Add ``out``: the ordered span list ``array<struct<type,label,value,
    start,end>>`` over all patterns, pattern order first, then position.

    ``enabled`` (optional boolean column) turns detection off per row, as
    the library profile does for a disabled PII rule; the regexes are not
    run on such rows.

    ``parts`` (optional column name) also keeps, for the linear-time mask,
    every span sorted by start with the text before and after it within its
    own pattern's split (``pii_mask(..., parts=...)``); only for detectors
    whose spans are the raw matches (no trim, no digit floor)."""
    t = F.col(text)
    pats = list(patterns)
    gate_cols, tokens = _gates(t, pats)
    df0 = df.withColumns(gate_cols) if gate_cols else df
    m_cols, g_cols = [], []
    stage1 = {}
    for i, p in enumerate(pats):
        jp = search_pattern(p)
        m = F.regexp_extract_all(t, F.lit(jp), 0)
        gate = None
        for tok in p.requires:
            c = F.col(f"__gate{tokens.index(tok)}")
            gate = c if gate is None else (gate & c)
        if enabled is not None:
            gate = enabled if gate is None else (enabled & gate)
        if gate is not None:
            m = F.when(gate, m).otherwise(_empty_strings())
        name = f"__pm{i}"
        stage1[name] = F.coalesce(m, _empty_strings())
        m_cols.append(name)
    df1 = df0.withColumns(stage1).drop(*gate_cols.keys())
    stage2 = {}
    for i, p in enumerate(pats):
        name = f"__pg{i}"
        # fenced: read inside lambdas below, so it must never be inlined
        stage2[name] = fence(F.when(
            F.size(F.col(m_cols[i])) > 0, F.split(t, search_pattern(p), -1)
        ))
        g_cols.append(name)
    df2 = df1.withColumns(stage2)
    cleaned = {}
    for i, p in enumerate(pats):
        if p.skip:
            cleaned[m_cols[i]], cleaned[g_cols[i]] = map(fence, _without_skipped(p, ident(m_cols[i]), ident(g_cols[i])))
    if cleaned:
        df2 = df2.withColumns(cleaned)
    folds = [
        F.expr(f"CASE WHEN size({ident(m_cols[i])}) > 0 THEN {_spans_sql(p, ident(m_cols[i]), ident(g_cols[i]))} "
               f"ELSE cast(array() as {SPANS_TYPE}) END")
        for i, p in enumerate(pats)
    ]
    t_cols: list[str] = []
    empty = F.array().cast(SPANS_TYPE)
    if parts is not None and all(_plain(p) for p in pats):
        # per-pattern spans materialised once, then both outputs read them
        s_cols = [f"__ps{i}" for i in range(len(pats))]
        df3 = df2.withColumns({
            s_cols[i]: fence(F.when(F.size(F.col(m_cols[i])) > 0, folds[i].cast(SPANS_TYPE)).otherwise(empty))
            for i in range(len(pats))
        })
        spans = F.concat(*[F.col(c) for c in s_cols]) if len(s_cols) > 1 else F.col(s_cols[0])
        part_lists = ", ".join(
            f"transform({ident(s_cols[i])}, (_s, _j) -> named_struct('start', _s.start, 'end', _s.end, "
            f"'label', _s.label, 'pidx', {i}, 'value', _s.value, 'pre', get({ident(g_cols[i])}, _j), "
            f"'post', get({ident(g_cols[i])}, _j + 1)))"
            for i in range(len(pats))
        )
        ordered = F.expr(
            f"array_sort(concat({part_lists}), (_l, _r) -> CASE WHEN _l.start < _r.start THEN -1 "
            f"WHEN _l.start > _r.start THEN 1 WHEN _l.pidx < _r.pidx THEN -1 WHEN _l.pidx > _r.pidx THEN 1 ELSE 0 END)"
        )
        return df3.withColumns({out: fence(spans), parts: fence(ordered)}).drop(*m_cols, *g_cols, *s_cols, *t_cols)
    spans = F.concat(*folds) if len(folds) > 1 else folds[0]
    # Most rows match nothing: skip the (interpreted) span building there.
    any_match = F.expr(" OR ".join(f"size({ident(c)}) > 0" for c in m_cols))
    spans = F.when(any_match, spans.cast(SPANS_TYPE)).otherwise(empty)
    out_df = df2.withColumn(out, fence(spans)).drop(*m_cols, *g_cols, *t_cols)
    if parts is not None:  # custom detectors: no linear path, the fold masks
        out_df = out_df.withColumn(parts, F.lit(None))
    return out_df


_MASK_ORDER = {
    "reference": "CASE WHEN _l.start > _r.start THEN -1 WHEN _l.start < _r.start THEN 1 "
                 "WHEN _l.pos < _r.pos THEN -1 WHEN _l.pos > _r.pos THEN 1 ELSE 0 END",
    "merged": "CASE WHEN _l.start < _r.start THEN -1 WHEN _l.start > _r.start THEN 1 "
              "WHEN _l.pos < _r.pos THEN -1 WHEN _l.pos > _r.pos THEN 1 ELSE 0 END",
}


def _mask_sql(text: str, spans: str, mode: str) -> str:
    if mode not in _MASK_ORDER:
        raise ValueError(f"unknown mask mode {mode!r}")
    idx = (f"transform({spans}, (_s, _i) -> named_struct('start', _s.start, 'end', _s.end, "
           f"'label', _s.label, 'pos', _i))")
    ordered = f"array_sort({idx}, (_l, _r) -> {_MASK_ORDER[mode]})"
    if mode == "merged":
        ordered = (f"aggregate({ordered}, named_struct('end', -1, 'keep', slice({ordered}, 1, 0)), "
                   f"(_k, _y) -> CASE WHEN _y.start >= _k.end THEN named_struct('end', _y.end, "
                   f"'keep', concat(array(_y), _k.keep)) ELSE _k END, _k -> _k.keep)")
    fold = (f"aggregate({ordered}, {text}, (_acc, _m) -> concat(substr(_acc, 1, _m.start), '[', _m.label, ']', "
            f"substr(_acc, _m.end + 1)))")
    return f"CASE WHEN size({spans}) > 0 THEN {fold} ELSE {text} END"


def with_mask(df: DataFrame, text: str, spans: str, parts: str, out: str,
              when: Column | None = None) -> DataFrame:
    """The reference mask in time linear in the text (plus n log n in the
    spans), the exact right-to-left fold where that cannot be.

    Spans (``parts``: sorted by start, with their values and the text
    before/after them within their own pattern's split) fall into runs of
    overlapping or nested spans: a run ends where a span starts at or after
    the largest end so far. Each run is folded right to left, exactly as
    specified, on its own small string -- the run's text plus the text up to
    the next run -- and the results are joined after the text before the first
    span. When a cut in a run would reach past its local string (a label much
    shorter than an overlap), the row takes the whole-text fold of
    ``pii_mask``. ``when`` limits the work to rows that need a mask (others get
    null)."""
    P, S, T = ident(parts), ident(spans), ident(text)
    gate = when if when is not None else F.lit(True)
    n = f"size({P})"
    some = gate & F.expr(f"{P} IS NOT NULL AND {n} > 0")
    far = _scan_sql(f"transform({P}, _y -> _y.end)", "greatest(_x, _o)", n)
    starts = f"filter(sequence(0, {n} - 1), _k -> _k = 0 OR get({P}, _k).start >= get(`__m_far`, _k - 1))"
    st0 = df.withColumn("__m_far", fence(F.when(some, F.expr(far))))
    st1 = st0.withColumn("__m_gs", fence(F.when(some, F.expr(starts))))
    # one run: slice of parts, its local string, its right-to-left fold
    run = (
        "transform(`__m_gs`, (_k0, _gi) -> named_struct('k0', _k0, "
        f"'k1', coalesce(get(`__m_gs`, _gi + 1), {n})))"
    )
    local = (
        f"transform({run}, _g -> named_struct('sp', slice({P}, _g.k0 + 1, _g.k1 - _g.k0), 'k1', _g.k1, 'last', "
        f"array_max(transform(slice({P}, _g.k0 + 1, _g.k1 - _g.k0), _y -> named_struct('end', _y.end, 'post', _y.post)))))"
    )
    folded = (
        f"transform({local}, _r -> aggregate("
        f"array_sort(_r.sp, (_l, _q) -> CASE WHEN _l.start > _q.start THEN -1 WHEN _l.start < _q.start THEN 1 "
        f"WHEN _l.pidx < _q.pidx THEN -1 WHEN _l.pidx > _q.pidx THEN 1 ELSE 0 END), "
        # local string: the run's text (values chained past the previous end) plus the gap to the next run
        f"named_struct('s', concat("
        f"aggregate(slice(_r.sp, 2, size(_r.sp)), named_struct('t', get(_r.sp, 0).value, 'e', get(_r.sp, 0).end), "
        f"(_a, _y) -> CASE WHEN _y.end <= _a.e THEN _a ELSE "
        f"named_struct('t', concat(_a.t, substr(_y.value, _a.e - _y.start + 1)), 'e', _y.end) END, _a -> _a.t), "
        f"CASE WHEN _r.k1 = {n} THEN _r.last.post "
        f"ELSE substr(_r.last.post, 1, get({P}, _r.k1).start - _r.last.end) END), "
        f"'a', get(_r.sp, 0).start, 'ovf', false), "
        f"(_c, _m) -> named_struct('s', concat(substr(_c.s, 1, _m.start - _c.a), '[', _m.label, ']', "
        f"substr(_c.s, _m.end - _c.a + 1)), 'a', _c.a, 'ovf', _c.ovf OR (_m.end - _c.a > length(_c.s)))))"
    )
    st2 = st1.withColumn("__m_runs", fence(F.when(some, F.expr(folded))))
    linear = f"concat(get({P}, 0).pre, array_join(transform(`__m_runs`, _z -> _z.s), ''))"
    exact = _mask_sql(T, S, "reference")
    masked = (
        f"CASE WHEN size({S}) = 0 THEN {T} "
        f"WHEN `__m_runs` IS NOT NULL AND NOT exists(`__m_runs`, _z -> _z.ovf) THEN {linear} "
        f"ELSE {exact} END"
    )
    return st2.withColumn(out, F.when(gate, F.expr(masked))).drop("__m_far", "__m_gs", "__m_runs")


def pii_mask(text: Column | str, spans: Column | str, mode: str = "reference") -> Column:
    """Replace spans by ``[label]``.

    ``reference``: apply spans right to left by start (stable: equal starts in
    list order) using the original offsets on the already edited string, so
    overlapping spans corrupt each other exactly as specified (a bare 16-digit
    card also matching phone gives ``[Credit Card Number]]``).
    ``merged``: keep non-overlapping spans (earliest start, then list order)
    and replace those only. Column names (strings) take the SQL-text path."""
    if isinstance(text, str) and isinstance(spans, str):
        return F.expr(_mask_sql(ident(text), ident(spans), mode))
    text = F.col(text) if isinstance(text, str) else text
    spans = F.col(spans) if isinstance(spans, str) else spans
    indexed = F.transform(
        spans,
        lambda s, i: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"),
            i.alias("pos"),
        ),
    )
    if mode == "reference":
        ordered = F.array_sort(
            indexed,
            lambda a, b: F.when(a["start"] > b["start"], -1)
            .when(a["start"] < b["start"], 1)
            .when(a["pos"] < b["pos"], -1)
            .when(a["pos"] > b["pos"], 1)
            .otherwise(0),
        )
    elif mode == "merged":
        asc = F.array_sort(
            indexed,
            lambda a, b: F.when(a["start"] < b["start"], -1)
            .when(a["start"] > b["start"], 1)
            .when(a["pos"] < b["pos"], -1)
            .when(a["pos"] > b["pos"], 1)
            .otherwise(0),
        )
        kept = F.aggregate(
            asc,
            F.struct(F.lit(-1).alias("end"), F.slice(asc, 1, 0).alias("keep")),
            lambda s, x: F.when(
                x["start"] >= s["end"],
                F.struct(x["end"].alias("end"), F.concat(F.array(x), s["keep"]).alias("keep")),
            ).otherwise(s),
            lambda s: s["keep"],
        )
        ordered = kept  # already descending: each kept span was prepended
    else:
        raise ValueError(f"unknown mask mode {mode!r}")
    folded = F.aggregate(
        ordered,
        text,
        lambda acc, m: F.concat(
            F.substr(acc, F.lit(1), m["start"]),
            F.lit("["),
            m["label"],
            F.lit("]"),
            F.substr(acc, m["end"] + 1),
        ),
    )
    return F.when(F.size(spans) > 0, folded).otherwise(text)


def pii_labels(spans: Column | str) -> Column:
    if isinstance(spans, str):
        return F.expr(f"array_join(transform({ident(spans)}, _s -> _s.label), ', ')")
    return F.array_join(F.transform(spans, lambda s: s["label"]), ", ")


def pii_reason(spans: Column | str, prefix: str = PII_REASON_PREFIX_MASK) -> Column:
    """``PII detected: a, b`` (labels in list order, duplicates kept)."""
    return F.concat(F.lit(prefix), pii_labels(spans))


def pii_block_reason(spans: Column | str) -> Column:
    return pii_reason(spans, PII_REASON_PREFIX_BLOCK)


def pii_json(spans: Column) -> Column:
    """The span list as JSON text, or null when empty (K4). Key order is
    type, label, value, start, end."""
    return F.when(F.size(spans) > 0, F.to_json(spans))


def pii_count(spans: Column) -> Column:
    return F.size(spans)


def pii_long(df: DataFrame, keys: Sequence[str], spans: str = "pii") -> DataFrame:
    """One row per span (J5) with its position in the row's list."""
    return df.select(*keys, F.posexplode(spans).alias("pos", "span")).select(
        *keys,
        F.col("pos").cast("bigint").alias("pos"),
        F.col("span.type").alias("type"),
        F.col("span.label").alias("label"),
        F.col("span.value").alias("value"),
        F.col("span.start").cast("bigint").alias("start"),
        F.col("span.end").cast("bigint").alias("end"),
    )
