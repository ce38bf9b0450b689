"""Brute-force reference for the specified JavaScript regex semantics, in
plain Python, for small fixtures only."""

import re

from tollgate.functions.rules import INJECTION_RULES, PII_PATTERNS

_WS = r"\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def to_py(src: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(src):
        c = src[i]
        if c == "\\" and i + 1 < len(src):
            e = src[i + 1]
            if e == "s":
                out.append(_WS if in_class else f"[{_WS}]")
            elif e == "S":
                out.append(r"\S" if in_class else f"[^{_WS}]")
            else:
                out.append(src[i:i + 2])
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            out.append("\\[" if c == "[" else c)
        else:
            if c == "[":
                in_class = True
                out.append(c)
            elif c == ".":
                out.append(r"[^\n\r\u2028\u2029]")
            else:
                out.append(c)
        i += 1
    return "".join(out)


def compile_js(src: str, flags: str = ""):
    f = re.ASCII | (re.IGNORECASE if "i" in flags else 0)
    return re.compile(to_py(src), f)


def spans(text: str, patterns=PII_PATTERNS):
    out = []
    for p in patterns:
        rx = compile_js(p.pattern, p.flags)
        for m in rx.finditer(text):
            val = m.group(0).strip()
            if p.type == "credit_card" and len(re.sub(r"\D", "", val)) < 13:
                continue
            if p.type == "phone" and len(re.sub(r"\D", "", val)) < 10:
                continue
            out.append((p.type, p.label, val, m.start(), m.start() + len(val)))
    return out


def mask(text: str, sp):
    result = text
    for s in sorted(sp, key=lambda x: -x[3]):  # stable sort
        result = result[: s[3]] + f"[{s[1]}]" + result[s[4]:]
    return result


def mask_merged(text: str, sp):
    order = sorted(range(len(sp)), key=lambda i: (sp[i][3], i))
    kept, end = [], -1
    for i in order:
        if sp[i][3] >= end:
            kept.append(sp[i])
            end = sp[i][4]
    result = text
    for s in sorted(kept, key=lambda x: -x[3]):
        result = result[: s[3]] + f"[{s[1]}]" + result[s[4]:]
    return result


def injection(text: str, rules=INJECTION_RULES):
    hits = [r for r in rules if compile_js(r.pattern, "i").search(text)]
    if not hits:
        return (False, 0.0, "none", "")
    n = len({h.type for h in hits})
    return (True, min(0.95, 0.5 + n * 0.15), hits[0].type, "; ".join(h.reason for h in hits))
