"""Regex dialect translation.

Rules are written in the JavaScript dialect (non-unicode mode). Three
engines disagree on a few escapes:

* ``\\b`` is ASCII in JavaScript and RE2, but Java 17 counts accented
  letters as word characters, so ``é4111...`` would lose its card match.
  In Java we spell the ASCII boundary with look-arounds: a one-sided form
  where the adjacent pattern character is surely a word character (cheap),
  the general two-branch form elsewhere.
* ``\\s`` in JavaScript also covers no-break space, the Unicode space
  separators, line/paragraph separators and BOM; Java and RE2 are ASCII.
  We widen the class in both.
* ``.`` in JavaScript excludes ``\\n \\r \\u2028 \\u2029``; Java also excludes
  ``\\u0085`` and RE2 only ``\\n``. We spell the JavaScript set explicitly.

Everything else used by the rules (``\\d``, ``\\w``, classes, lazy and
counted quantifiers, alternation) means the same in all three.
"""

from __future__ import annotations

_W = "A-Za-z0-9_"
JAVA_LEAD = f"(?<![{_W}])"
JAVA_TAIL = f"(?![{_W}])"
JAVA_BOUNDARY = f"(?:(?<![{_W}])(?=[{_W}])|(?<=[{_W}])(?![{_W}]))"
JAVA_NON_BOUNDARY = f"(?:(?<=[{_W}])(?=[{_W}])|(?<![{_W}])(?![{_W}]))"

# Extra whitespace that JavaScript's \s has and the engine's \s lacks.
_JAVA_WS_EXTRA = r"\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_RE2_WS_EXTRA = r"\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_JAVA_WS = r"\s" + _JAVA_WS_EXTRA
_RE2_WS = r"\s" + _RE2_WS_EXTRA
_JAVA_DOT = r"[^\n\r\u2028\u2029]"
_RE2_DOT = r"[^\n\r\x{2028}\x{2029}]"


def _translate(src: str, target: str, lead_word: bool, tail_word: bool) -> str:
    java = target == "java"
    ws = _JAVA_WS if java else _RE2_WS
    out: list[str] = []
    in_class = False
    i, n = 0, len(src)
    while i < n:
        c = src[i]
        if c == "\\" and i + 1 < n:
            e = src[i + 1]
            tok = src[i : i + 2]
            if e == "b" and not in_class:
                if java:
                    if i == 0 and lead_word:
                        out.append(JAVA_LEAD)
                    elif i + 2 == n and tail_word:
                        out.append(JAVA_TAIL)
                    else:
                        out.append(JAVA_BOUNDARY)
                else:
                    out.append(tok)
            elif e == "B" and not in_class:
                out.append(JAVA_NON_BOUNDARY if java else tok)
            elif e == "s":
                out.append(ws if in_class else f"[{ws}]")
            elif e == "S":
                if in_class:
                    out.append(f"[^{ws}]" if java else tok)
                else:
                    out.append(f"[^{ws}]")
            else:
                out.append(tok)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
                out.append(c)
            elif c == "[":
                out.append(r"\[")  # literal in JS; a nested class in Java
            elif c == "&" and java:
                out.append(r"\&")  # '&&' is intersection in Java
            else:
                out.append(c)
        else:
            if c == "[":
                in_class = True
                out.append(c)
                # a leading ']' or '^]' is literal; keep as is
            elif c == ".":
                out.append(_JAVA_DOT if java else _RE2_DOT)
            else:
                out.append(c)
        i += 1
    return "".join(out)


def to_java(pattern: str, flags: str = "", lead_word: bool = False, tail_word: bool = False) -> str:
    """JavaScript pattern -> java.util.regex pattern used by Spark."""
    body = _translate(pattern, "java", lead_word, tail_word)
    if "i" in flags:
        # JavaScript's non-unicode ignore-case folds non-ASCII letters too;
        # only then is Java's UNICODE_CASE needed.
        prefix = "(?iu)" if any(ord(ch) > 127 for ch in pattern) else "(?i)"
        body = prefix + body
    return body


def to_re2(pattern: str, flags: str = "") -> str:
    """JavaScript pattern -> RE2 pattern used by the DuckDB oracle."""
    body = _translate(pattern, "re2", False, False)
    if "i" in flags:
        body = "(?i)" + body
    return body


def is_word_literal(s: str) -> bool:
    """True for plain words and spaces: regex-free text whose first and last
    characters are word characters."""
    import re

    return bool(re.fullmatch(r"[A-Za-z0-9_](?:[A-Za-z0-9_ ]*[A-Za-z0-9_])?", s))


def word_pattern(text: str) -> str:
    r"""``\b<text>\b`` in the JavaScript dialect; ``text`` is live regex."""
    return r"\b" + text + r"\b"


def topic_java(topic: str) -> str:
    """Java form of a case-insensitive whole-word topic match."""
    edge = is_word_literal(topic)
    return to_java(word_pattern(topic), "i", lead_word=edge, tail_word=edge)


def topic_re2(topic: str) -> str:
    return to_re2(word_pattern(topic), "i")


def sql_string(s: str) -> str:
    """Single-quoted SQL literal (Spark and DuckDB both double the quote)."""
    return "'" + s.replace("'", "''") + "'"
