"""Regular expressions across engines.

The rule patterns are written once, in Python's dialect.  Java (Spark) and RE2
(the SQL oracle) read ``\\s``, ``\\w``, ``\\d``, ``\\b`` and ``.`` differently, so
those tokens are replaced by explicit character classes with Python's meaning.
"""

from __future__ import annotations

import re

# Characters Python treats as white space, as one string and as class bodies.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f " + "".join(
    map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# Class bodies that hold in both dialects.
_CLASSES = {
    "s": r"\t\n\x0B\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}",
    "w": r"\p{L}\p{N}_",
    "d": r"\p{Nd}",
}
# A boundary that opens a pattern stands before a word, one further on stands after a word.
_JAVA_BOUNDARY = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")
_RE2_BOUNDARY = (r"\b", r"\b")


def _rewrite(pattern: str, boundary: tuple[str, str]) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            token = pattern[i + 1]
            if token in _CLASSES:
                body = _CLASSES[token]
                out.append(body if in_class else f"[{body}]")
            elif token == "b" and not in_class:
                out.append(boundary[i > 0])
            else:
                out.append(ch + token)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(r"[^\n]" if ch == "." and not in_class else ch)
        i += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = False) -> str:
    """Pattern text for Spark's regex functions."""
    if pattern.startswith("(?i)"):
        pattern, ignore_case = pattern[4:], True
    return ("(?iu)" if ignore_case else "") + _rewrite(pattern, _JAVA_BOUNDARY)


def re2(pattern: str, ignore_case: bool = False) -> str:
    """Pattern text for an RE2 engine."""
    if pattern.startswith("(?i)"):
        pattern, ignore_case = pattern[4:], True
    return ("(?i)" if ignore_case else "") + _rewrite(pattern, _RE2_BOUNDARY)


def any_of(patterns: list[str]) -> str:
    """One pattern that matches where any of ``patterns`` does.

    A common start is written once, so a position without it is rejected by one
    comparison instead of one per pattern.
    """
    start = _common_start(patterns)
    return start + "(?:" + "|".join(p[len(start) :] for p in patterns) + ")"


def any_by_letter(patterns: list[str]) -> str:
    """``any_of``, with the first letter behind the common start written once for all patterns that share it."""
    start = _common_start(patterns)
    shared: dict[str, list[str]] = {}
    for rest in (p[len(start) :] for p in patterns):
        alone = not rest[0].isalpha() or rest[1:2] in [*"*+?{|"] or "|" in _outer(rest)
        shared.setdefault("" if alone else rest[0], []).append(rest if alone else rest[1:])
    return start + "(?:" + "|".join(k + f"(?:{'|'.join(v)})" if k else "|".join(v) for k, v in shared.items()) + ")"


def _common_start(patterns: list[str]) -> str:
    return next((s for s in (r"#\s*",) if all(p.startswith(s) for p in patterns)), "")


def _outer(pattern: str) -> str:
    """What of a pattern stands in no group and in no class."""
    return re.sub(r"\\.|\[[^\]]*\]|\([^()]*\)", "", pattern)


def literal(text: str) -> str:
    """Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, ignore_case: bool = False) -> str:
    """SQL test: the pattern occurs somewhere in ``text``."""
    return f"rlike({text}, {literal(java(pattern, ignore_case))})"


def first_label(text: str, rules: list[tuple[str, str]]) -> str:
    """SQL: label of the first rule that matches, NULL when none does (case-insensitive)."""
    branches = " ".join(f"WHEN {matches(text, p, True)} THEN {literal(label)}" for p, label in rules)
    return f"CASE {branches} END"
