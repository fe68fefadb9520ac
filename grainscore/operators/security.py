"""Security anti-patterns: secrets and SQL built from text, dangerous calls in Python.

A pattern is only run on files that hold one of its literal words, tested on a
case-folded copy of the text; the words are implied by the pattern, so no match
is missed and most files never reach the regular expressions.  A pattern that
ignores case runs on that copy, in lower case and from a literal on, which the
engine finds many times faster than letters of either case.
"""

from __future__ import annotations

import re

from grainscore import fixed_values as fixed
from grainscore.functions import text as tx
from grainscore.functions.patterns import java, literal

# Every match of the pattern at the same position contains one of these words.
SECRET_WORDS = [
    ["password", "passwd", "pwd"],
    ["api_key", "apikey", "api_secret"],
    ["secret"],
    ["token"],
    ["private_key", "priv_key"],
    ["db_password"],
    ["database_url"],
    ["mysql://"],
    ["mongodb://"],
    ["aws_access_key_id", "aws_secret_access_key"],
    ["akia"],
    ["bearer"],
    ["basic"],
    ["ssh_key", "rsa_key"],
]
SQL_WORDS = [["execute"], ["execute"], ["execute"], ["cursor.execute"], ["cursor.execute"], [".query"], ["raw"]]
# What a match of the rule has before its first equals sign or opening bracket, but for white space.
SECRET_ENDS = {**{k: SECRET_WORDS[k] for k in (0, 1, 4, 5, 6, 9, 13)}, 2: ["secret_key", "secret"], 3: ["token"]}
SQL_ENDS = dict(enumerate(SQL_WORDS))


def assigned_ends(folded: str) -> str:
    """SQL: what ends with a secret's name before an equals sign."""
    return tx.ends_before(folded, "=", sorted({w for words in SECRET_ENDS.values() for w in words}))


def called_ends(folded: str) -> str:
    """SQL: what ends with a query's name before an opening bracket."""
    return tx.ends_before(folded, r"\(", sorted({w for words in SQL_ENDS.values() for w in words}))


# Alternatives by what they have in common, from there on where what precedes it can't be part of the match before.  What
# precedes "token" holds no quote, as the end of a match does, so there are as many matches without it.
_STARTS = {
    "(password|passwd|pwd)": "p(?:assword|asswd|wd)",
    "(api_key|apikey|api_secret)": "api(?:_key|key|_secret)",
    "(secret_key|secret)": "secret(?:_key)?",
    "(token|auth_token|access_token)": "token",
    "(private_key|priv_key)": "priv(?:ate)?_key",
    "(aws_access_key_id|aws_secret_access_key)": "aws_(?:access_key_id|secret_access_key)",
    "(ssh_key|rsa_key)": "_key(?<=(?:ssh|rsa)_key)",
}


def folded_pattern(pattern: str) -> str:
    """``pattern``, written to ignore case, as a pattern of case-folded text with as many matches."""
    pattern = re.sub(r"(\\.)|([A-Z])", lambda m: m[1] or m[2].lower(), pattern.removeprefix("(?i)"))
    for start, same in _STARTS.items():
        if pattern.startswith(start):
            return same + pattern[len(start) :]
    return pattern


def _counts(text: str, folded: str, rules: list[tuple[str, str]], tests: list[str]) -> list[str]:
    """Number of non-overlapping matches of each rule, in texts that pass its test."""

    def matches(pattern: str) -> str:
        if pattern.startswith("(?i)"):
            return f"regexp_count({folded}, {literal(java(folded_pattern(pattern)))})"
        return f"regexp_count({text}, {literal(java(pattern))})"

    return [f"CASE WHEN {t} THEN {matches(p)} WHEN {text} IS NOT NULL THEN 0 END" for (p, _), t in zip(rules, tests)]


def _tests(folded: str, words: list[list[str]], ends: dict[int, list[str]], found: str | None) -> list[str]:
    """Whether a text may match each rule, by the ends found in it or else by its words."""
    by_end = lambda k: f"exists({found}, e -> {tx.ends_with_any('e', ends[k])})"
    return [tx.contains_any(folded, w) if found is None or k not in ends else by_end(k) for k, w in enumerate(words)]


def secret_counts(text: str, folded: str, ends: str | None = None) -> list[str]:
    """``ends`` are the ``assigned_ends`` of the folded text if there are any; they save searches for single words."""
    return _counts(text, folded, fixed.SECRET_PATTERNS, _tests(folded, SECRET_WORDS, SECRET_ENDS, ends))


def sql_counts(text: str, folded: str, ends: str | None = None) -> list[str]:
    """``ends`` are the ``called_ends`` of the folded text if there are any."""
    return _counts(text, folded, fixed.SQL_INJECTION_PATTERNS, _tests(folded, SQL_WORDS, SQL_ENDS, ends))


def _among(name: str, words: list[str]) -> str:
    return f"{name} IN ({', '.join(map(literal, words))})"


def is_eval(c: str) -> str:
    return f"({c}.attr IS NULL AND {_among(f'{c}.base', fixed.EVAL_NAMES)})"


def is_shell(c: str) -> str:
    bare = f"{c}.attr IS NULL AND {_among(f'{c}.base', fixed.SHELL_NAMES)}"
    method = f"{c}.attr IS NOT NULL AND {c}.base = 'subprocess' AND {_among(f'{c}.attr', fixed.SHELL_METHODS)}"
    return f"({c}.shell_true AND ({bare} OR {method}))"


def is_unsafe_load(c: str) -> str:
    return f"({c}.attr IS NOT NULL AND {c}.attr = 'loads' AND {_among(f'{c}.base', fixed.UNSAFE_LOADERS)})"


_PARSED = "is_py AND parse_status = 'ok'"


def _bases(test: str) -> str:
    return tx.listed(_PARSED, f"transform(filter(calls, c -> {test}), c -> c.base)")


MEASURES = [
    dict(tx.FOLDED),
    {"sec_assigned": assigned_ends("text_folded"), "sec_called": called_ends("text_folded")},
    {
        **{f"sec_secret_{k}": e for k, e in enumerate(secret_counts("text", "text_folded", "sec_assigned"))},
        **{f"sec_sql_{k}": e for k, e in enumerate(sql_counts("text", "text_folded", "sec_called"))},
        "sec_broken": "is_py AND parse_status = 'syntax_error'",
        "sec_evals": _bases(is_eval("c")),
        "sec_shells": _bases(is_shell("c")),
        "sec_loads": _bases(is_unsafe_load("c")),
        "sec_asserts": f"CASE WHEN {_PARSED} THEN n_asserts ELSE 0 END",
    },
]

_SECRETS = " + ".join(f"sec_secret_{k}" for k in range(len(fixed.SECRET_PATTERNS)))
_SQL = " + ".join(f"sec_sql_{k}" for k in range(len(fixed.SQL_INJECTION_PATTERNS)))

# Issues weighted by kind
ISSUES = (
    f"(({_SECRETS}) * 3 + ({_SQL}) * 2 + (size(sec_evals) + size(sec_shells)) * 2 + size(sec_loads) "
    "+ CASE WHEN sec_asserts > 5 THEN 1 ELSE 0 END)"
)

SCORE = f"least(1.0D, {ISSUES} * CASE WHEN sec_broken THEN 0.1D ELSE 0.12D END)"

_DASH = chr(0x2014)

FINDINGS = (
    "concat("
    + ", ".join(
        [
            *(
                tx.listed(f"sec_secret_{k} > 0", tx.strings(literal(f"SECURITY: {label} detected")))
                for k, (_, label) in enumerate(fixed.SECRET_PATTERNS)
            ),
            *(
                tx.listed(
                    f"sec_sql_{k} > 0",
                    tx.strings(f"concat({literal(f'SECURITY: {label} (')}, sec_sql_{k}, ' instance(s))')"),
                )
                for k, (_, label) in enumerate(fixed.SQL_INJECTION_PATTERNS)
            ),
            f"transform(sec_evals, n -> concat('SECURITY: Direct use of ', n, '() {_DASH} code execution from strings'))",
            f"transform(sec_shells, n -> 'SECURITY: subprocess call with shell=True {_DASH} command injection risk')",
            f"transform(sec_loads, n -> concat('SECURITY: ', n, '.loads() {_DASH} deserializing untrusted data is unsafe'))",
            tx.listed(
                "sec_asserts > 5",
                f"array(format_string('SECURITY: Heavy use of assert (%d times) for validation {_DASH} "
                "assert statements can be disabled with Python -O flag', sec_asserts))",
            ),
        ]
    )
    + ")"
)
