"""Ignore patterns in gitignore syntax, decided with Spark expressions.

Each pattern becomes one regular expression on the path relative to the
repository root.  The last matching pattern decides and ``!`` re-includes, but
nothing below an ignored directory comes back.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainscore import fixed_values as fixed
from grainscore.functions import text as tx
from grainscore.functions.joins import BROADCAST_LIMIT, broadcast_parts, number_of_parts
from grainscore.functions.patterns import literal

# Ship the helpers inside the UDF, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _segment_regex(segment: str) -> str:
    """One path segment: ``*`` and ``?`` stay inside it, ``[...]`` is a character class."""
    out, i = "", 0
    while i < len(segment):
        ch = segment[i]
        i += 1
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "\\" and i < len(segment):
            out += re.escape(segment[i])
            i += 1
        elif ch == "[":
            close = segment.find("]", i + 2 if segment[i : i + 1] in ("!", "^") else i + 1)
            if close < 0:
                out += r"\["
                continue
            body = segment[i:close]
            negated = body[:1] in ("!", "^")
            body = (body[1:] if negated else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += f"[{'^' if negated else ''}{body}]"
            i = close + 1
        else:
            out += re.escape(ch)
    return out


def pattern_regex(pattern: str) -> tuple[str, bool] | None:
    """``(regex, ignores)`` of one pattern line, None for blanks and comments.

    Raises ValueError when the line is not a valid pattern.
    """
    pattern = pattern.lstrip() if pattern.endswith("\\ ") else pattern.strip()
    if not pattern or pattern.startswith("#") or pattern == "/":
        return None
    ignores = not pattern.startswith("!")
    if not ignores:
        pattern = pattern[1:]
    if not pattern:
        raise ValueError("a lone '!' is no pattern")
    parts = pattern.split("/")
    below_only = parts[-1] == ""  # trailing slash: directories, that is, what lies below them
    anchored = len([p for p in parts if p]) > 1 or parts[0] == ""
    segments = [p for k, p in enumerate(parts) if p or 0 < k < len(parts) - 1]
    segments = [p for k, p in enumerate(segments) if not (p == "**" and k and segments[k - 1] == "**")]
    if not anchored and segments not in ([], ["**"]):
        segments.insert(0, "**")
    if not segments:
        return None
    if segments == ["**"]:
        return (".+/.*" if below_only else ".+"), ignores
    regex, last = "", len(segments) - 1
    for k, segment in enumerate(segments):
        if segment == "**":
            regex += "(?:.+/)?" if k == 0 else ("/.*" if k == last else "(?:/.+)?")
            continue
        slash = "/" if k and not (k == 1 and segments[0] == "**") else ""
        regex += slash + ("[^/]+" if segment == "*" else _segment_regex(segment))
    if segments[-1] != "**":
        regex += "/.*" if below_only else "(?:/.*)?"
    try:
        re.compile(regex)
    except re.error as error:
        raise ValueError(str(error)) from error
    return regex, ignores


def _anchor(regex: str) -> str:
    return rf"(?s)^(?:{regex})\z"


def compile_patterns(patterns: Iterable[str]) -> list[tuple[str, bool]]:
    return [rule for rule in map(pattern_regex, patterns) if rule is not None]


def decide(path: str, rules: list[tuple[str, bool]]) -> str:
    """SQL: does the last matching rule ignore ``path``?  Neighbours of one kind are tested together."""
    runs: list[tuple[list[str], bool]] = []
    for regex, ignores in rules:
        if runs and runs[-1][1] == ignores:
            runs[-1][0].append(regex)
        else:
            runs.append(([regex], ignores))
    branches = " ".join(
        f"WHEN rlike({path}, {literal(_anchor('|'.join(f'(?:{r})' for r in regexes)))}) THEN {str(ignores).lower()}"
        for regexes, ignores in reversed(runs)
    )
    return f"CASE {branches} ELSE false END" if runs else "false"


def parent_directories(path: str) -> str:
    """SQL: all directories above a path, each with a final slash."""
    above = "transform(sequence(1, size(parts) - 1), k -> concat(array_join(slice(parts, 1, k), '/'), '/'))"
    return tx.let(f"split({path}, '/')", "parts", tx.listed("size(parts) > 1", above))


def is_ignored(path: str, extra: Iterable[str] = (), defaults: bool = True) -> str:
    """SQL: default patterns, then ``extra``.  Directories are only tested where ``!`` could differ
    below them: a plain pattern that matches a directory matches everything in it."""
    rules = compile_patterns([*(fixed.DEFAULT_IGNORE_PATTERNS if defaults else []), *extra])
    ignored = decide(path, rules)
    if all(ignores for _, ignores in rules):
        return ignored
    return f"({ignored} OR exists({parent_directories(path)}, d -> {decide('d', rules)}))"


_RULE = T.StructType(
    [
        T.StructField("regex", T.StringType()),
        T.StructField("ignores", T.BooleanType()),
        T.StructField("valid", T.BooleanType()),
    ]
)


@F.pandas_udf(_RULE)
def _compiled(patterns: pd.Series) -> pd.DataFrame:
    rows = []
    for pattern in patterns:
        try:
            regex, ignores = pattern_regex(pattern) or (None, None)
            rows.append((_anchor(regex) if regex is not None else None, ignores, True))
        except ValueError:
            rows.append((None, None, False))
    return pd.DataFrame(rows, columns=["regex", "ignores", "valid"])


def compiled_repo_patterns(repo_ignore: DataFrame) -> DataFrame:
    """``repo_ignore(repo_id, ord, pattern)`` to one ordered rule list per repository.

    Blank and ``#`` lines fall away; one invalid line drops the whole list.
    A list is one ignore file, so a group is small.
    """
    rule = _compiled("pattern")
    return (
        repo_ignore.select("repo_id", "ord", rule.alias("rule"))
        .groupBy("repo_id")
        .agg(
            F.bool_and("rule.valid").alias("valid"),
            F.sort_array(
                F.collect_list(
                    F.when(
                        F.col("rule.regex").isNotNull(),
                        F.struct("ord", F.col("rule.regex").alias("regex"), F.col("rule.ignores").alias("ignores")),
                    )
                )
            ).alias("rules"),
        )
        .where("valid")
        .select("repo_id", "rules")
    )


def filter_ignored(
    files: DataFrame,
    repo_ignore: DataFrame | None = None,
    extra: Iterable[str] = (),
    path: str = "path",
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Drop ignored files: defaults, ``extra``, then each repository's own patterns.

    The rule lists are broadcast in parts of at most ``broadcast_limit``; a file
    meets its repository's list in one part or in none, so the result does not
    depend on their number, contents are never exchanged and no repository is a
    hot key.  Files without a repository follow the general patterns alone.
    """
    if repo_ignore is None:
        return files.where(f"NOT {is_ignored(path, extra)}")
    extra = list(extra)
    rules = compile_patterns([*fixed.DEFAULT_IGNORE_PATTERNS, *extra])
    repo_rules = compiled_repo_patterns(repo_ignore)
    parts = broadcast_parts(repo_rules, "repo_id", number_of_parts(repo_ignore, broadcast_limit))
    met = files
    for k, part in enumerate(parts):
        met = met.join(part.withColumnRenamed("rules", f"_rules_{k}"), "repo_id", "left")
    names = [f"_rules_{k}" for k in range(len(parts))]

    def ignored(p: str) -> str:
        none = "CAST(array() AS array<struct<ord: int, regex: string, ignores: boolean>>)"
        step = f"CASE WHEN rlike({p}, r.regex) THEN r.ignores ELSE out END"
        return f"aggregate(coalesce({', '.join(names)}, {none}), {decide(p, rules)}, (out, r) -> {step})"

    keep = f"NOT ({ignored(path)} OR exists({parent_directories(path)}, d -> {ignored('d')}))"
    return met.where(keep).drop(*names)


def ignore_lines(ignore_files: DataFrame) -> DataFrame:
    """``(repo_id, content)`` of root ignore files to ``(repo_id, ord, pattern)``."""
    lines = ignore_files.selectExpr("repo_id", f"posexplode({tx.split_lines('content')}) AS (ord, pattern)")
    return lines.where(f"NOT {tx.is_blank('pattern')} AND NOT startswith(pattern, '#')")
