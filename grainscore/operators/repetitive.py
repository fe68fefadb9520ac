"""Repeated structure: identical functions, identical bodies, repeated line blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainscore.functions import text as tx

BLOCK = 5
_PLACES = (1 << 24) - 1


def _entries(functions: str, key: str) -> str:
    return f"transform({functions}, f -> named_struct('key', {key}, 'pos', f.pos, 'value', f.name))"


def duplicate_structures(functions: str) -> str:
    """array<struct<pos, values>>: names of functions that share a fingerprint, two or more."""
    return tx.group_in_order(_entries(functions, "f.fingerprint"), 2)


def same_body_patterns(functions: str) -> str:
    """Names of functions whose bodies have the same statement types, three or more."""
    return tx.group_in_order(_entries(functions, "array_join(f.body_types, '|')"), 3)


def duplicated_count(functions: str) -> str:
    """Functions that share their fingerprint with another one."""
    return tx.let(
        f"sort_array(transform({functions}, f -> f.fingerprint))",
        "s",
        "size(filter(s, (x, i) -> x <=> get(s, i - 1) OR x <=> get(s, i + 1)))",
    )


def block_entries(lines: str) -> str:
    """array<struct<key, pos, value>> of windows of five non-blank lines, all of those that repeat among them.

    The window that ends on the last line is not looked at.  A window that
    repeats starts with a line that does, so only these are digested: they meet
    by the 40 bits of a hash that sort in front of their places.  Lines that
    share these bits alone only make windows that do not repeat.  A file that is
    analyzed has far fewer than 2**24 lines.
    """
    place = f"x & {_PLACES}L"
    marked = f"CASE WHEN l <> '' THEN xxhash64(l) & {~_PLACES}L | CAST(i AS BIGINT) END"
    marks = f"sort_array(filter(transform(ls, (l, i) -> {marked}), x -> x IS NOT NULL))"
    same = lambda other: f"x & {~_PLACES}L = get(s, {other}) & {~_PLACES}L"
    starts = f"filter(s, (x, i) -> ({same('i - 1')} OR {same('i + 1')}) AND {place} < size(ls) - {BLOCK})"
    block = f"named_struct('pos', CAST({place} AS INT) + 1, 'block', slice(ls, CAST({place} AS INT) + 1, {BLOCK}))"
    windows = tx.let(lines, "ls", tx.let(marks, "s", f"transform({starts}, x -> {block})"))
    full = f"filter({windows}, w -> NOT array_contains(w.block, ''))"
    entry = r"named_struct('key', md5(array_join(w.block, '\n')), 'pos', w.pos, 'value', w.pos)"
    empty = "CAST(array() AS array<struct<key: string, pos: int, value: int>>)"
    return f"coalesce(transform({full}, w -> {entry}), {empty})"


def repeated_block_count(entries: str) -> str:
    """Distinct blocks that occur at two or more positions."""
    return tx.let(
        f"sort_array(transform({entries}, e -> e.key))",
        "s",
        "size(filter(s, (x, i) -> x <=> get(s, i + 1) AND NOT x <=> get(s, i - 1)))",
    )


def repeated_blocks(lines: str) -> str:
    """array<struct<pos, values>>: positions of each repeated block, in order of first position."""
    return tx.group_in_order(block_entries(lines), 2)


def repeated_block_table(line_rows: DataFrame, *keys: str) -> DataFrame:
    """Table form over ``(keys, line_no, line)``: one row per repeated block.

    For line tables that exist as such; files are kept apart by their key, so
    the window partitions are as small as a file.
    """
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY line_no)"
    leads = [f"lead(l0, {k}) {over} AS l{k}" for k in range(1, BLOCK + 1)]
    block = [f"l{k}" for k in range(BLOCK)]
    full = " AND ".join([f"l{BLOCK} IS NOT NULL", *(f"{part} <> ''" for part in block)])
    return (
        line_rows.selectExpr(*keys, "line_no", f"{tx.strip('line')} AS l0")
        .selectExpr("*", *leads)
        .where(full)
        .selectExpr(*keys, "line_no", rf"md5(concat_ws('\n', {', '.join(block)})) AS block")
        .groupBy(*keys, "block")
        .agg(F.expr("sort_array(collect_list(line_no))").alias("positions"))
        .where("size(positions) >= 2")
    )


_FUNCTIONS = "functions"
_COMPARABLE = f"parse_status = 'ok' AND size({_FUNCTIONS}) >= 2"

MEASURES = [
    {
        "rep_functions": f"CASE WHEN {_COMPARABLE} THEN size({_FUNCTIONS}) END",
        "rep_duplicated": f"CASE WHEN {_COMPARABLE} THEN {duplicated_count(_FUNCTIONS)} END",
        "rep_blocks": f"CASE WHEN {_COMPARABLE} THEN {repeated_block_count(block_entries('lines'))} END",
    }
]

SCORE = (
    "CASE WHEN rep_functions IS NULL THEN 0.0D ELSE "
    "least(1.0D, rep_duplicated / rep_functions * 0.7D + least(1.0D, rep_blocks * 0.15D) * 0.3D) END"
)


def _sentences(groups: str, text: str) -> str:
    return f"transform({groups}, g -> concat({text}))"


FINDINGS = tx.listed(
    "rep_functions IS NOT NULL",
    "concat("
    + ", ".join(
        [
            tx.listed(
                "rep_duplicated > 0",
                _sentences(
                    duplicate_structures(_FUNCTIONS),
                    "'Structurally identical functions: ', array_join(g.values, ', ')",
                ),
            ),
            "array_distinct("
            + _sentences(
                same_body_patterns(_FUNCTIONS),
                "'Functions with identical body statement patterns: ', array_join(g.values, ', ')",
            )
            + ")",
            tx.listed(
                "rep_blocks > 0",
                _sentences(
                    repeated_blocks("lines"),
                    "'Repeated code block found at lines: [', "
                    "array_join(CAST(g.values AS array<string>), ', '), ']'",
                ),
            ),
        ]
    )
    + ")",
)
