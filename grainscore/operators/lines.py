"""Line facts: everything that needs only the text, one row per file or per line."""

from __future__ import annotations

from pyspark.sql import DataFrame

from grainscore.functions import text as tx


def with_lines(admitted: DataFrame) -> DataFrame:
    """Add ``lines`` (stripped, blank ones kept) and ``hash_lines`` (numbered, those holding ``#``)."""
    return tx.derive_from(
        admitted, tx.stripped_lines("text"), "ls", {"lines": "ls", "hash_lines": numbered_hash_lines("ls")}
    )


def numbered_hash_lines(lines: str) -> str:
    """array<struct<line_no, text>> of the lines that hold ``#``."""
    return (
        f"filter(transform({lines}, (l, i) -> named_struct('line_no', i + 1, 'text', l)), s -> contains(s.text, '#'))"
    )


def nonblank_count(lines: str) -> str:
    return f"size(filter({lines}, l -> l <> ''))"


def hash_start_count(hash_lines: str) -> str:
    """Lines that are only a ``#`` comment."""
    return f"size(filter({hash_lines}, s -> startswith(s.text, '#')))"


def line_table(admitted: DataFrame, *keys: str) -> DataFrame:
    """One row per line with its 1-based number."""
    rows = admitted.selectExpr(*keys, f"posexplode({tx.split_lines('text')}) AS (_pos, line)")
    return rows.selectExpr(*keys, "_pos + 1 AS line_no", "line")
