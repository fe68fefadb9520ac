"""Joining a small table to a large one without moving the large one.

The small table is dealt into parts of bounded size that are broadcast one by
one, so a join has one meaning and one shape at any size: a larger table makes
more parts, and the large side, with its contents, is never exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT = 64 << 20
# Rows in memory against the bytes of a stored table, which may be compressed.
EXPANSION = 10
_NARROWING = ("Project", "Filter")


def stored_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of ``df``; starts no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_stored(df: DataFrame) -> bool:
    """Whether ``df`` is rows of a table as they are, so that Spark knows its size from the files."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in _NARROWING:
        node = node.children().head()
    return node.children().isEmpty()


def number_of_parts(df: DataFrame, limit: int = BROADCAST_LIMIT) -> int:
    """Parts of ``df`` of at most ``limit`` bytes each.

    The size of a stored table is that of its files and starts no job.  For
    anything derived, Spark's estimate is that of what it is derived from, so
    the rows are measured by one aggregate.
    """
    size = stored_bytes(df) * EXPANSION if is_stored(df) else 1 << 51
    if size > 1 << 50:
        size = df.select((F.octet_length(F.to_json(F.struct("*"))) + 16).alias("n")).agg(F.sum("n")).first()[0] or 0
    return max(1, -(-size // limit))


def broadcast_parts(df: DataFrame, key: str, parts: int) -> list[DataFrame]:
    """``df`` in ``parts`` by the hash of ``key``, each with a broadcast hint."""
    if parts == 1:
        return [F.broadcast(df)]
    return [F.broadcast(df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)) for k in range(parts)]
