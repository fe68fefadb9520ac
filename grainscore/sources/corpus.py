"""Corpus tables: ``files(repo_id, path, size_bytes, content)`` and how files are admitted.

Path and size tests never touch the content, so on a Parquet or similar table
they are decided from the narrow columns (and pushed to the scan where the
predicate is on a stored column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from grainscore import fixed_values as fixed
from grainscore.functions import text as tx
from grainscore.functions.joins import stored_bytes
from grainscore.functions.patterns import literal

KEYS = ("repo_id", "path")

# SQL: last suffix of a file name; a leading dot or a final dot starts none.
SUFFIX = r"regexp_extract({}, '[^/](\\.[^./]+)\\z', 1)"


def files_from_table(
    df: DataFrame, repo_id: str = "repo_id", path: str = "path", content: str = "content", size_bytes: str | None = None
) -> DataFrame:
    """Shape any table with one row per file into the corpus schema; arguments are SQL expressions.

    ``content`` may be text or raw bytes; bytes are decoded later, after the
    size test, with invalid UTF-8 dropped.
    """
    return df.selectExpr(
        f"CAST({repo_id} AS STRING) AS repo_id",
        f"{path} AS path",
        f"lower({SUFFIX.format(path)}) AS ext",
        f"coalesce(CAST({size_bytes or f'octet_length({content})'} AS BIGINT), 0L) AS size_bytes",
        f"{content} AS content",
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal an input of less than one split over the cores by ``keys``, which should be unique per row.

    Parsing is CPU-bound, and an input below ``spark.sql.files.maxPartitionBytes``
    may arrive in one task however many cores there are.  At most that many
    bytes are ever moved; larger inputs, of any number of splits, are returned
    as they are.  Starts no job.
    """
    spark = df.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(spark.sparkContext.defaultParallelism, *keys) if stored_bytes(df) < split else df


def filter_extensions(files: DataFrame, path: str = "path") -> DataFrame:
    """Keep the file types the checks understand, whatever the case of their suffix."""
    supported = ", ".join(map(literal, fixed.SUPPORTED_EXTENSIONS))
    return files.where(f"lower({SUFFIX.format(path)}) IN ({supported})")


def relative_path(path: str, base: str | None = None) -> str:
    """SQL: path below ``base``; the path itself when it lies elsewhere; the bare name without a base."""
    if base is None:
        return f"element_at(split({path}, '/'), -1)"
    prefix = f"concat(trim(TRAILING '/' FROM {base}), '/')"
    return f"CASE WHEN startswith({path}, {prefix}) THEN substr({path}, length({prefix}) + 1) ELSE {path} END"


def size_skip_reason(size: str) -> str:
    """SQL: why a file of this size is skipped, NULL when it is not."""
    limit = fixed.MAX_FILE_BYTES
    return (
        f"CASE WHEN {size} = 0 THEN 'empty file' WHEN {size} > {limit} "
        f"THEN concat('file too large (', {size} div 1024, 'KB > {limit // 1024}KB)') END"
    )


def admit(files: DataFrame) -> DataFrame:
    """Add what every check starts from.

    ``text``: decoded content with unified newlines, NULL for files that are not
    analyzed; ``skip_reason``; ``is_py_ext`` (parsed as Python by extension,
    any case) and ``is_py`` (name ends in ``.py`` exactly).  Tests run in the
    order size, read error, blank content.
    """
    binary = files.schema["content"].dataType.typeName() == "binary"
    by_size = size_skip_reason("size_bytes")
    flagged = files.selectExpr(
        *(c for c in files.columns if c != "read_error"),
        "read_error" if "read_error" in files.columns else "CAST(NULL AS STRING) AS read_error",
        "ext = '.py' AS is_py_ext",
        "endswith(path, '.py') AS is_py",
    )
    content = tx.unify_newlines(tx.decode_utf8("content") if binary else "content")
    blank = tx.is_blank("decoded")
    return tx.derive_from(
        flagged,
        f"CASE WHEN {by_size} IS NULL AND read_error IS NULL THEN {content} END",
        "decoded",
        {
            "text": f"CASE WHEN NOT {blank} THEN decoded END",
            "skip_reason": f"coalesce({by_size}, CASE WHEN {blank} THEN 'empty content' END)",
        },
    ).drop("content")
