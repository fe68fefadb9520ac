"""Helpers the operators share: lower-casing, cut lineage, the shared folder."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the tables written within each open ``temporary``, innermost last.
_open: list[list[str]] = []


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other letter as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a session on one machine may do without it; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` written once to the shared folder and read back.

    Readers see one fixed result that outlives the executors which made it.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    frame.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.written_to = path
    return out


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at the end the tables that ``cut`` writes within, but for those handed to what this yields."""
    kept: set[str] = set()

    def keep(frame: DataFrame) -> DataFrame:
        kept.add(frame.written_to)
        return frame

    _open.append([])
    try:
        yield keep
    finally:
        made = _open.pop()
        if _open:
            _open[-1].extend(p for p in made if p in kept)
        for path in made:
            if path not in kept:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
