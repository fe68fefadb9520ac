"""The same scoring over files that keep arriving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from grainscore.operators.registry import Detector
from grainscore.plans.scoring import score_files


def write_scores(
    files: DataFrame, path: str, checkpoint: str, detectors: Sequence[Detector] | None = None
) -> StreamingQuery:
    """Score a stream of corpus rows into Parquet.

    Scoring a file needs no other file, so the batch plan runs per micro-batch
    without state or watermark.
    """
    writer = score_files(files, detectors).writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
