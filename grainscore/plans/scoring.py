"""Score a corpus of files.

    files -> admit -> facts (Arrow UDF) -> lines -> measures -> scores -> results

Every step is narrow: contents are read once, never shuffled, and dropped
before the first exchange.  Findings that a query does not select are pruned
from the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainscore.functions import scoring as sc
from grainscore.functions import text as tx
from grainscore.functions.patterns import literal
from grainscore.operators import lines as ln
from grainscore.operators import syntax
from grainscore.operators.registry import Detector, FrameDetector, builtin_detectors
from grainscore.sources.corpus import KEYS, admit


def parse(files: DataFrame) -> DataFrame:
    """Corpus rows with text and syntax facts."""
    return syntax.with_facts(admit(files))


def prepare(files: DataFrame) -> DataFrame:
    """Corpus rows with text, syntax facts and lines."""
    return ln.with_lines(parse(files))


def with_measures(prepared: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    """Add the measures of all detectors, one level after the other."""
    for depth in range(max((len(d.measures) for d in detectors), default=0)):
        columns: dict[str, str] = {}
        for d in detectors:
            columns.update(d.measures[depth] if depth < len(d.measures) else {})
        prepared = tx.derive(prepared, columns)
    return prepared


def _in_row(files: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    source = prepare(files) if any(d.uses_lines for d in detectors) else parse(files)
    failed = "CASE WHEN parse_status = 'error' THEN concat('analysis error: ', parse_error) END"
    error = f"coalesce(CASE WHEN skip_reason IS NULL THEN read_error END, {failed})"
    status = f"CASE WHEN skip_reason IS NOT NULL THEN 'skipped' WHEN {error} IS NOT NULL THEN 'error' ELSE 'analyzed' END"
    scored = tx.derive(with_measures(source, detectors), {"error": error, "status": status})
    columns = []
    for d in detectors:
        columns.append(f"CASE WHEN status = 'analyzed' THEN {d.score} END AS {d.name}_score")
        columns.append(f"CASE WHEN status = 'analyzed' THEN {d.findings} END AS {d.name}_findings")
    return scored.selectExpr(*KEYS, "status", "skip_reason", "error", *columns)


def _from_frames(found: DataFrame, files: DataFrame, frames: Sequence[FrameDetector]) -> DataFrame:
    """``found`` with the scores and findings of frame detectors, met by null-safe keys.

    Only keys, scores and findings are exchanged.
    """
    for d in frames:
        source = parse(files).where("parse_status <> 'error'") if d.uses_facts else admit(files)
        rows = d.rows(source.where("skip_reason IS NULL AND read_error IS NULL"))
        same = found["repo_id"].eqNullSafe(rows["_repo_id"]) & found["path"].eqNullSafe(rows["_path"])
        found = found.join(rows, same, "left").drop("_repo_id", "_path")
    errors = ", ".join(f"{d.name}_error" for d in frames)
    failed = f"CASE WHEN status = 'analyzed' THEN coalesce({errors}) END"
    own = {f"{d.name}_{part}" for d in frames for part in ("score", "findings", "error")}
    kept = [c for c in found.columns if c not in own]
    of_frames = []
    for d in frames:
        of_frames.append(f"CASE WHEN _status = 'analyzed' THEN coalesce({d.name}_score, 0.0D) END AS {d.name}_score")
        of_frames.append(f"CASE WHEN _status = 'analyzed' THEN coalesce({d.name}_findings, {tx.EMPTY}) END AS {d.name}_findings")
    judged = found.selectExpr("*", f"{failed} AS _failed").selectExpr("*", "CASE WHEN _failed IS NOT NULL THEN 'error' ELSE status END AS _status")
    changed = {"status": "_status", "error": "coalesce(error, concat('analysis error: ', _failed))"}
    for c in kept:
        if c.endswith(("_score", "_findings")):
            changed[c] = f"CASE WHEN _status = 'analyzed' THEN {c} END"
    return judged.selectExpr(*(f"{changed.get(c, c)} AS {c}" for c in kept), *of_frames)


def detect(files: DataFrame, detectors: Sequence[Detector | FrameDetector] | None = None) -> DataFrame:
    """One row per file: keys, ``status``, ``skip_reason``, ``error`` and, per detector,
    ``<name>_score`` and ``<name>_findings``."""
    detectors = builtin_detectors() if detectors is None else detectors
    frames = [d for d in detectors if isinstance(d, FrameDetector)]
    found = _in_row(files, [d for d in detectors if not isinstance(d, FrameDetector)])
    return _from_frames(found, files, frames) if frames else found


def score_files(files: DataFrame, detectors: Sequence[Detector | FrameDetector] | None = None) -> DataFrame:
    """File results: ``final_score``, ``label``, ``color``, ``raw``, ``weighted``, ``findings``.

    Scores are NULL and findings empty for skipped and error rows.
    """
    detectors = builtin_detectors() if detectors is None else detectors
    raw = {d.name: f"{d.name}_score" for d in detectors}
    weights = {d.name: d.effective_weight for d in detectors}
    analyzed = lambda expression: f"CASE WHEN status = 'analyzed' THEN {expression} END"
    lists = ", ".join(f"{d.name}_findings" for d in detectors) or tx.EMPTY
    results = tx.derive(detect(files, detectors), {"final_score": analyzed(sc.weighted_score(raw, weights))})
    return results.selectExpr(
        *KEYS, "status", "skip_reason", "error", "final_score",
        f"{sc.score_label('final_score')} AS label",
        f"{sc.score_color('final_score')} AS color",
        f"{analyzed(tx.row(raw)) if raw else 'NULL'} AS raw",
        f"{analyzed(sc.weighted_contributions(raw, weights)) if raw else 'NULL'} AS weighted",
        f"coalesce({analyzed(f'concat({lists})')}, {tx.EMPTY}) AS findings",
    )


def detector_rows(found: DataFrame, detectors: Sequence[Detector | FrameDetector] | None = None) -> DataFrame:
    """Long form of ``detect``: ``(repo_id, path, detector, score, findings)`` of analyzed files."""
    detectors = builtin_detectors() if detectors is None else detectors
    rows = [
        tx.row({"detector": literal(d.name), "score": f"{d.name}_score", "findings": f"{d.name}_findings"})
        for d in detectors
    ]
    return found.where("status = 'analyzed'").selectExpr(*KEYS, f"inline(array({', '.join(rows)}))")


def at_least(results: DataFrame, threshold: int) -> DataFrame:
    """Keep analyzed files from ``threshold`` up, and all skipped and error rows."""
    return results.where((F.col("status") != "analyzed") | (F.col("final_score") >= threshold))


def ranked(results: DataFrame) -> DataFrame:
    """Analyzed files first, highest score first, ties by repository and path."""
    analyzed = F.col("status") == "analyzed"
    return results.orderBy(analyzed.desc(), F.coalesce("final_score", F.lit(0)).desc(), *KEYS)


def placed(ordered: DataFrame, folder: str, place: str) -> DataFrame:
    """``ordered`` (a globally sorted frame) with each row's ``place`` (from 1), by way of a table in ``folder``.

    The order is dealt to tasks by range; each task's rows are counted and its
    places start behind those of the tasks before it, so no task sees more than
    its own share.
    """
    here = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered.select("*", F.spark_partition_id().alias("_task"), here.alias("_place")).write.parquet(folder)
    written = ordered.sparkSession.read.parquet(folder)
    sizes = written.groupBy("_task").count().withColumnRenamed("count", "_size")
    # one row per task of the sort
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_task", before.alias("_before"))
    return written.join(F.broadcast(starts), "_task").withColumn(place, F.col("_before") + F.col("_place") + 1).drop("_task", "_place", "_before")


def numbered(results: DataFrame, folder: str) -> DataFrame:
    """``results`` with ``file_rank``, their place (from 1) in the order of ``ranked``, by way of a table in ``folder``."""
    return placed(ranked(results), folder, "file_rank")
