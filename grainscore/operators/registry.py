"""Detectors by name.

A ``Detector`` contributes measures over the prepared file row, a score and
findings, all as SQL expressions on that row: adding one never adds a shuffle.

A ``FrameDetector`` is a function from the analyzed files to rows of (keys, score,
findings): it may join files with other tables or with each other, aggregate
over the corpus, or run Python.  Its rows are brought to the results by key,
without any contents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainscore import fixed_values as fixed
from grainscore.functions import text as tx
from grainscore.operators import comments, imports, naming, placeholders, ratio, repetitive, security
from grainscore.sources.corpus import KEYS


@dataclass(frozen=True)
class Detector:
    """``score`` is a 0-1 double expression, ``findings`` an array<string> expression.

    Available to both: ``repo_id, path, ext, size_bytes, is_py_ext, is_py, text,
    lines, hash_lines`` (the last two unless ``uses_lines`` is off), the facts
    ``parse_status, functions, names, imports, calls, docstrings, n_asserts`` and
    the columns named in ``measures``, which are added level by level.
    """

    name: str
    score: str
    findings: str = tx.EMPTY
    measures: list[dict[str, str]] = field(default_factory=list)
    weight: float | None = None
    uses_lines: bool = True

    @property
    def effective_weight(self) -> float:
        return self.weight if self.weight is not None else fixed.DETECTOR_WEIGHTS.get(self.name, fixed.DEFAULT_WEIGHT)


@dataclass(frozen=True)
class FrameDetector:
    """``compute`` gets the analyzed files and returns ``repo_id, path, score, findings`` and, if it likes, ``error``.

    The files have ``repo_id, path, ext, size_bytes, is_py_ext, is_py, text`` and,
    unless ``uses_facts`` is off, the syntax facts.  A file without a row scores
    0; of several rows of one key the highest score and all findings, sorted,
    count; a null score is 0; scores are held between 0 and 1.  A row with an
    ``error`` makes its file an error row, as a failing parse does.
    """

    name: str
    compute: Callable[[DataFrame], DataFrame]
    weight: float | None = None
    uses_facts: bool = True

    @property
    def effective_weight(self) -> float:
        return self.weight if self.weight is not None else fixed.DETECTOR_WEIGHTS.get(self.name, fixed.DEFAULT_WEIGHT)

    def rows(self, files: DataFrame) -> DataFrame:
        """One row per key: the keys as ``_repo_id`` and ``_path``, ``<name>_score``, ``<name>_findings``, ``<name>_error``."""
        found = self.compute(files)
        error = F.col("error").cast("string") if "error" in found.columns else F.lit(None).cast("string")
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("score").cast("double"), F.lit(0.0))))
        return (
            found.select(F.col(KEYS[0]).alias("_repo_id"), F.col(KEYS[1]).alias("_path"), score.alias("score"), "findings", error.alias("error"))
            .groupBy("_repo_id", "_path")
            .agg(
                F.max("score").alias(f"{self.name}_score"),
                F.sort_array(F.flatten(F.collect_list("findings"))).alias(f"{self.name}_findings"),
                F.min("error").alias(f"{self.name}_error"),
            )
        )


def per_file(
    name: str, detect: Callable[[str, str], tuple[float, list[str]]], weight: float | None = None
) -> FrameDetector:
    """A detector from a Python function ``(path, text) -> (score, findings)``, run over Arrow batches.

    What it raises for a file becomes that file's error, not the task's.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            scores, findings, errors = [], [], []
            for path, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    score, found = detect(path, text)
                    scores.append(float(score))
                    findings.append([str(f) for f in found])
                    errors.append(None)
                except Exception as problem:
                    scores.append(None)
                    findings.append([])
                    errors.append(str(problem) or type(problem).__name__)
            arrays = [batch.column(0), batch.column(1), pa.array(scores, pa.float64())]
            arrays += [pa.array(findings, pa.list_(pa.string())), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*KEYS, "score", "findings", "error"])

    schema = "repo_id string, path string, score double, findings array<string>, error string"
    return FrameDetector(name, lambda files: files.select(*KEYS, "text").mapInArrow(batches, schema), weight, uses_facts=False)


def imports_from_tables(known: DataFrame, installed: DataFrame | None = None, version: str | None = None) -> FrameDetector:
    """The imports detector against tables: ``known(module)`` or ``known(version, module)``, and ``installed(repo_id, module)``."""
    return FrameDetector("imports", lambda files: imports.rows_against_tables(files, known, installed, version))


def builtin_detectors(
    known: Iterable[str] | None = None, installed: Iterable[str] = (), only: Iterable[str] | None = None
) -> list[Detector]:
    """The built-in detectors in evaluation order, all seven or the named ones."""
    built_in = {
        "repetitive": Detector("repetitive", repetitive.SCORE, repetitive.FINDINGS, repetitive.MEASURES),
        "naming": Detector("naming", naming.SCORE, naming.FINDINGS, naming.MEASURES, uses_lines=False),
        "comments": Detector("comments", comments.SCORE, comments.FINDINGS, comments.MEASURES),
        "imports": Detector(
            "imports", imports.SCORE, imports.FINDINGS, imports.measures(known, installed), uses_lines=False
        ),
        "placeholders": Detector("placeholders", placeholders.SCORE, placeholders.FINDINGS, placeholders.MEASURES),
        "ratio": Detector("ratio", ratio.SCORE, ratio.FINDINGS, ratio.MEASURES),
        "security": Detector("security", security.SCORE, security.FINDINGS, security.MEASURES, uses_lines=False),
    }
    chosen = set(built_in if only is None else only)
    return [built_in[name] for name in fixed.DETECTORS if name in chosen]
