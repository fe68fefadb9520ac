"""Scores source-code corpora for careless or machine-made patterns, on Spark."""

from grainscore.operators.registry import Detector, FrameDetector, builtin_detectors, imports_from_tables, per_file
from grainscore.plans.scoring import at_least, detect, ranked, score_files
from grainscore.sources.corpus import files_from_table

__version__ = "0.1.0"

__all__ = [
    "Detector",
    "FrameDetector",
    "at_least",
    "builtin_detectors",
    "detect",
    "files_from_table",
    "imports_from_tables",
    "per_file",
    "ranked",
    "score_files",
]
