"""Scores: weighted file score, label bands, repository score."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainscore import fixed_values as fixed
from grainscore.functions import text as tx
from grainscore.functions.patterns import literal


def to_final(normalized: str) -> str:
    """SQL: 0-1 to an integer 0-100, rounded half-even."""
    return f"least(100, greatest(0, CAST(rint(({normalized}) * 100) AS INT)))"


def weighted_score(scores: Mapping[str, str], weights: Mapping[str, float] | None = None) -> str:
    """SQL: final score of named detector scores; unknown names get the default weight.

    Products are added in the order of ``scores`` and divided by the weight in use.
    """
    weights = {**fixed.DETECTOR_WEIGHTS, **(weights or {})}
    total, used = "0.0D", 0.0
    for name, score in scores.items():
        weight = weights.get(name, fixed.DEFAULT_WEIGHT)
        total, used = f"{total} + {score} * {weight!r}D", used + weight
    return to_final(f"({total}) / {used!r}D") if used > 0 else "0"


def weighted_contributions(scores: Mapping[str, str], weights: Mapping[str, float] | None = None) -> str:
    """SQL: struct of score times weight per detector."""
    weights = {**fixed.DETECTOR_WEIGHTS, **(weights or {})}
    return tx.row({n: f"{s} * {weights.get(n, fixed.DEFAULT_WEIGHT)!r}D" for n, s in scores.items()})


def _band(score: str, field: int) -> str:
    branches = " ".join(f"WHEN {score} >= {b[0]} THEN {literal(b[field])}" for b in fixed.SCORE_BANDS[:-1])
    return f"CASE WHEN {score} IS NULL THEN NULL {branches} ELSE {literal(fixed.SCORE_BANDS[-1][field])} END"


def score_label(score: str) -> str:
    return _band(score, 1)


def score_color(score: str) -> str:
    return _band(score, 2)


def repo_score(score: str) -> str:
    """SQL aggregate: half-even round of the mean of ``score ** 1.5`` on a 0-100 scale; 0 without files."""
    return f"coalesce(CAST(rint(avg(pow({score}, 1.5D)) / 1000.0D * 100) AS BIGINT), 0L)"


def score_long_form(detector_scores: DataFrame, *keys: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Score rows ``(keys, detector, score)``: any set of detectors, default weight for unknown ones.

    Weights are a literal map, so no join is keyed on the few detector names.
    One group holds one file's detectors, so the ordered sum stays small; it is
    ordered to make the floating-point result independent of arrival order.
    """
    known = {**fixed.DETECTOR_WEIGHTS, **(weights or {})}
    lookup = lambda values: f"try_element_at(map({', '.join(f'{literal(n)}, {v}' for n, v in values)}), detector)"
    term = tx.row(
        {
            "ord": f"coalesce({lookup((n, k) for k, n in enumerate(known))}, {len(known)})",
            "detector": "detector",
            "score": "score",
            "weight": f"coalesce({lookup((n, f'{w!r}D') for n, w in known.items())}, {fixed.DEFAULT_WEIGHT!r}D)",
        }
    )
    terms = detector_scores.selectExpr(*keys, f"{term} AS term")
    ordered = terms.groupBy(*keys).agg(F.expr("sort_array(collect_list(term))").alias("terms"))
    total = lambda value: f"aggregate(terms, 0.0D, (acc, t) -> acc + {value})"
    final = to_final(f"{total('t.score * t.weight')} / {total('t.weight')}")
    scored = ordered.selectExpr(*keys, f"{final} AS final_score")
    return scored.selectExpr(*keys, "final_score", f"{score_label('final_score')} AS label")
