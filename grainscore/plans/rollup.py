"""Repository-level results.

All aggregates are algebraic, so each task reduces its rows to one record per
repository before the exchange; a repository of any size costs the same there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainscore import fixed_values as fixed
from grainscore.functions import scoring as sc


def repo_summary(results: DataFrame) -> DataFrame:
    """Counts by status, repository score, floor average, extremes and risk counts per ``repo_id``."""
    aggregates = {
        "total_files": "count(1)",
        "analyzed_files": "count_if(status = 'analyzed')",
        "skipped_files": "count_if(status = 'skipped')",
        "error_files": "count_if(status = 'error')",
        "repo_score": sc.repo_score("final_score"),
        "average_score": "coalesce(sum(final_score) div nullif(count(final_score), 0), 0)",
        "max_score": "max(final_score)",
        "min_score": "min(final_score)",
        "high_risk_files": f"count_if(final_score >= {fixed.HIGH_RISK})",
        "medium_risk_files": f"count_if(final_score >= {fixed.MEDIUM_RISK} AND final_score < {fixed.HIGH_RISK})",
    }
    grouped = results.groupBy("repo_id").agg(*(F.expr(e).alias(n) for n, e in aggregates.items()))
    return grouped.selectExpr("*", f"{sc.score_label('repo_score')} AS repo_label")


def quality_gate(results: DataFrame) -> DataFrame:
    """Per repository: does any analyzed file reach the high-risk score?"""
    return results.groupBy("repo_id").agg(
        F.coalesce(F.bool_or(F.col("final_score") >= fixed.HIGH_RISK), F.lit(False)).alias("failed")
    )
