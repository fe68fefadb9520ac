import pytest

from grainscore import fixed_values as fixed
from grainscore.functions import scoring as sc
from grainscore.plans import rollup


def scored(spark, values, weights=None):
    columns = {n: f"{v!r}D" for n, v in values.items()}
    return spark.range(1).selectExpr(f"{sc.weighted_score(columns, weights)} AS s").first().s


def test_weighted_score(spark):
    every = lambda v: {n: v for n in fixed.DETECTORS}
    assert [scored(spark, every(v)) for v in (0.0, 0.5, 1.0)] == [0, 50, 100]
    assert scored(spark, {}) == 0
    assert scored(spark, {"security": 1.5, "naming": 2.0}) == 100
    assert scored(spark, {"security": 1.0, "novel": 0.0}) == round(0.25 / 0.30 * 100)
    assert scored(spark, {"novel": 0.125}) == 12  # half-even


def test_labels(spark):
    rows = spark.sql("SELECT explode(array(0, 19, 20, 40, 60, 80, 100)) AS s").selectExpr("s", f"{sc.score_label('s')} AS l")
    assert [r.l.split()[0] for r in rows.orderBy("s").collect()] == "MOSTLY MOSTLY SLIGHTLY MODERATELY HEAVILY EXTREMELY EXTREMELY".split()


@pytest.mark.parametrize("scores, expected", [([], 0), ([0, 0, 0], 0), ([100] * 3, 100), ([10] * 4, 3), ([10, 10, 10, 90], 24), ([75], 65)])
def test_repo_score(spark, scores, expected):
    rows = [("r", "analyzed", s) for s in scores] + [("r", "skipped", None)]
    row = rollup.repo_summary(spark.createDataFrame(rows, "repo_id string, status string, final_score int")).first()
    assert row.repo_score == expected
    assert row.average_score == (sum(scores) // len(scores) if scores else 0)
    assert (row.total_files, row.skipped_files) == (len(scores) + 1, 1)


def test_quality_gate(spark):
    rows = spark.createDataFrame(
        [("a", "analyzed", 60), ("b", "analyzed", 59), ("c", "skipped", None)], "repo_id string, status string, final_score int"
    )
    assert {r.repo_id: r.failed for r in rollup.quality_gate(rows).collect()} == {"a": True, "b": False, "c": False}
