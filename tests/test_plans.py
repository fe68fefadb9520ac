"""Plan shape: what is shuffled, broadcast and pruned."""

import os

import pytest
from pyspark.sql import functions as F

from grainscore import files_from_table, score_files
from grainscore.plans import reports, rollup


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files"))
    rows = spark.range(200).selectExpr("concat('r', id % 3) AS repo_id", "concat('f', id, '.py') AS path", "concat('data = ', id) AS content")
    rows.write.partitionBy("repo_id").mode("overwrite").parquet(path)
    return files_from_table(spark.read.parquet(path))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scoring_does_not_shuffle(table):
    text = plan(score_files(table))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1


def test_summary_shuffles_counts_only(table):
    text = plan(rollup.repo_summary(score_files(table)))
    assert text.count("Exchange") == 1
    exchange = text[text.index("HashAggregate") :]
    assert "partial_avg" in exchange and "findings" not in text
    assert text.count("ArrowEvalPython") == 1


def test_key_filter_reaches_the_scan(table):
    text = plan(score_files(table).where("repo_id = 'r1'"))
    assert "PartitionFilters: [isnotnull(repo_id" in text
    filtered = plan(score_files(table).where("final_score >= 20"))
    assert filtered.count("ArrowEvalPython") == 1 and filtered.count("regexp_count") == plan(score_files(table)).count("regexp_count")


def test_top_rows_are_limited_before_the_exchange(spark, table, folder):
    stored = reports.store(score_files(table), folder)
    assert plan(reports.detail_rows(stored)).count("WindowGroupLimit") == 2


def test_partitioning_does_not_matter(spark, table):
    key = lambda r: r.path
    one = sorted(score_files(table.coalesce(1)).collect(), key=key)
    many = sorted(score_files(table.repartition(7)).collect(), key=key)
    assert one == many


def test_only_an_input_below_one_split_is_dealt_out(spark, table):
    from grainscore.sources.corpus import spread

    assert "Exchange" in plan(spread(table, "path"))
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert "Exchange" not in plan(spread(table, "path"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_building_a_frame_starts_no_job(spark, table, folder):
    from grainscore.sources import ignore
    from grainscore.sources.corpus import spread

    tracker = spark.sparkContext.statusTracker()
    spark.createDataFrame([("r1", 0, "gen/")], "repo_id string, ord int, pattern string").write.parquet(f"{folder}/rules")
    rules = spark.read.parquet(f"{folder}/rules")
    spark.sparkContext.setJobGroup("building", "")
    rollup.repo_summary(score_files(ignore.filter_ignored(spread(table, "path"), rules)))
    assert list(tracker.getJobIdsForGroup("building")) == []
    spark.sparkContext.setJobGroup("", "")


def test_ranks_follow_the_global_order(spark, table, folder):
    from grainscore.plans import scoring

    results = reports.store(score_files(table), f"{folder}/results")
    rows = scoring.numbered(results.repartition(5), f"{folder}/ranked").orderBy("file_rank").collect()
    assert [r.file_rank for r in rows] == list(range(1, 201))
    assert [(r.repo_id, r.path) for r in rows] == [(r.repo_id, r.path) for r in scoring.ranked(results).collect()]
