import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="grainscore-")


@pytest.fixture
def score(spark):
    """Results by path for ``{path: text}``."""
    from grainscore import detect, files_from_table

    def run(files):
        rows = spark.createDataFrame([("repo", p, c) for p, c in files.items()], "repo_id string, path string, content string")
        return {r["path"]: r for r in detect(files_from_table(rows)).collect()}

    return run
