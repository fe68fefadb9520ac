"""A few registered queries against their SQL; tools/compare.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "corpus_scan", "repo_ignore", "text_decode", "line_split", "function_facts", "repeated_blocks_in_row_documents",
    "comment_measures_annotated", "secret_scan_documents", "file_scores_code", "repo_summary_annotated", "all_findings", "detail_cards",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    frame = entry.queries()[name](spark, FOLDER)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == canonical(names, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
