import json
import os

import pytest
from pyspark.sql import functions as F

from grainscore import Detector, at_least, builtin_detectors, files_from_table, score_files
from grainscore.plans import reports


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    risky = 'password = "abcdefgh"\ntoken = "0123456789ab"\nsecret = "abcdefghi"\nimport smart_x\ndata = 1\n# TODO: a\n'
    twin = "".join(f"def process_{k}(data):\n    # return the result\n    pass\n" for k in range(9))
    rows = [(f"r{k % 2}", f"d/f{k}.py", risky * (k % 3) + (twin if k % 2 else "") + f"q{k} = {k}\n") for k in range(40)]
    rows += [("r0", "d/empty.py", ""), ("r0", "d/deep.py", "-" * 50_000 + "1\n"), ("r2", "only.py", "")]
    frame = spark.createDataFrame(rows, "repo_id string, path string, content string")
    return reports.store(score_files(files_from_table(frame)), str(tmp_path_factory.mktemp("stored")))


def read_document(folder):
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
    return json.loads("".join(open(f"{folder}/{p}", encoding="utf-8").read() for p in parts))


def test_json_documents(spark, stored, folder):
    reports.write_json_documents(stored, folder)
    results = {(r.repo_id, r.path): r for r in stored.collect()}
    seen = 0
    for repo in ("r0", "r1", "r2"):
        document = read_document(f"{folder}/documents/repo_id={repo}")
        files = document["files"]
        seen += len(files)
        assert document["summary"]["total_files"] == len(files)
        assert document["timestamp"].endswith("Z")
        ranks = [(results[repo, f["path"]].status != "analyzed", -f["vibe_score"], f["path"]) for f in files]
        assert ranks == sorted(ranks)
        for f in files:
            row = results[repo, f["path"]]
            assert f.get("findings", []) == row.findings
            if row.status == "analyzed":
                assert f["detector_scores"] == {n: round(v, 3) for n, v in row.raw.asDict().items()}
                assert f["score_label"] == row.label
            else:
                assert "detector_scores" not in f
    assert seen == stored.count()


def test_report_tables(spark, stored, folder):
    reports.write_reports(stored, folder, by_repo=True)
    assert spark.read.json(f"{folder}/files").count() == stored.count()
    assert spark.read.json(f"{folder}/summary").count() == 3
    details = reports.detail_rows(stored, files=3, findings=2).collect()
    assert max(r.file_rank for r in details) <= 3 and max(r.finding_no for r in details) <= 2
    assert [r.path for r in reports.error_rows(stored).collect()] == ["d/deep.py"]
    cards = reports.detail_cards(stored).collect()
    for c in cards:
        assert [d.detector for d in c.detectors] == sorted(d.detector for d in c.detectors)
        assert len(c.shown) == min(c.n_findings, 7)
    kept = at_least(stored, 30).collect()
    assert all(r.final_score is None or r.final_score >= 30 for r in kept)
    assert sum(r.status != "analyzed" for r in kept) == 3


def test_custom_detector(spark):
    rows = spark.createDataFrame([("r", "a.py", "x1 = 1\n")], "repo_id string, path string, content string")
    mine = Detector("mine", "0.5D", "array('seen')", weight=1.0)
    row = score_files(files_from_table(rows), [*builtin_detectors(), mine]).first()
    assert row.final_score == 25 and row.findings == ["seen"] and row.raw.mine == 0.5


def test_json_documents_of_null_and_repeated_keys(spark, folder):
    rows = [("r", "a.py", "x = 1\n")] * 3 + [("r", "a.py", "y = 2\n"), ("r", None, "z = 3\n"), (None, "b.py", "data = 1\n"), (None, "b.py", "data = 1\n"), (None, None, "")]
    frame = spark.createDataFrame(rows, "repo_id string, path string, content string").repartition(4)
    results = reports.store(score_files(files_from_table(frame)), f"{folder}/results")
    reports.write_json_documents(results, f"{folder}/json", F.lit("2026-01-02T00:00:00Z"))
    named = read_document(f"{folder}/json/documents/repo_id=r")
    nameless = read_document(f"{folder}/json/documents/repo_id=__HIVE_DEFAULT_PARTITION__")
    assert (named["timestamp"], named["scan_path"], nameless["scan_path"]) == ("2026-01-02T00:00:00Z", "r", "")
    assert sorted(str(f.get("path")) for f in named["files"]) == ["None"] + ["a.py"] * 4
    assert sorted(str(f.get("path")) for f in nameless["files"]) == ["None", "b.py", "b.py"]
    pieces = reports.json_documents(results, f"{folder}/pieces").orderBy("repo_id", "piece_no").collect()
    assert [p.piece_no for p in pieces if p.repo_id == "r"] == list(range(1, 8))


def test_a_re_score_of_one_repository_leaves_the_others(spark, stored, folder):
    reports.replace_repositories(stored, folder)
    names = [f.name for f in stored.schema["raw"].dataType.fields]
    before = {(r.repo_id, r.path): r for r in reports.read_files(spark, folder, names).collect()}
    files = {repo: sorted(os.listdir(f"{folder}/files/repo_id={repo}")) for repo in ("r0", "r1", "r2")}
    reports.replace_repositories(stored.where("repo_id = 'r1' AND final_score >= 20"), folder)
    after = {(r.repo_id, r.path): r for r in reports.read_files(spark, folder, names).collect()}
    assert {k: v for k, v in after.items() if k[0] != "r1"} == {k: v for k, v in before.items() if k[0] != "r1"}
    assert {k for k in after if k[0] == "r1"} == {("r1", r.path) for r in stored.where("repo_id = 'r1' AND final_score >= 20").collect()}
    for repo in ("r0", "r2"):
        assert sorted(os.listdir(f"{folder}/files/repo_id={repo}")) == files[repo]
    totals = {r.repo_id: r.total_files for r in spark.read.parquet(f"{folder}/summary").collect()}
    assert totals == {repo: sum(k[0] == repo for k in after) for repo in ("r0", "r1", "r2")}


def test_digest_of_a_large_repository(spark):
    """The sum of 48-bit marks passes a long at 65,536 and more pieces of a repository."""
    from workload.queries import _digest

    rows = spark.range(200_000).selectExpr("id % 3 = 0 AS repo", "(1L << 48) - 1 - id AS mark")
    got = {r.repo: r.digest for r in rows.groupBy("repo").agg(_digest(rows.mark).alias("digest")).collect()}
    marks = lambda repo: sum((1 << 48) - 1 - k for k in range(200_000) if (k % 3 == 0) == repo)
    assert got == {repo: marks(repo) % (1 << 63) for repo in (True, False)} and marks(False) >= 1 << 63
    few = spark.range(9).selectExpr("(1L << 48) - 1 - id AS mark")
    assert few.agg(_digest(few.mark)).first()[0] == sum((1 << 48) - 1 - k for k in range(9))
    assert few.where("mark < 0").agg(_digest(few.mark)).first()[0] is None
