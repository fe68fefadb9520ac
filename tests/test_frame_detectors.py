"""Detectors that are functions of frames, and module tables."""

import pytest
from pyspark.sql import functions as F

from grainscore import Detector, FrameDetector, builtin_detectors, detect, files_from_table, imports_from_tables, per_file, score_files
from grainscore import fixed_values as fixed
from grainscore.functions import joins
from grainscore.operators import imports
from grainscore.plans import rollup


def files(spark, rows):
    return files_from_table(spark.createDataFrame(rows, "repo_id string, path string, content string"))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rows_meet_files_by_null_safe_keys(spark):
    rows = [("r", "a.py", "x = 1\n"), (None, "a.py", "x = 1\n"), ("r", None, "x = 1\n"), ("r", "b.txt", "text\n"), ("r", "none.py", "x = 1\n"), ("r", "empty.py", "")]

    def compute(frame):
        assert {"text", "parse_status", "imports"} <= set(frame.columns)
        some = frame.where("path IS NULL OR path <> 'none.py'").select("repo_id", "path")
        return some.select("*", F.lit(0.5).alias("score"), F.array(F.lit("b")).alias("findings")).unionByName(
            some.select("*", F.lit(7.0).alias("score"), F.array(F.lit("a")).alias("findings"))
        )

    found = score_files(files(spark, rows), [FrameDetector("mine", compute, weight=1.0)]).collect()
    got = {(r.repo_id, r.path): (r.status, r.raw and r.raw.mine, r.final_score, r.findings) for r in found}
    some = ("analyzed", 1.0, 100, ["a", "b"])
    assert got == {
        ("r", "a.py"): some, (None, "a.py"): some, ("r", None): some, ("r", "b.txt"): some,
        ("r", "none.py"): ("analyzed", 0.0, 0, []), ("r", "empty.py"): ("skipped", None, None, []),
    }


def test_default_weight_and_order_with_in_row_detectors(spark):
    half = FrameDetector("half", lambda f: f.selectExpr("repo_id", "path", "0.5 AS score", "array('seen') AS findings"), uses_facts=False)
    assert half.effective_weight == fixed.DEFAULT_WEIGHT
    row = score_files(files(spark, [("r", "a.py", "x1 = 1\n")]), [*builtin_detectors(), half, Detector("last", "1.0D", "array('z')", weight=0.05)]).first()
    assert row.findings == ["seen", "z"] and row.final_score == round((0.5 * 0.05 + 0.05) / 1.1 * 100)
    assert [f.name for f in score_files(files(spark, [("r", "a.py", "")]), [half, Detector("d", "0.0D")]).schema["raw"].dataType.fields] == ["half", "d"]


def test_errors_are_captured_per_file(spark):
    def judge(path, text):
        if "bad" in path:
            raise RuntimeError("no such rule")
        if "odd" in path:
            return None, []
        return len(text) / 10, [f"{len(text)} letters"]

    rows = [("r", "good.py", "x = 1\n"), ("r", "bad.py", "x = 1\n"), ("r", "odd.py", "x = 1\n"), ("r", "deep.py", "-" * 50_000 + "1\n"), ("r", "e.py", "")]
    mine = per_file("mine", judge, weight=0.3)
    got = {r.path: r for r in score_files(files(spark, rows), [*builtin_detectors(), mine]).collect()}
    assert got["good.py"].raw.mine == 0.6 and "6 letters" in got["good.py"].findings
    for path in ("bad.py", "odd.py"):
        assert got[path].status == "error" and got[path].error.startswith("analysis error: ")
        assert got[path].final_score is None and got[path].raw is None and got[path].findings == []
    assert got["bad.py"].error == "analysis error: no such rule"
    assert got["deep.py"].status == "error" and got["e.py"].status == "skipped"
    long_form = {r.path: r for r in detect(files(spark, rows), [mine]).collect()}
    assert long_form["bad.py"].mine_score is None and long_form["good.py"].mine_findings == ["6 letters"]


def test_contents_are_not_exchanged(spark, folder):
    spark.range(100).selectExpr("'r' AS repo_id", "concat('f', id, '.py') AS path", "concat('import m', id) AS content").write.parquet(f"{folder}/files")
    table = files_from_table(spark.read.parquet(f"{folder}/files"))
    modules = FrameDetector("m", lambda f: f.selectExpr("repo_id", "path", "0.1 AS score", "imports AS findings"))
    text = plan(score_files(table, [*builtin_detectors(), modules]))
    for line in text.splitlines():
        if "Exchange" in line and "[" in line:
            assert "text#" not in line and "content#" not in line
    assert "Exchange" not in plan(score_files(table))
    summary = rollup.repo_summary(score_files(table, [*builtin_detectors(), modules]))
    assert summary.first().analyzed_files == 100


def test_module_tables_give_the_built_in_result(spark):
    rows = [("r", f"f{k}.py", f"import os, numpy, zzlocal, smart_tool{k}\nfrom .near import x\n") for k in range(4)] + [("r", "n.py", "x = 1\n"), ("r", "t.txt", "import zz\n"), ("r", "s.py", "import (\n")]
    frame = files(spark, rows)
    known = imports.known_table(spark)
    mine = {r.path: r for r in score_files(frame, [imports_from_tables(known)]).collect()}
    theirs = {r.path: r for r in score_files(frame, builtin_detectors(only=["imports"])).collect()}
    for path, row in theirs.items():
        assert (mine[path].final_score, mine[path].raw, mine[path].findings) == (row.final_score, row.raw, row.findings)


def test_a_stored_version_does_not_depend_on_the_interpreter(spark, folder, monkeypatch):
    imports.known_table(spark, "3.13").write.parquet(f"{folder}/known")
    frame = files(spark, [("r", "a.py", "import os, zzz, brand_new\n")])
    table = spark.read.parquet(f"{folder}/known").unionByName(spark.createDataFrame([("9.9", "brand_new"), ("3.13", None)], "version string, module string"))
    before = score_files(frame, [imports_from_tables(table, version="3.13")]).first()
    monkeypatch.setattr(imports, "known_modules", lambda: ["brand_new"])
    assert score_files(frame, [imports_from_tables(table, version="3.13")]).first() == before
    assert score_files(frame, [imports_from_tables(table, version="9.9")]).first().findings != before.findings


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_installed_modules_per_repository(spark, limit, monkeypatch):
    monkeypatch.setattr(imports.rows_against_tables, "__defaults__", (None, None, limit))
    frame = files(spark, [("a", "f.py", "import zz, yy\n"), ("b", "f.py", "import zz, yy\n"), (None, "f.py", "import zz, yy\n"), ("c", "f.py", "import zz, yy\n")])
    installed = spark.createDataFrame([("a", "zz"), ("a", "yy"), ("a", "zz"), ("b", "zz"), (None, "yy"), ("a", None)], "repo_id string, module string")
    known = spark.createDataFrame([("os",), (None,)], "module string")
    got = {r.repo_id: r.raw.imports for r in score_files(frame, [imports_from_tables(known, installed)]).collect()}
    assert got == {"a": 0.0, "b": 0.15, None: 0.15, "c": 0.3}


def test_parts_follow_the_rows_not_what_they_are_derived_from(spark, folder):
    spark.range(400_000).selectExpr("id", "repeat(cast(rand() AS string), 20) AS text").write.parquet(f"{folder}/large")
    derived = spark.read.parquet(f"{folder}/large").selectExpr("concat('r', id % 24) AS repo_id").distinct()
    assert joins.stored_bytes(derived) * joins.EXPANSION > joins.BROADCAST_LIMIT
    assert joins.number_of_parts(derived) == 1
    derived.write.parquet(f"{folder}/small")
    assert joins.is_stored(spark.read.parquet(f"{folder}/small").where("repo_id > 'r'")) and not joins.is_stored(derived)
    assert joins.number_of_parts(derived, limit=200) > 1
