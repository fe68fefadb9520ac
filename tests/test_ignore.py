import pytest

from grainscore.sources import ignore

CASES = [
    (["build/"], "build/a.py", True),
    (["build/"], "x/build/a.py", True),
    (["build/"], "build", False),
    (["/made"], "x/made/a.py", False),
    (["/made"], "made/a.py", True),
    (["*.gen.py"], "a/b.gen.py", True),
    (["*.gen.py"], "a/b.gen.pyx", False),
    (["a/*.py"], "a/b.py", True),
    (["a/*.py"], "a/c/b.py", False),
    (["a/**/b.py"], "a/b.py", True),
    (["a/**/b.py"], "a/x/y/b.py", True),
    (["**/foo"], "x/foo/y.py", True),
    (["foo/**"], "foo/y.py", True),
    (["foo/**"], "foo", False),
    (["f?o.[ch]"], "x/fzo.h", True),
    (["f?o.[!ch]"], "fzo.h", False),
    (["*.py", "!keep.py"], "keep.py", False),
    (["*.py", "!keep.py"], "drop.py", True),
    (["out/", "!out/keep.py"], "out/keep.py", True),
    (["!keep.log"], "keep.log", False),
    (["# note", "", "  "], "note", False),
    (["a\\*b"], "a*b", True),
    (["a\\*b"], "axb", False),
]


@pytest.mark.parametrize("broadcast_limit", [1 << 20, 500])
def test_patterns(spark, broadcast_limit):
    files = spark.createDataFrame([(str(k), path) for k, (_, path, _) in enumerate(CASES)], "repo_id string, path string")
    table = spark.createDataFrame(
        [(str(k), o, p) for k, (patterns, _, _) in enumerate(CASES) for o, p in enumerate(patterns)],
        "repo_id string, ord int, pattern string",
    )
    kept = ignore.filter_ignored(files, table, broadcast_limit=broadcast_limit)
    assert {int(r.repo_id) for r in kept.collect()} == {k for k, c in enumerate(CASES) if not c[2]}


def test_literal_patterns_agree(spark):
    for patterns, path, expected in CASES:
        row = spark.sql(f"SELECT {ignore.is_ignored('p', patterns)} AS out FROM VALUES ({ignore.literal(path)}) AS t(p)").first()
        assert row.out == expected, (patterns, path)


def test_invalid_line_drops_the_list(spark):
    table = spark.createDataFrame([("r", 0, "*.py"), ("r", 1, "!")], "repo_id string, ord int, pattern string")
    files = spark.createDataFrame([("r", "a.py")], "repo_id string, path string")
    assert ignore.filter_ignored(files, table).count() == 1


@pytest.mark.parametrize("broadcast_limit", [1 << 20, 500])
def test_unknown_imports_any_size(spark, broadcast_limit):
    from grainscore.operators.imports import unknown_imports

    rows = spark.createDataFrame([("a", "os"), ("a", "zz"), ("a", "zz"), ("b", "os"), ("b", "yy")], "path string, module string")
    known = spark.createDataFrame([("os",), ("os",)], "module string")
    found = unknown_imports(rows, known, broadcast_limit).collect()
    assert sorted((r.path, r.module) for r in found) == [("a", "zz"), ("b", "yy")]


@pytest.mark.parametrize("limit", [64 << 20, 1000])
def test_result_does_not_depend_on_the_number_of_rules(spark, limit):
    """One broadcast or many: the same rows, null keys included."""
    files = spark.createDataFrame(
        [("r1", "a.py"), ("r1", "gen/b.py"), ("r2", "gen/b.py"), (None, "z.py"), (None, "build/z.py"), ("r3", None)], "repo_id string, path string"
    )
    rules = spark.createDataFrame([("r1", 0, "gen/"), (None, 0, "*.py"), *((f"x{i}", 0, "*") for i in range(50))], "repo_id string, ord int, pattern string")
    kept = ignore.filter_ignored(files, rules, broadcast_limit=limit)
    assert {(r.repo_id, r.path) for r in kept.collect()} == {("r1", "a.py"), ("r2", "gen/b.py"), (None, "z.py"), ("r3", None)}
    assert "Exchange hashpartitioning(path" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept._jdf.queryExecution().executedPlan().toString().count("LeftOuter") > (1 if limit < 1000 else 0)


@pytest.mark.parametrize("limit", [64 << 20, 1000])
def test_unknown_imports_keep_rows_without_module(spark, limit):
    from grainscore.operators.imports import unknown_imports

    rows = spark.createDataFrame([("p1", "os"), ("p1", None), ("p1", "zz"), ("p2", "zz"), ("p2", "zz"), (None, "os"), (None, "yy")], "path string, module string")
    known = spark.createDataFrame([("os",), (None,), *((f"m{i}",) for i in range(50))], "module string")
    found = unknown_imports(rows, known, limit)
    assert sorted(map(str, ((r.path, r.module) for r in found.collect()))) == sorted(map(str, [("p1", None), ("p1", "zz"), ("p2", "zz"), (None, "yy")]))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
