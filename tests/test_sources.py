import os

import pytest

from grainscore import score_files
from grainscore.sources import tree
from grainscore.sources.corpus import files_from_table


def fill(folder, files):
    for path, raw in files.items():
        os.makedirs(os.path.dirname(os.path.join(folder, path)), exist_ok=True)
        with open(os.path.join(folder, path), "wb") as file:
            file.write(raw)


def test_tree_equals_table(spark, folder):
    files = {
        "pkg/__init__.py": b"import os\n",
        "_a.py": b"data = 1\n",
        ".b.py": b"# TODO: x\n",
        "UP.PY": b"temp = 1\n",
        "bad.py": b'v = "\xff caf\xc3\xa9"\r\nw = 1\r',
    }
    fill(folder, files)
    fill(folder, {"notes.md": b"x", "out/keep.py": b"x = 1", "venv/x.py": b"x = 1", ".gitignore": b"out/\n!keep.py\n"})
    os.symlink("/nonexistent", f"{folder}/dangling.py")
    read = {r.path: r for r in score_files(tree.read_code_tree(spark, folder)).collect()}
    assert set(read) == {*files, "dangling.py"}
    assert read["dangling.py"].status == "error" and "No such file" in read["dangling.py"].error
    rows = spark.createDataFrame([(folder, p, bytearray(c)) for p, c in files.items()], "repo_id string, path string, content binary")
    for r in score_files(files_from_table(rows)).collect():
        assert r == read[r.path]
    several = tree.read_code_tree(spark, {"a": folder, "b": f"{folder}/pkg"}, use_gitignore=False)
    assert {(r.repo_id, r.path) for r in several.collect()} >= {("a", "out/keep.py"), ("b", "__init__.py")}
    extra = tree.read_code_tree(spark, folder, extra_ignore=["*.py"], use_gitignore=False)
    assert {r.path for r in extra.collect()} == {"UP.PY"}


def test_missing_folder(spark):
    with pytest.raises(ValueError, match="does not exist"):
        tree.read_code_tree(spark, "/nonexistent/folder")


def test_stream_equals_batch(spark, folder):
    from grainscore.streaming import write_scores

    rows = spark.createDataFrame(
        [("r", f"f{k}.py", f"# TODO: {k}\ndata = {k}\n") for k in range(20)], "repo_id string, path string, content string"
    )
    files_from_table(rows).write.parquet(f"{folder}/in")
    stored = spark.read.parquet(f"{folder}/in")
    stream = spark.readStream.schema(stored.schema).parquet(f"{folder}/in")
    write_scores(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination(120)
    key = lambda r: r.path
    assert sorted(spark.read.parquet(f"{folder}/out").collect(), key=key) == sorted(score_files(stored).collect(), key=key)


def test_single_file(spark, folder):
    fill(folder, {"notes.txt": b"# TODO: x\n"})
    (row,) = tree.read_code_tree(spark, f"{folder}/notes.txt").collect()
    assert (row.path, bytes(row.content)) == ("notes.txt", b"# TODO: x\n")


def test_folders_that_cannot_be_listed_are_reported(spark, folder, monkeypatch):
    fill(folder, {"a/x.py": b"x = 1\n"})
    rows = tree._ListingReader({"r": folder, "s": f"{folder}/gone"}, {"r": [], "s": []})
    found = [row for part in rows.partitions() for row in rows.read(part)]
    assert [(r[0], r[2]) for r in found if r[4] is None] == [("r", "a/x.py")]
    assert [(r[0], r[2]) for r in found if r[4] is not None] == [("s", "/")]


def names(frame):
    return sorted((r.repo_id, r.path) for r in frame.collect())


def test_listing_goes_on_in_rounds(spark, folder, monkeypatch):
    monkeypatch.setattr(tree, "_ENTRIES", 3)
    files = {f"{a}/{b}/f{k}.py": b"x" * k for a in "abc" for b in "de" for k in range(3)}
    fill(folder, {**files, "top.py": b"x", "out/no.py": b"x", "a/d/deep/er/still/z.py": b"x"})
    rules = [(r"out/.*", True)]
    listed = tree.list_names(spark.createDataFrame([("r", folder, [{"regex": x, "ignores": y} for x, y in rules])], tree._ROOTS.replace("patterns array<string>, ", "")), f"{folder}-tables")
    assert names(listed) == sorted(("r", p) for p in {**files, "top.py": b"", "a/d/deep/er/still/z.py": b""})
    assert len(os.listdir(f"{folder}-tables")) > 2
    sizes = {r.path: r.size_bytes for r in tree.with_sizes(listed).collect()}
    assert all(sizes[p] == len(raw) for p, raw in files.items())


def test_one_flat_folder_of_many_names(spark, folder, monkeypatch):
    for k in range(100_000):
        os.close(os.open(f"{folder}/n{k}.py", os.O_CREAT))
    opened, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: opened.append(path) or scandir(path))
    corpus_rows = tree.read_code_tree(spark, folder)
    assert corpus_rows.where("size_bytes = 0 AND ext = '.py'").count() == 100_000 and corpus_rows.rdd.getNumPartitions() > 1
    assert opened == []


def test_roots_from_a_table_with_ignore_files_read_in_tasks(spark, folder):
    fill(folder, {"a/.gitignore": b"*.js\n", "a/x.js": b"1", "a/y.py": b"1", "b/x.js": b"1", "b/.gitignore": b"[bad\n", "c/gen/x.py": b"1", "c/.gitignore": b"gen/\n!gen/x.py\n"})
    roots = spark.createDataFrame([(r, f"{folder}/{r}") for r in "abc"] + [("gone", f"{folder}/gone")], "repo_id string, root string")
    assert names(tree.read_code_tree(spark, roots)) == [("a", "y.py"), ("b", "x.js")]
    assert names(tree.read_code_tree(spark, roots, use_gitignore=False)) == [("a", "x.js"), ("a", "y.py"), ("b", "x.js"), ("c", "gen/x.py")]
    assert [(r.repo_id, r.path) for r in tree.unreadable_folders(spark, roots).collect()] == [("gone", "/")]


def test_filters_reach_the_source(spark, folder):
    fill(folder, {"a/x.py": b"12345", "a/y.PY": b"1", "a/z.md": b"12345", "b/x.py": b"12345"})
    os.symlink("/nonexistent", f"{folder}/a/dangling.py")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        # a root that is opened although a filter excludes it would give an error row
        rows = tree.small_trees(spark, {"a": f"{folder}/a", "b": f"{folder}/b", "gone": f"{folder}/gone"})
        assert ("gone", "/") in names(rows) and ("a", "dangling.py") in names(rows)
        for test, want in {
            "repo_id = 'b'": [("b", "x.py")],
            "repo_id IN ('a', 'b') AND ext = '.py' AND size_bytes > 0": [("a", "x.py"), ("a", "y.PY"), ("b", "x.py")],
            "path LIKE '%.py' AND size_bytes >= 5 AND size_bytes <= 5": [("a", "x.py"), ("b", "x.py")],
            "repo_id = 'a' AND size_bytes < 5": [("a", "y.PY")],
            "repo_id = 'a' AND read_error IS NOT NULL": [("a", "dangling.py")],
            "repo_id = 'a' AND (ext = '.md' OR size_bytes = 1)": [("a", "y.PY"), ("a", "z.md")],
        }.items():
            found = rows.where(test)
            text = found._jdf.queryExecution().executedPlan().toString()
            assert names(found) == want, test
            # what the source has taken, Spark does not test again
            left = text.replace("RuntimeFilters", "")
            assert ("Filter" in left) == ("OR" in test or "read_error" in test) and "repo_id#" not in left.split("BatchScan")[0].partition("Filter")[2].partition("\n")[0]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = tree._ListingReader({"a": "/x", "b": "/y"}, {"a": [], "b": []})
    from pyspark.sql import datasource as ds

    left = list(reader.pushFilters([ds.EqualTo(("repo_id",), "b"), ds.StringContains(("path",), "q")]))
    assert [type(f) for f in left] == [ds.StringContains] and [p.repo_id for p in reader.partitions()] == ["b"]
