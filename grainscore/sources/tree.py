"""Directory trees as a corpus.

Listing and reading are separate steps, both in tasks.  A frontier of folders
is kept as a table: each round opens all its folders and walks on below them
until a task has met ``_ENTRIES`` names; the folders it leaves are the
next frontier.  Names are dealt out again before sizes are asked for, so one
folder with very many files is no single task's work.  Ignore files of the
roots are read in tasks too.  Extension and ignore filters run on the listing;
only the files that remain are read.  Unlike Spark's file sources, the listing
keeps names that start with ``_`` or ``.``.

``codefiles`` is a data source over many small trees, one task a root, which
takes filters on repository, suffix and size: a root that a filter excludes
is never opened.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from grainscore import fixed_values as fixed
from grainscore.functions.storage import scratch
from grainscore.sources import corpus, ignore
from grainscore.sources.ignore import compile_patterns

# Ship the helpers inside the tasks, so executors need no copy of this package.
for _module in (sys.modules[__name__], fixed, ignore):
    cloudpickle.register_pickle_by_value(_module)

_LISTING = "repo_id string, root string, path string, size_bytes bigint, read_error string"
_SOURCE = f"{_LISTING}, ext string"
_RULES = pa.list_(pa.struct([("regex", pa.string()), ("ignores", pa.bool_())]))
_FOUND = "repo_id string, root string, path string, is_folder boolean, read_error string, rules array<struct<regex: string, ignores: boolean>>"
_FOUND_ARROW = pa.schema(
    [
        ("repo_id", pa.string()),
        ("root", pa.string()),
        ("path", pa.string()),
        ("is_folder", pa.bool_()),
        ("read_error", pa.string()),
        ("rules", _RULES),
    ]
)
_ROOTS = "repo_id string, root string, patterns array<string>, rules array<struct<regex: string, ignores: boolean>>"
_ROOTS_ARROW = pa.schema([("repo_id", pa.string()), ("root", pa.string()), ("patterns", pa.list_(pa.string())), ("rules", _RULES)])
_READ = "repo_id string, path string, size_bytes bigint, read_error string, content binary"
_READ_ARROW = pa.schema(
    [
        ("repo_id", pa.string()),
        ("path", pa.string()),
        ("size_bytes", pa.int64()),
        ("read_error", pa.string()),
        ("content", pa.binary()),
    ]
)
_CHUNK_BYTES = 32 << 20
_ENTRIES = 20_000
_ROWS = 4096


def _is_pruned(path: str, rules: list[tuple[str, bool]]) -> bool:
    pruned = False
    for regex, ignores in rules:
        if re.fullmatch(regex, path, re.DOTALL):
            pruned = ignores
    return pruned


def _entries(root: str, folder: str, rules: list[tuple[str, bool]]) -> Iterator[tuple[str, bool]]:
    """(path below ``root``, is a folder) of what is directly in ``folder`` and not pruned; raises OSError."""
    with os.scandir(os.path.join(root, folder)) as entries:
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_dir(follow_symlinks=False):
                if not _is_pruned(path + "/", rules):
                    yield path, True
            elif not entry.is_dir():
                yield path, False


def _walk(root: str, folder: str, rules: list[tuple[str, bool]], budget: list[int]) -> Iterator[tuple[str, bool, str | None]]:
    """(path, is an unopened folder, error) below ``folder``, which is opened in any case; others while ``budget`` lasts."""
    todo = [folder]
    while todo:
        here = todo.pop()
        if here != folder and budget[0] <= 0:
            yield here, True, None
            continue
        try:
            for path, is_folder in _entries(root, here, rules):
                budget[0] -= 1
                if is_folder:
                    todo.append(path)
                else:
                    yield path, False, None
        except OSError as problem:
            yield f"{here}/", False, str(problem)


def _size(root: str, path: str) -> tuple[int | None, str | None]:
    try:
        return os.stat(os.path.join(root, path)).st_size, None
    except OSError as problem:
        return None, str(problem)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is below the folders of a frontier."""
    rows, budget = [], [_ENTRIES]
    for batch in batches:
        for row in batch.to_pylist():
            rules = [(r["regex"], r["ignores"]) for r in row["rules"] or []]
            for path, is_folder, error in _walk(row["root"], row["path"], rules, budget):
                own = row["rules"] if is_folder else None
                rows.append({"repo_id": row["repo_id"], "root": row["root"], "path": path, "is_folder": is_folder, "read_error": error, "rules": own})
                if len(rows) >= _ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_FOUND_ARROW)
                    rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=_FOUND_ARROW)


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, errors = [], []
        for root, path, error in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            size, problem = (None, error) if error is not None else _size(root, path)
            sizes.append(size)
            errors.append(problem)
        arrays = [*(batch.column(k) for k in range(3)), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["repo_id", "root", "path", "size_bytes", "read_error"])


def read_roots(roots: DataFrame, extra_ignore: Iterable[str] = (), use_gitignore: bool = True) -> DataFrame:
    """``(repo_id, root)`` with the pattern lines of each root's ignore file and all pruning rules, read in tasks."""
    general = [*fixed.DEFAULT_IGNORE_PATTERNS, *extra_ignore]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for row in batch.to_pylist():
                own = root_ignore_patterns(row["root"]) if use_gitignore else []
                rules = [{"regex": regex, "ignores": ignores} for regex, ignores in compile_patterns([*general, *own])]
                rows.append({**row, "patterns": own, "rules": rules})
            yield pa.RecordBatch.from_pylist(rows, schema=_ROOTS_ARROW)

    return roots.select("repo_id", "root").mapInArrow(batches, _ROOTS)


def list_names(roots: DataFrame, folder: str) -> DataFrame:
    """``(repo_id, root, path, read_error)`` below ``roots(repo_id, root, rules)``, by way of tables in ``folder``, one a round."""
    spark = roots.sparkSession
    frontier = roots.select("repo_id", "root", F.lit("").alias("path"), "rules")
    found: list[DataFrame] = []
    while True:
        path = f"{folder}/round={len(found)}"
        dealt = frontier.repartition(spark.sparkContext.defaultParallelism, "repo_id", "path")
        dealt.mapInArrow(_opened, _FOUND).write.parquet(path)
        opened = spark.read.schema(_FOUND).parquet(path)
        found.append(opened.where("NOT is_folder").select("repo_id", "root", "path", "read_error"))
        frontier = opened.where("is_folder")
        if frontier.isEmpty():
            break
    names = found[0]
    for more in found[1:]:
        names = names.unionByName(more)
    return names


def with_sizes(names: DataFrame) -> DataFrame:
    """``names`` dealt out by path, with ``size_bytes``."""
    dealt = names.repartition(names.sparkSession.sparkContext.defaultParallelism, "repo_id", "path")
    return dealt.select("repo_id", "root", "path", "read_error").mapInArrow(_sized, _LISTING)


class _Root(InputPartition):
    def __init__(self, repo_id: str, root: str):
        self.repo_id, self.root = repo_id, root


_COMPARED = {
    ds.EqualTo: lambda a, b: a == b,
    ds.GreaterThan: lambda a, b: a > b,
    ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b,
}
_OF_ROOT, _OF_NAME, _OF_SIZE = ("repo_id",), ("path", "ext"), ("size_bytes",)


def _passes(value, test) -> bool:
    """Whether a value passes a filter; a null passes none."""
    if value is None:
        return False
    if isinstance(test, ds.IsNotNull):
        return True
    if isinstance(test, ds.In):
        return value in test.value
    if isinstance(test, ds.StringEndsWith):
        return value.endswith(test.value)
    return _COMPARED[type(test)](value, test.value)


class _ListingReader(DataSourceReader):
    def __init__(self, roots: dict[str, str], rules: dict[str, list]):
        self.roots, self.rules = roots, rules
        self.tests: dict[str, list] = {name: [] for name in (*_OF_ROOT, *_OF_NAME, *_OF_SIZE)}

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Take comparisons, lists, suffixes and null tests on the columns a name or a size decides."""
        known = (*_COMPARED, ds.In, ds.StringEndsWith, ds.IsNotNull)
        for test in filters:
            name = test.attribute[0] if isinstance(test, known) and len(test.attribute) == 1 else None
            if name in self.tests:
                self.tests[name].append(test)
            else:
                yield test

    def _fit(self, name: str, value) -> bool:
        return all(_passes(value, test) for test in self.tests[name])

    def partitions(self) -> list[InputPartition]:
        """One task for each root that the filters leave; nothing is opened here."""
        return [_Root(repo_id, root) for repo_id, root in self.roots.items() if self._fit("repo_id", repo_id)]

    def read(self, part: _Root) -> Iterator[tuple]:
        for path, _, error in _walk(part.root, "", self.rules[part.repo_id], [sys.maxsize]):
            suffix = re.search(r"[^/](\.[^./]+)\Z", path)
            ext = suffix[1].lower() if suffix else ""
            if not (self._fit("path", path) and self._fit("ext", ext)):
                continue
            size, error = (None, error) if error is not None else _size(part.root, path)
            if self._fit("size_bytes", size):
                yield part.repo_id, part.root, path, size, error, ext


class CodeFiles(DataSource):
    """``spark.read.format("codefiles").option("roots", json)``: paths and sizes below folders.

    ``roots`` maps repository ids to folders, ``rules`` to pruning rules.
    Filters are taken while ``spark.sql.python.filterPushdown.enabled`` is set.
    """

    @classmethod
    def name(cls) -> str:
        return "codefiles"

    def schema(self) -> str:
        return _SOURCE

    def reader(self, schema) -> DataSourceReader:
        roots = json.loads(self.options["roots"])
        rules = json.loads(self.options.get("rules", "{}"))
        return _ListingReader(roots, {repo_id: [tuple(r) for r in rules.get(repo_id, [])] for repo_id in roots})


def small_trees(spark: SparkSession, roots: Mapping[str, str], rules: Mapping[str, list] | None = None) -> DataFrame:
    """``(repo_id, root, path, size_bytes, read_error, ext)`` of many small trees, through the ``codefiles`` source."""
    spark.dataSource.register(CodeFiles)
    reader = spark.read.format("codefiles").option("roots", json.dumps(dict(roots)))
    return reader.option("rules", json.dumps(dict(rules or {}))).load()


def _roots_table(spark: SparkSession, roots: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(list(roots.items()), "repo_id string, root string")


def list_tree(spark: SparkSession, roots: Mapping[str, str] | DataFrame, rules: Mapping[str, list] | None = None) -> DataFrame:
    """``(repo_id, root, path, size_bytes, read_error)`` of every file below the roots, a mapping or a table.

    ``rules`` maps repositories to pruning rules.  A folder that cannot be
    listed is a row too, its path ends in a slash.
    """
    table = roots if isinstance(roots, DataFrame) else _roots_table(spark, roots)
    pruning = [(repo_id, [{"regex": regex, "ignores": ignores} for regex, ignores in own]) for repo_id, own in (rules or {}).items()]
    ruled = spark.createDataFrame(pruning, "repo_id string, rules array<struct<regex: string, ignores: boolean>>")
    return with_sizes(list_names(table.join(ruled, "repo_id", "left"), scratch(spark)))


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of listed files, in record batches of bounded size."""
    rows, held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            root, content = row.pop("root"), None
            if row["read_error"] is None and 0 < row["size_bytes"] <= fixed.MAX_FILE_BYTES:
                try:
                    with open(os.path.join(root, row["path"]), "rb") as file:
                        content = file.read()
                except OSError as problem:
                    row["read_error"] = str(problem)
            rows.append({**row, "content": content})
            held += len(content or b"") + 200
            if held >= _CHUNK_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)


def read_contents(listing: DataFrame) -> DataFrame:
    """Corpus rows for a listing; a file that cannot be read keeps its error."""
    narrow = listing.select("repo_id", "root", "path", "size_bytes", "read_error")
    # paths only: a few bytes a file, dealt out so that every core reads
    dealt = narrow.repartition(listing.sparkSession.sparkContext.defaultParallelism, *corpus.KEYS)
    rows = dealt.mapInArrow(_read_batches, _READ)
    return rows.selectExpr(
        "repo_id",
        "path",
        f"lower({corpus.SUFFIX.format('path')}) AS ext",
        "CASE WHEN read_error IS NULL THEN size_bytes ELSE coalesce(size_bytes, 1) END AS size_bytes",
        "content",
        "read_error",
    )


def root_ignore_patterns(root: str) -> list[str]:
    """Pattern lines of a root's ignore file; none when any of them is invalid."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="ignore") as file:
            lines = file.read().splitlines()
        compile_patterns(lines)
    except (OSError, ValueError):
        return []
    return [line for line in lines if line.strip() and not line.startswith("#")]


def unreadable_folders(spark: SparkSession, roots: Mapping[str, str] | DataFrame, rules: Mapping[str, list] | None = None) -> DataFrame:
    """``(repo_id, path, read_error)`` of the folders whose files are missing from a corpus of these roots."""
    return list_tree(spark, roots, rules).where("endswith(path, '/')").select("repo_id", "path", "read_error")


def read_code_tree(
    spark: SparkSession,
    roots: str | Mapping[str, str] | DataFrame,
    extra_ignore: Iterable[str] = (),
    use_gitignore: bool = True,
) -> DataFrame:
    """Corpus of one folder, or of several given as ``{repo_id: folder}`` or as a table ``(repo_id, root)``.

    Order of ignore patterns: defaults, ``extra_ignore``, the root's own file.
    A single file is a corpus of one row, whatever its type and the patterns.
    The folders must be mounted on all executors; a large corpus is better
    kept in a table.  ``unreadable_folders`` tells what could not be listed.
    """
    if isinstance(roots, str) and os.path.isfile(roots):
        folder, name = os.path.split(os.path.abspath(roots))
        row = [(roots, folder, name, os.path.getsize(roots), None)]
        return read_contents(spark.createDataFrame(row, "repo_id string, root string, path string, size_bytes long, read_error string"))
    if not isinstance(roots, DataFrame):
        named = {roots: roots} if isinstance(roots, str) else dict(roots)
        missing = [folder for folder in named.values() if not os.path.isdir(folder)]
        if missing:
            raise ValueError(f"Path does not exist: {missing[0]}")
        roots = _roots_table(spark, named)
    extra, folder = list(extra_ignore), scratch(spark)
    read_roots(roots, extra, use_gitignore).write.parquet(f"{folder}/roots")
    ruled = spark.read.schema(_ROOTS).parquet(f"{folder}/roots")
    names = corpus.filter_extensions(list_names(ruled, f"{folder}/names"))
    patterns = ruled.selectExpr("repo_id", "posexplode(patterns) AS (ord, pattern)")
    return read_contents(with_sizes(ignore.filter_ignored(names, patterns, extra)))
