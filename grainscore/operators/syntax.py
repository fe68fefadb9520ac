"""Syntax facts: one distributed parse of every file.

The parse runs in an Arrow UDF, so only the text goes to the Python worker and
only the facts come back; all other columns, the content included, stay in the
JVM.  No shuffle is involved and a file that cannot be parsed costs one row
with a status, never a failed task.
"""

from __future__ import annotations

import ast
import gc
import hashlib
import sys
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

# Ship the helpers inside the UDF, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SLICE_CHARS = 4 << 20

_FUNCTION = pa.struct(
    [
        ("pos", pa.int32()),
        ("name", pa.string()),
        ("is_async", pa.bool_()),
        ("n_args", pa.int32()),
        ("fingerprint", pa.string()),
        ("body_types", pa.list_(pa.string())),
        ("n_body", pa.int32()),
        ("has_docstring", pa.bool_()),
        ("doc_lines", pa.int32()),
        ("only_stub", pa.bool_()),
        ("raises_nie", pa.bool_()),
    ]
)
_NAME = pa.struct([("pos", pa.int32()), ("name", pa.string()), ("kind", pa.string())])
_CALL = pa.struct([("base", pa.string()), ("attr", pa.string()), ("shell_true", pa.bool_())])
_DOCSTRING = pa.struct([("owner", pa.string()), ("text", pa.string()), ("n_lines", pa.int32())])
_FACTS = pa.struct(
    [
        ("parse_status", pa.string()),
        ("parse_error", pa.string()),
        ("functions", pa.list_(_FUNCTION)),
        ("names", pa.list_(_NAME)),
        ("imports", pa.list_(pa.string())),
        ("calls", pa.list_(_CALL)),
        ("docstrings", pa.list_(_DOCSTRING)),
        ("n_asserts", pa.int32()),
    ]
)

FACTS_TYPE = from_arrow_type(_FACTS)


def _docstring(body: list) -> str | None:
    """Text of a leading string expression."""
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant):
        if isinstance(body[0].value.value, str):
            return body[0].value.value
    return None


def _is_stub(stmt: ast.stmt) -> bool:
    if isinstance(stmt, ast.Expr) and isinstance(stmt.value, ast.Constant):
        return isinstance(stmt.value.value, str) or stmt.value.value is ...
    return isinstance(stmt, ast.Pass)


def _is_not_implemented(stmt: ast.stmt) -> bool:
    raised = stmt.exc if isinstance(stmt, ast.Raise) else None
    if isinstance(raised, ast.Call):
        raised = raised.func
    return isinstance(raised, ast.Name) and raised.id == "NotImplementedError"


def _line_count(text: str) -> int:
    return sum(1 for line in text.splitlines() if line.strip())


def _encodable(text: str) -> str:
    """Lone surrogates from string escapes cannot leave Python as UTF-8."""
    return text.encode("utf-8", "replace").decode("utf-8")


def _file_facts(text: str) -> dict:
    """Facts of one file, from a single breadth-first pass over its syntax tree.

    Every visited node adds its type to the trail of each function around it.
    A breadth-first order restricted to a subtree is that subtree's own
    breadth-first order, so no function is walked a second time.
    """
    functions, trails, names, imports, calls, docstrings, asserts = [], [], [], [], [], [], 0
    visits: list[tuple[ast.AST, tuple]] = [(ast.parse(text), ())]
    for node, around in visits:
        kind = type(node)
        label = kind.__name__
        for trail in around:
            trail.append(label)
        if kind is ast.Name:
            if type(node.ctx) is ast.Store:
                names.append((node.id, "store"))
        elif kind is ast.Call:
            callee = node.func
            base, attr = None, None
            if isinstance(callee, ast.Name):
                base = callee.id
            elif isinstance(callee, ast.Attribute) and isinstance(callee.value, ast.Name):
                base, attr = callee.value.id, callee.attr
            if base is not None:
                shell = any(
                    k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True
                    for k in node.keywords
                )
                calls.append((base, attr, shell))
        elif kind is ast.Assign:
            names.extend((t.id, "target") for t in node.targets if isinstance(t, ast.Name))
        elif kind is ast.Import:
            imports.extend(alias.name.partition(".")[0] for alias in node.names)
        elif kind is ast.ImportFrom:
            if node.module:
                imports.append(node.module.partition(".")[0])
        elif kind is ast.Assert:
            asserts += 1
        elif kind in (ast.FunctionDef, ast.AsyncFunctionDef):
            names.extend((a.arg, "arg") for a in node.args.args)
            doc = _docstring(node.body)
            trail = [label]
            around = (*around, trail)
            trails.append(trail)
            functions.append(
                [
                    len(functions) + 1,
                    node.name,
                    kind is ast.AsyncFunctionDef,
                    len(node.args.args),
                    None,  # fingerprint, once the trail is complete
                    [type(stmt).__name__ for stmt in node.body],
                    len(node.body),
                    doc is not None,
                    _line_count(doc) if doc is not None else 0,
                    all(map(_is_stub, node.body)),
                    any(map(_is_not_implemented, node.body)),
                ]
            )
        if kind in (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef):
            doc = _docstring(node.body)
            if doc is not None:
                owner = getattr(node, "name", "<module>")
                docstrings.append((owner, _encodable(doc), _line_count(doc)))
        for field_name in node._fields:
            child = getattr(node, field_name, None)
            if type(child) is list:
                visits += [(item, around) for item in child if isinstance(item, ast.AST)]
            elif isinstance(child, ast.AST):
                visits.append((child, around))
    for function, trail in zip(functions, trails):
        function[4] = hashlib.md5("|".join(trail).encode()).hexdigest()
    return {
        "parse_status": "ok",
        "functions": functions,
        "names": [(i, n, k) for i, (n, k) in enumerate(names, start=1)],
        "imports": imports,
        "calls": calls,
        "docstrings": docstrings,
        "n_asserts": asserts,
    }


def _guarded_facts(text: str | None) -> dict | None:
    if text is None:
        return None
    try:
        return _file_facts(text)
    except SyntaxError:
        return {"parse_status": "syntax_error"}
    except Exception as error:  # the file gets an error row, the task goes on
        return {"parse_status": "error", "parse_error": _encodable(str(error))}


def _list_column(rows: list[dict | None], name: str) -> pa.Array:
    """List column of one kind of fact, built column by column."""
    item = _FACTS.field(name).type.value_type
    offsets, flat = [0], []
    for row in rows:
        flat += (row or {}).get(name, ())
        offsets.append(len(flat))
    if pa.types.is_struct(item):
        columns = list(zip(*flat)) if flat else [()] * item.num_fields
        arrays = [pa.array(c, type=item.field(k).type) for k, c in enumerate(columns)]
        values = pa.StructArray.from_arrays(arrays, fields=[item.field(k) for k in range(item.num_fields)])
    else:
        values = pa.array(flat, type=item)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _facts_array(rows: list[dict | None]) -> pa.Array:
    columns = []
    for k in range(_FACTS.num_fields):
        field = _FACTS.field(k)
        if pa.types.is_list(field.type):
            columns.append(_list_column(rows, field.name))
        else:
            columns.append(pa.array([(row or {}).get(field.name) for row in rows], type=field.type))
    missing = pa.array([row is None for row in rows], pa.bool_())
    return pa.StructArray.from_arrays(columns, fields=[_FACTS.field(k) for k in range(_FACTS.num_fields)], mask=missing)


def _slices(batch: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch in runs of about ``_SLICE_CHARS``."""
    texts, held = [], 0
    for value in batch:
        text = value.as_py()
        texts.append(text)
        held += len(text or "")
        if held >= _SLICE_CHARS:
            yield texts
            texts, held = [], 0
    if texts:
        yield texts


@arrow_udf(FACTS_TYPE)
def _parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    # facts are many times larger as Python objects than in Arrow, so only a slice of a batch is held as such
    for batch in batches:
        for texts in _slices(batch):
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                gc.disable()  # syntax trees hold no cycles; collections would only rescan them
                try:
                    rows = [_guarded_facts(text) for text in texts]
                finally:
                    gc.enable()
            yield _facts_array(rows)


def syntax_facts(text: Column) -> Column:
    """Facts struct of a text column; NULL text gives NULL facts."""
    return _parse(text)


def with_facts(admitted: DataFrame) -> DataFrame:
    """Add one column per kind of fact: ``parse_status`` (ok, syntax_error or error), ``parse_error``,
    ``functions``, ``names``, ``imports``, ``calls``, ``docstrings``, ``n_asserts``."""
    parsed = admitted.withColumn("facts", syntax_facts(F.col("text")))
    return parsed.selectExpr(*admitted.columns, *(f"facts.{f.name} AS {f.name}" for f in FACTS_TYPE.fields))


# Table views, one row per fact ------------------------------------------------


def function_table(facts: DataFrame, *keys: str) -> DataFrame:
    """One row per function definition at any depth, breadth-first position included."""
    return facts.select(*keys, F.inline("functions"))


def name_table(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.select(*keys, F.inline("names"))


def import_table(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.select(*keys, F.posexplode("imports").alias("pos", "module"))


def call_table(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.select(*keys, F.inline("calls"))


def docstring_table(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.select(*keys, F.inline("docstrings"))
