"""Imports of modules that are not known, in Python files.

The lists of known modules are sets of a fixed size that ship with the plan as
literals, so the exclusion is a hash-set probe inside the row.  Tables of known
modules (of several interpreter versions) and of modules installed per
repository, of any size, go through ``rows_against_tables``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainscore import fixed_values as fixed
from grainscore.functions import text as tx
from grainscore.functions.joins import BROADCAST_LIMIT, broadcast_parts, number_of_parts
from grainscore.functions.patterns import literal
from grainscore.sources.corpus import KEYS


def known_modules() -> list[str]:
    return fixed.standard_library_modules() + fixed.KNOWN_THIRD_PARTY


def _among(module: str, modules: list[str]) -> str:
    return f"{module} IN ({', '.join(map(literal, modules))})" if modules else "false"


def looks_invented(module: str) -> str:
    """Name starts with a suspicious prefix, or ends with it less its final underscore."""
    starts = "|".join(fixed.SUSPICIOUS_MODULE_PREFIXES)
    ends = "|".join(p.rstrip("_") for p in fixed.SUSPICIOUS_MODULE_PREFIXES)
    pattern = literal(rf"^(?:{starts})|(?:{ends})\z")
    return f"rlike(lower({module}), {pattern})"


def unknown_imports(
    import_rows: DataFrame, known: DataFrame, broadcast_limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Table form: distinct ``(keys, module)`` rows whose module is not in ``known(module)``.

    ``known`` is broadcast in parts of at most ``broadcast_limit``, and each
    part excludes its own modules, so the rows are only exchanged to become
    distinct, by all their columns, and no module is a hot key.  A row without
    a module is not known.
    """
    keys = [c for c in import_rows.columns if c not in ("pos", "module")]
    rows = import_rows.select(*keys, "module").distinct()
    modules = known.select("module").where("module IS NOT NULL").distinct()
    for part in broadcast_parts(modules, "module", number_of_parts(known.select("module"), broadcast_limit)):
        rows = rows.join(part, "module", "left_anti")
    return rows


def known_table(spark: SparkSession, version: str | None = None) -> DataFrame:
    """``(version, module)``: the known modules of the planning interpreter, under its version or the given name.

    Stored once, the table pins the list whatever interpreter plans later jobs;
    rows of further versions can be added to it.
    """
    name = version or f"{sys.version_info.major}.{sys.version_info.minor}"
    return spark.createDataFrame([(name, m) for m in known_modules()], "version string, module string")


def _marked(rows: DataFrame, table: DataFrame, keys: list[str], name: str, broadcast_limit: int) -> DataFrame:
    """``rows`` with the column ``name``: whether ``table`` has their keys, null keys included; ``table`` is broadcast in parts."""
    table = table.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    marks = []
    for k, part in enumerate(broadcast_parts(table, f"_{keys[-1]}", number_of_parts(table, broadcast_limit))):
        marks.append(f"_mark_{k}")
        marked = part.withColumn(marks[-1], F.lit(True))
        same = reduce(and_, (rows[k].eqNullSafe(marked[f"_{k}"]) for k in keys))
        rows = rows.join(F.broadcast(marked), same, "left").drop(*(f"_{k}" for k in keys))
    return rows.withColumn(name, F.coalesce(*marks, F.lit(False))).drop(*marks)


def rows_against_tables(
    files: DataFrame,
    known: DataFrame,
    installed: DataFrame | None = None,
    version: str | None = None,
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """``(repo_id, path, score, findings)`` of parsed files against module tables of any size.

    ``known`` has ``module`` and, if several lists are kept in it, ``version``, of which one is
    chosen; ``installed`` has ``(repo_id, module)``: what resolves in that
    repository, or in files without one.  Only names of modules are exchanged.
    """
    if version is not None:
        known = known.where(F.col("version") == version)
    rows = files.where("is_py AND parse_status = 'ok'").select(*KEYS, F.explode(F.array_distinct("imports")).alias("module"))
    rows = _marked(rows, known.where("module IS NOT NULL"), ["module"], "known", broadcast_limit)
    if installed is None:
        rows = rows.withColumn("installed", F.lit(False))
    else:
        rows = _marked(rows, installed.where("module IS NOT NULL"), ["repo_id", "module"], "installed", broadcast_limit)
    invented = looks_invented("module")
    return (
        rows.groupBy(*KEYS)
        .agg(
            F.size(F.collect_set("module")).alias("imp_total"),
            F.expr(f"collect_set(CASE WHEN NOT known AND {invented} THEN module END)").alias("imp_suspicious"),
            F.expr(f"collect_set(CASE WHEN NOT known AND NOT {invented} AND NOT installed THEN module END)").alias("imp_unresolvable"),
        )
        .selectExpr(*KEYS, f"{SCORE} AS score", f"{FINDINGS} AS findings")
    )


def measures(known: Iterable[str] | None = None, installed: Iterable[str] = ()) -> list[dict[str, str]]:
    """Measures against explicit module lists; ``installed`` modules count as resolvable."""
    known = list(known_modules() if known is None else known)
    applies = "is_py AND parse_status = 'ok'"
    unresolvable = f"NOT {looks_invented('m')} AND NOT {_among('m', list(installed))}"
    return [
        {
            "imp_total": f"CASE WHEN {applies} THEN size(array_distinct(imports)) ELSE 0 END",
            "imp_unknown": tx.listed(
                applies, f"filter(array_distinct(imports), m -> NOT {_among('m', known)})"
            ),
        },
        {
            "imp_suspicious": f"filter(imp_unknown, m -> {looks_invented('m')})",
            "imp_unresolvable": f"filter(imp_unknown, m -> {unresolvable})",
        },
    ]


SCORE = (
    "CASE WHEN imp_total > 0 THEN least(1.0D, size(imp_suspicious) / imp_total * 0.8D "
    "+ size(imp_unresolvable) / imp_total * 0.3D) ELSE 0.0D END"
)

_UNRESOLVABLE = "Unresolvable imports (not in stdlib/known packages, may be local or hallucinated): "

FINDINGS = (
    "concat("
    + tx.listed(
        "size(imp_suspicious) > 0",
        tx.joined("Suspicious module names (likely hallucinated): ", "sort_array(imp_suspicious)"),
    )
    + ", "
    + tx.listed("size(imp_unresolvable) > 0", tx.joined(_UNRESOLVABLE, "sort_array(imp_unresolvable)"))
    + ")"
)
