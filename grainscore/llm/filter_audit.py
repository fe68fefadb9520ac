"""Filter interaction audit: what each filter removes after every prefix of the others.

Every filter is a stored table of the identities of the rows that fail it.
Rows that are in the same of these tables fare alike under every prefix, so one
left-semi and one left-anti join per filter first split the identities into
cells, at most two to the power of the number of filters; this is all the work
that grows with the corpus, and it moves identities, never texts.  Prefixes are
then followed over the cells: a left-anti join with the cells that a prefix's
filters fail leaves its survivors, a left-semi join of these with the next
filter's cells gives what it removes, a left-anti join with the survivors what
it would have removed (redundant).  Label losses and copies are counts on the
cells.

Filters see the columns ``text`` (null: empty) and ``words`` (its words).
``COPY_OF_SMALLER`` stands for the filter that fails a text which some smaller
identifier has too, table-wide; texts are compared by 128-bit hash.

Defined results: a null text is the empty text; a null part is the empty part;
repeated rows of one identifier, text and part are counted each; a null
identifier is smaller than none, has no smaller one and no labels; a labelled
document is good or toxic if any of its label rows says so; an empty table
gives no rows; no more than ``MAX_FILTERS`` filters (120 orders of five).
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainscore.llm.shared import cut

COPY_OF_SMALLER = "copy of smaller"
MAX_FILTERS = 6
SPACES = r"[\\x20\\x09-\\x0D]+"
LOSSES = {"good_lost": "quality = 1", "toxic_lost": "toxic = 1"}
STEP = "filter_order string, step int, filter string, prefix string"


def _facts(docs: DataFrame, filters: Mapping[str, str], doc: str, text: str, part: str) -> DataFrame:
    """One row per identity (k1, k2): doc, part, t1 and t2 (hash of the text), the filters it fails on its own, n rows."""
    read = docs.select(
        F.col(doc).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")
    )
    own = [f"CASE WHEN {rule} THEN '{name}' END" for name, rule in filters.items() if rule != COPY_OF_SMALLER]
    split = read.selectExpr("*", f"filter(split(text, '{SPACES}'), w -> w <> '') AS words")
    facts = split.selectExpr(
        "xxhash64(doc, text, part) AS k1",
        "xxhash64(part, text, doc, 2) AS k2",
        "doc",
        "part",
        "xxhash64(text) AS t1",
        "xxhash64(3, text) AS t2",
        f"array_compact(array({', '.join(own) or 'CAST(NULL AS string)'})) AS fails",
    )
    return facts.groupBy(*facts.columns).agg(F.count("*").alias("n"))


def _copies(facts: DataFrame) -> DataFrame:
    """Identities of texts that a smaller identifier has too: k1, k2."""
    least = cut(facts.groupBy("t1", "t2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"))
    return facts.join(least, ["t1", "t2"]).where("doc > least").select("k1", "k2")


def _split(rows: DataFrame, failing: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name`` added to the cell of those that are in ``failing``."""
    keys = ["k1", "k2"]
    hit = rows.join(failing, keys, "left_semi").withColumn("cell", F.array_append("cell", F.lit(name)))
    return hit.unionByName(rows.join(failing, keys, "left_anti"))


def cells(
    docs: DataFrame, filters: Mapping[str, str], labels: DataFrame, losses: Mapping[str, str] = LOSSES, doc: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """part, cell (the filters that fail, in their order), n, and a count per loss."""
    facts = cut(_facts(docs, filters, doc, text, part))
    marks = labels.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc"))
    marks = marks.agg(*(F.coalesce(F.max(F.expr(rule)), F.lit(False)).alias(loss) for loss, rule in losses.items()))
    rows = facts.join(marks, "doc", "left").select(
        "k1", "k2", "part", "n", *(F.when(F.col(loss), F.col("n")).otherwise(0).alias(loss) for loss in losses), F.array().cast("array<string>").alias("cell")
    )
    rows = cut(rows)
    for name, rule in filters.items():
        failing = _copies(facts) if rule == COPY_OF_SMALLER else facts.where(F.array_contains("fails", name)).select("k1", "k2")
        rows = cut(_split(rows, cut(failing), name))
    return rows.groupBy("part", "cell").agg(*(F.sum(c).alias(c) for c in ("n", *losses)))


def _of(names: tuple[str, ...] | list[str], every: list[str]) -> str:
    """Name of a set of filters."""
    return json.dumps([n for n in every if n in names])


def interactions(found: DataFrame, names: list[str], losses: Mapping[str, str] = LOSSES) -> DataFrame:
    """Survivors, removals, redundancies and losses of every order of ``names`` over the rows of ``cells``."""
    if len(names) > MAX_FILTERS:
        raise ValueError(f"more than {MAX_FILTERS} filters")
    spark = found.sparkSession
    prefixes = [(_of(some, names), n, n in some) for size in range(len(names)) for some in combinations(names, size) for n in names]
    tried = spark.createDataFrame(prefixes, "prefix string, filter string, applied boolean")
    before = json.dumps(sorted({p for p, _, _ in prefixes}))
    orders = [
        {"filter_order": "".join(o), "step": k + 1, "filter": o[k], "prefix": _of(o[:k], names)} for o in permutations(names) for k in range(len(names))
    ]
    counts = ["n", *losses]
    found = cut(found)
    failing = found.select(F.explode("cell").alias("filter"), "cell").distinct()
    # all below is over at most 2^filters cells a part
    under = found.withColumn("prefix", F.explode(F.from_json(F.lit(before), "array<string>")))
    stopped = tried.where("applied").join(failing, "filter").select("prefix", "cell").distinct()
    survivors = under.join(stopped, ["prefix", "cell"], "left_anti")
    offered = survivors.join(tried.where("NOT applied"), "prefix")
    removed = offered.join(failing, ["filter", "cell"], "left_semi").groupBy("part", "prefix", "filter").agg(*(F.sum(c).alias(c) for c in counts))
    gone = under.join(survivors.select("part", "prefix", "cell"), ["part", "prefix", "cell"], "left_anti")
    redundant = gone.join(tried.where("NOT applied"), "prefix").join(failing, ["filter", "cell"], "left_semi")
    redundant = redundant.groupBy("part", "prefix", "filter").agg(F.sum("n").alias("redundant"))
    unique = found.where(F.size("cell") == 1).select("part", F.col("cell")[0].alias("filter"), F.col("n").alias("unique_fails"))
    totals = found.groupBy("part").agg(F.sum("n").alias("total"))
    steps = totals.select("*", F.inline(F.from_json(F.lit(json.dumps(orders)), f"array<struct<{STEP}>>")))
    met = steps.join(removed, ["part", "prefix", "filter"], "left").join(redundant, ["part", "prefix", "filter"], "left").join(unique, ["part", "filter"], "left")
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)

    def whole(name: str):
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    return met.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum(whole("n")).over(so_far)).cast("long").alias("kept"),
        whole("n").alias("removed"),
        whole("redundant").alias("redundant"),
        whole("unique_fails").alias("unique_fails"),
        *(whole(loss).alias(loss) for loss in losses),
        F.sum(whole("n")).over(Window.partitionBy("part", "filter")).cast("long").alias("shapley"),
    )


def audit(
    docs: DataFrame, filters: Mapping[str, str], labels: DataFrame, losses: Mapping[str, str] = LOSSES, doc: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """One row per part, order of the filters and step."""
    return interactions(cells(docs, filters, labels, losses, doc, text, part), list(filters), losses)
