"""Substring dedup by seed and extend: words under repeated runs of words go.

A run of ``window`` words is repeated when the same words stand anywhere else
in the corpus, in the same text too; every word under a repeated run is
removed.

Seeds: winnowing picks in every run of ``window`` words the sequence of
``seed`` words with the least hash (the first of equals), so equal runs have
equal anchors at equal distances, and about 7 % of all places are anchors.
Texts are joined on anchors, and only anchors that stand elsewhere too go on.

Extension: an anchor is extended both ways over all runs that picked it.
Anchors whose whole extension is equal form a class; in a class of several
occurrences every run is repeated.  Where an anchor has several classes, as at
the two ends of a maximal repeat, one occurrence of each class is extended run
by run, and the runs that meet an equal one are kept.  Neighbouring kept runs
make up the maximal repeats.  No step lists pairs: occurrences look for one
partner in a semi join, which Spark can split when an anchor or a run is hot.

Anchors go by 64-bit hashes, whose collisions only make extra candidates;
extensions and runs are compared by 128 bits.

Defined results: null and empty texts have no words; texts of fewer words than
``window`` lose nothing; repeated rows count as texts of their own, so each
repeats the other; of equal texts none is kept whole, as all copies are
repeated; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainscore.llm.shared import cut, temporary
from grainscore.llm.words import BASES, hashed_words, sequences, signed

WINDOW = 35
SEED = 8
ROWS = 128


def anchors(hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first run, number of runs) of the anchors of one text."""
    n_seeds = len(hashes) - seed + 1
    width = window - seed + 1
    least = sequences(hashes, np.arange(n_seeds), seed)
    place = np.arange(n_seeds)
    grams, reach = least, 1
    while reach < width:
        by = min(reach, width - reach)
        later = least[by:] < least[:-by]
        place = np.where(later, place[by:], place[:-by])
        least = np.where(later, least[by:], least[:-by])
        reach += by
    firsts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    amounts = np.diff(np.append(firsts, len(place)))
    return grams[place[firsts]], place[firsts], firsts, amounts


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(
        F.xxhash64(F.col(doc), body, F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), body, F.col(doc)).alias("k2"), F.col(doc).alias("doc_id"), body.alias("text")
    )


def _seeds(keyed: DataFrame, window: int, seed: int) -> DataFrame:
    """Anchors with their extensions: k1, k2, anchor, e1, e2, start (first run), runs."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                hashes, offsets = hashed_words(part.column(2).to_pylist())
                owners, rows = [], [[] for _ in range(5)]
                for i in range(part.num_rows):
                    own = hashes[offsets[i] : offsets[i + 1]]
                    if len(own) < window:
                        continue
                    anchor, place, start, runs = anchors(own, window, seed)
                    owners.append(np.full(len(anchor), i))
                    # what lies before the anchor belongs to the class too, so its place in the extension is mixed in
                    ends = [sequences(own, start, runs + window - 1, b) + (place - start).astype(np.uint64) for b in BASES]
                    for row, values in zip(rows, (signed(anchor), signed(ends[0]), signed(ends[1]), start.astype(np.int32), runs.astype(np.int32))):
                        row.append(values)
                if owners:
                    taken = pa.array(np.concatenate(owners))
                    arrays = [part.column(0).take(taken), part.column(1).take(taken), *(pa.array(np.concatenate(r)) for r in rows)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "anchor", "e1", "e2", "start", "runs"])

    return keyed.select("k1", "k2", "text").mapInArrow(batches, "k1 long, k2 long, anchor long, e1 long, e2 long, start int, runs int")


def _runs(joined: DataFrame, window: int) -> DataFrame:
    """Runs of the occurrences in ``spans``: r1, r2, k1, k2, start."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            wanted = batch.filter(batch.column("spans").is_valid())
            for at in range(0, wanted.num_rows, ROWS):
                part = wanted.slice(at, ROWS)
                hashes, offsets = hashed_words(part.column("text").to_pylist())
                owners, rows = [], [[] for _ in range(3)]
                for i, spans in enumerate(part.column("spans").to_pylist()):
                    own = hashes[offsets[i] : offsets[i + 1]]
                    starts = np.unique(np.concatenate([np.arange(s["start"], s["start"] + s["runs"]) for s in spans]))
                    owners.append(np.full(len(starts), i))
                    for row, values in zip(rows, (*(signed(sequences(own, starts, window, b)) for b in BASES), starts.astype(np.int32))):
                        row.append(values)
                taken = pa.array(np.concatenate(owners))
                r1, r2, start = (pa.array(np.concatenate(r)) for r in rows)
                yield pa.RecordBatch.from_arrays([r1, r2, part.column("k1").take(taken), part.column("k2").take(taken), start], names=["r1", "r2", "k1", "k2", "start"])

    return joined.mapInArrow(batches, "r1 long, r2 long, k1 long, k2 long, start int")


def _kept(joined: DataFrame, kind: str) -> DataFrame:
    """doc_id, kept (words left, joined by blanks), n_words, n_removed."""

    def remove(text: str | None, spans: list[dict] | None) -> tuple[str, int, int]:
        found = (text or "").encode("utf-8", "replace").split()
        if not spans:
            return b" ".join(found).decode(), len(found), 0
        kept, at = [], 0
        for start, end in sorted((s["start"], s["end"]) for s in spans):
            if start > at:
                kept += found[at:start]
            at = max(at, end)
        kept += found[at:]
        return b" ".join(kept).decode(), len(found), len(found) - len(kept)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [remove(t, s) for t, s in zip(part.column("text").to_pylist(), part.column("spans").to_pylist())]
                arrays = [part.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "kept", "n_words", "n_removed"])

    return joined.mapInArrow(batches, f"doc_id {kind}, kept string, n_words long, n_removed long")


def _with_partner(rows: DataFrame, same: list[str], other: list[str]) -> DataFrame:
    """Rows that another row equals in ``same`` while one of ``other`` differs."""
    differs = F.lit(False)
    for c in other:
        differs = differs | (F.col(f"a.{c}") != F.col(f"b.{c}"))
    equal = differs
    for c in same:
        equal = (F.col(f"a.{c}") == F.col(f"b.{c}")) & equal
    return rows.alias("a").join(rows.alias("b"), equal, "left_semi")


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, kept, n_words, n_removed of every row."""
    keyed = _keyed(docs, doc, text)
    with temporary(docs.sparkSession) as keep:
        # both sides of the join read one written table: seeds are found once, and their numbers stay as they are
        found = cut(_seeds(keyed, window, seed).withColumn("uid", F.monotonically_increasing_id()))
        repeated = keep(cut(_with_partner(found, ["anchor"], ["uid"]).drop("uid")))
    classes = cut(
        repeated.groupBy("anchor", "e1", "e2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start", "runs")).alias("one"))
    )
    # one occurrence of each class of an anchor that has several
    ones = cut(_with_partner(classes, ["anchor"], ["e1", "e2"]).select("one.*"))
    whole = repeated.join(classes.where("n > 1").select("anchor", "e1", "e2"), ["anchor", "e1", "e2"], "left_semi")

    def with_spans(rows: DataFrame, *fields: str) -> DataFrame:
        # both uses exchange the same columns of the texts by the same keys, so Spark moves the texts once
        return keyed.join(rows.groupBy("k1", "k2").agg(F.collect_set(F.struct(*fields)).alias("spans")), ["k1", "k2"], "left")

    runs = _with_partner(_runs(with_spans(ones, "start", "runs"), window), ["r1", "r2"], ["k1", "k2", "start"])
    covered = whole.select("k1", "k2", "start", (F.col("start") + F.col("runs") + (window - 1)).alias("end")).unionByName(
        runs.select("k1", "k2", "start", (F.col("start") + window).alias("end"))
    )
    return _kept(with_spans(covered, "start", "end"), keyed.schema["doc_id"].dataType.simpleString())
