"""Vector code compression: product codes in whole numbers, nearest entries by GNAT.

Vectors become fixed-point integers, are cut into equal parts, and every part
is replaced by the number of its nearest entry in that position's codebook.
Codebooks are refined in a fixed number of rounds, each a pass of tasks over
the vectors that yields sums and counts per entry; only these, a bounded
table, reach the driver.

The nearest entry is found in a geometric near-neighbor access tree over the
entries: a node has a few split points, every other entry belongs to its
nearest one, and for each pair of split point and child the node keeps the
range of distances from the one to the entries of the other.  A query that is
measured against a split point drops all children whose range lies farther
from its distance than the best entry so far.  Square roots are rounded away
from dropping, and a child is dropped only if all its entries are strictly
farther, so entries at equal distance are met and the whole-number comparison
gives the lower index.

Defined results: vectors that are null, empty, or hold a null, non-finite or
out of range component (magnitude ``LIMIT`` and more) are dropped, as are
those whose length is not that of the smallest identifier kept or no multiple
of the number of parts; first entries are the vectors of the smallest
identifiers, nulls last, equal identifiers by their vectors, repeated rows each;
fewer rows than entries give fewer entries; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainscore.llm.shared import cut

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
# so that squared distances of any length fit in 64 bits
LIMIT = 4096
DEGREE = 4
ROWS = 4096


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(np.sqrt(x.astype(np.float64)), -np.inf), -np.inf)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(np.sqrt(x.astype(np.float64)), np.inf), np.inf)


class Node(NamedTuple):
    """Split points, the range of distances from each to each child's entries, and the children's own nodes."""

    splits: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    children: list


class Gnat:
    """Nearest of a few integer vectors, ties to the lower index."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE):
        self.entries, self.degree = entries.astype(np.int64), degree
        self.root = self._node(np.arange(len(entries))) if len(entries) else None
        self.measured = 0

    def _squares(self, rows: np.ndarray, point: int) -> np.ndarray:
        return ((rows - self.entries[point]) ** 2).sum(axis=1)

    def _node(self, own: np.ndarray) -> Node:
        # split points far from each other: each the farthest from those chosen
        splits, gap = [int(own[0])], self._squares(self.entries[own], own[0])
        while len(splits) < min(self.degree, len(own)) and gap.max() > 0:
            splits.append(int(own[gap.argmax()]))
            gap = np.minimum(gap, self._squares(self.entries[own], splits[-1]))
        table = np.array([self._squares(self.entries[own], s) for s in splits])
        home = table.argmin(axis=0)
        home[np.searchsorted(own, splits)] = np.arange(len(splits))
        k = len(splits)
        nearest, farthest = np.zeros((k, k)), np.zeros((k, k))
        for i in range(k):
            for j in range(k):
                range_ = table[i][home == j]
                nearest[i, j], farthest[i, j] = _down(range_.min()), _up(range_.max())
        rest = [own[(home == j) & (own != splits[j])] for j in range(k)]
        return Node(np.array(splits), nearest, farthest, [self._node(r) if len(r) else None for r in rest])

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every query."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        place = np.full(len(queries), len(self.entries))
        self._visit(self.root, queries.astype(np.int64), np.arange(len(queries)), best, place)
        return place, best

    def _visit(self, node: Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, place: np.ndarray) -> None:
        alive = np.ones((len(rows), len(node.splits)), bool)
        for i, point in enumerate(node.splits):
            here = np.flatnonzero(alive[:, i])
            own = rows[here]
            if not len(own):
                continue
            self.measured += len(own)
            found = self._squares(queries[own], point)
            better = (found < best[own]) | (found == best[own]) & (point < place[own])
            best[own[better]], place[own[better]] = found[better], point
            reach = _up(best[own])[:, None]
            # strict on both sides, and the sums rounded away from dropping as well
            far = np.nextafter(_down(found)[:, None] - reach, -np.inf) > node.farthest[i]
            far |= np.nextafter(_up(found)[:, None] + reach, np.inf) < node.nearest[i]
            alive[here] &= ~far
        for j, child in enumerate(node.children):
            if child is not None and alive[:, j].any():
                self._visit(child, queries, rows[alive[:, j]], best, place)


def _vectors(rows: DataFrame, vec: str, embedding: str, label: str, parts: int, scale: int) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that can be coded."""
    read = rows.select(F.col(vec).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    kept = read.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & F.coalesce(fits, F.lit(False)))
    return kept.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("int")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _sums(vectors: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and sums of the vectors' parts by (position, entry)."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    n_parts, n_entries, width = books.shape

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in shared.value]
        counts, sums = np.zeros((n_parts, n_entries), np.int64), np.zeros((n_parts, n_entries, width), np.int64)
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(0).slice(at, ROWS)).reshape(-1, n_parts, width)
                for p, tree in enumerate(trees):
                    near, _ = tree.search(x[:, p])
                    counts[p] += np.bincount(near, minlength=n_entries)
                    for k in range(width):
                        np.add.at(sums[p, :, k], near, x[:, p, k])
        part, entry = np.nonzero(counts)
        arrays = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry])]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    found = vectors.select("v").mapInArrow(batches, "part int, entry int, n long, sums array<long>")
    added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(width))).alias("sums"))
    return {(r["part"], r["entry"]): (r["n"], r["sums"]) for r in added.collect()}


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after ``rounds`` rounds over all of ``vectors`` (vec_id, v of one length)."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["v"] for r in first], np.int64)
    books = books.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for (part, entry), (n, sums) in _sums(vectors, books).items():
            books[part, entry] = [s // n for s in sums]
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (entry of each part), error of every row."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        trees = [Gnat(b) for b in books]
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(2)).reshape(-1, *books.shape[::2])
                found = [tree.search(x[:, p]) for p, tree in enumerate(trees)]
                codes, error = np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(list(codes), pa.list_(pa.int64())), pa.array(error)], names=["vec_id", "label", "codes", "error"]
                )

    fields = [vectors.schema["vec_id"], vectors.schema["label"], T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("error", T.LongType())]
    return vectors.select("vec_id", "label", "v").mapInArrow(batches, T.StructType(fields))


def decode(codes: list[int], books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for: the middle of each component's cell."""
    return (np.concatenate([books[p, c] for p, c in enumerate(codes)]) + 0.5) / scale


def compress(
    rows: DataFrame,
    vec: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error, label_error of every row that can be coded; the codebooks)."""
    vectors = cut(_vectors(rows, vec, embedding, label, parts, scale))
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("d")).limit(1).collect()
    if first:
        vectors = vectors.where(F.size("v") == first[0]["d"])
    books = fit(vectors, parts, entries, rounds)
    coded = cut(encode(vectors, books)) if first else vectors.select("vec_id", "label", F.array().cast("array<long>").alias("codes"), F.lit(0).cast("long").alias("error"))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(cut(totals), F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def digest(books: np.ndarray) -> str:
    """Hash of all components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
