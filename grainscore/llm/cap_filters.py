"""Embedding near-dedup by spherical-cap filters from random product codes.

Directions are the products of one random code per block of dimensions.  A
vector is decoded to the list of all directions whose inner product with it
exceeds a limit: block by block, with every beginning dropped that the best
rest cannot lift above the limit, so far fewer directions are touched than
there are.  Vectors that share a filter are compared in double precision.  Code
size and limit follow the number of vectors so that a filter holds about
``MEMBERS`` of them at any size and a vector is in about ``FILTERS``; a vector
below ``LEAST_FILTERS`` takes its best directions up to that number.

Vectors with equal components form a class that is compared once.  Filters with
many members are dealt into blocks of ``BLOCK`` and each pair of blocks is a
group of its own.  A pair in several filters counts in the first it shares.
No pairs leave a group: only the number of links per vector, and edges of a
spanning forest for the components.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different length do not link; repeated
rows link with each other; a null identifier is never a component's name unless
there is no other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainscore.llm.components import components
from grainscore.llm.shared import cut, temporary

SIMILARITY = 0.95
MEMBERS = 128
FILTERS = 14
LEAST_FILTERS = 5
BLOCK = 256
ROWS = 256
# Beyond this many directions per code a third block of dimensions is cheaper.
MAX_CODE = 512


def sizes(n: int) -> tuple[int, int, float]:
    """(blocks of dimensions, directions per block, limit in standard deviations) for ``n`` vectors."""
    share = min(0.25, MEMBERS / max(1, n))
    filters = FILTERS / share
    blocks = 2
    while filters ** (1 / blocks) > MAX_CODE:
        blocks += 1
    return blocks, int(np.ceil(filters ** (1 / blocks))), NormalDist().inv_cdf(1 - share)


@lru_cache(maxsize=8)
def codes(dimensions: int, blocks: int, size: int, seed: int = 11) -> list[np.ndarray]:
    """One (directions x width) code per block; a product of them has length 1."""
    draw = np.random.default_rng(seed)
    widths = [len(w) for w in np.array_split(np.arange(dimensions), blocks)]
    drawn = [draw.normal(size=(size, w)) for w in widths]
    return [d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300) * np.sqrt(w / dimensions) for d, w in zip(drawn, widths)]


def decode(units: np.ndarray, blocks: int, size: int, limit: float) -> list[np.ndarray]:
    """Filters of every unit vector."""
    dimensions = units.shape[1]
    limit = limit / np.sqrt(dimensions)
    at, scores = 0, []
    for code in codes(dimensions, blocks, size):
        scores.append(units[:, at : at + code.shape[1]] @ code.T)
        at += code.shape[1]
    rest = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(units)
    todo, bound = np.arange(len(units)), np.full(len(units), limit)
    while len(todo):
        row, name, sums = todo, np.zeros(len(todo), np.int64), np.zeros(len(todo))
        for k, score in enumerate(scores):
            grown = sums[:, None] + score[row]
            best = rest[k + 1][row] if k + 1 < len(scores) else np.zeros(len(row))
            which, code = np.nonzero(grown + best[:, None] >= bound[row][:, None])
            row, name, sums = row[which], name[which] * size + code, grown[which, code]
        counts = np.bincount(row, minlength=len(units))
        order = np.argsort(row, kind="stable")
        for vector, found in zip(np.flatnonzero(counts), np.split(name[order], np.cumsum(counts[counts > 0])[:-1])):
            out[vector] = np.sort(found)
        # a vector that meets too few directions looks a little further
        todo = todo[counts[todo] < min(LEAST_FILTERS, size**blocks)]
        bound[todo] -= 0.25 / np.sqrt(dimensions)
    return out


def _valid(rows: DataFrame) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def _decoded(classes: DataFrame, n: int, dtype: str) -> DataFrame:
    """cid, weight, vector as bytes, filters of every class; vectors of other lengths get other filters."""
    blocks, size, limit = sizes(n)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column(2)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype), np.cumsum(lists.value_lengths().to_numpy())
                vectors = np.split(flat, ends[:-1])
                lengths = np.array([len(v) for v in vectors])
                filters: list = [None] * len(vectors)
                for d in np.unique(lengths):
                    own = np.flatnonzero(lengths == d)
                    x = np.array([vectors[i] for i in own], np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for i, found in zip(own, decode(x, min(blocks, int(d)), size, limit)):
                        filters[i] = found
                arrays = [part.column(0), part.column(1), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(lengths, pa.int32())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(filters, pa.list_(pa.int64()))], names=["cid", "weight", "vector", "length", "filters"])

    return classes.select("cid", "weight", "v").mapInArrow(batches, "cid long, weight long, vector binary, length int, filters array<long>")


def compare(
    x: np.ndarray, y: np.ndarray | None, fx: list[np.ndarray], fy: list[np.ndarray] | None, bucket: int, similarity: float
) -> np.ndarray:
    """Matrix of links between the rows of ``x`` and ``y`` (``None``: ``x``, each pair twice) that count in this bucket."""
    other, fo = (x, fx) if y is None else (y, fy)
    scaled = [v / np.abs(v).max(axis=1, keepdims=True) for v in ((x,) if y is None else (x, y))]
    norms = [np.sqrt((v * v).sum(axis=1)) for v in scaled]
    links = scaled[0] @ scaled[-1].T / np.outer(norms[0], norms[-1]) >= similarity
    if y is None:
        np.fill_diagonal(links, False)
    rows, columns = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    if len(rows):
        below = [[f[i][f[i] < bucket] for i in some] for f, some in ((fx, rows), (fo, columns))]
        names = np.unique(np.concatenate([np.zeros(0, np.int64), *below[0], *below[1]]))
        member = [np.zeros((len(b), len(names)), np.float32) for b in below]
        for m, b in zip(member, below):
            for i, own in enumerate(b):
                m[i, np.searchsorted(names, own)] = 1
        links[np.ix_(rows, columns)] &= member[0] @ member[1].T == 0
    return links


def forest(links: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that connect what the symmetric matrix ``links`` connects: a star per component."""
    label = np.arange(len(ids))
    while True:
        reached = np.where(links, label[None, :], len(ids)).min(axis=1, initial=len(ids))
        now = np.minimum(label, reached)
        now = np.minimum(now, now[now])
        if (now == label).all():
            break
        label = now
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _linked(keyed: DataFrame, dtype: str, similarity: float) -> DataFrame:
    """h1, h2, n_links, component_id of every distinct vector that can be linked, a written table."""
    classes = _valid(keyed).groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = cut(cut(classes).withColumn("cid", F.monotonically_increasing_id()))
    decoded = cut(_decoded(classes, classes.count(), dtype))
    members = decoded.select("cid", "length", F.explode("filters").alias("bucket"))
    counts = cut(members.groupBy("length", "bucket").agg(F.count("*").alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = members.join(counts, ["length", "bucket"]).select("cid", "length", "bucket", F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("own"), blocks.alias("blocks"))
    dealt = own.select("cid", "length", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cid", "length", "bucket", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def group(table: pa.Table) -> pa.Table:
        cids, weight, side = (table.column(c).to_numpy() for c in ("cid", "weight", "own"))
        i, j, bucket = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("bucket")[0].as_py()
        x = np.array([np.frombuffer(v, dtype) for v in table.column("vector").to_pylist()], np.float64)
        filters = [np.array(f, np.int64) for f in table.column("filters").to_pylist()]
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        whole = np.zeros((len(cids), len(cids)), bool)
        if len(left) and len(right):
            f = [[filters[k] for k in some] for some in (left, right)]
            found = compare(x[left], None if i == j else x[right], f[0], f[1], bucket, similarity)
            whole[np.ix_(left, right)] = found
            if i != j:
                whole[np.ix_(right, left)] = found.T
        links = whole @ weight
        some = np.flatnonzero(links)
        a, b = forest(whole, cids)
        nothing = [pa.nulls(len(some), pa.int64()), pa.nulls(len(a), pa.int64())]
        return pa.table(
            {
                "a": pa.chunked_array([pa.array(cids[some]), pa.array(a)]),
                "b": pa.chunked_array([nothing[0], pa.array(b)]),
                "links": pa.chunked_array([pa.array(links[some].astype(np.int64)), nothing[1]]),
            }
        )

    found = cut(
        dealt.join(decoded.select("cid", "weight", "vector", "filters"), "cid").groupBy("length", "bucket", "i", "j").applyInArrow(group, "a long, b long, links long")
    )
    links = found.where("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("links"))
    labels = components(found.where("b IS NOT NULL").select("a", "b"))
    named = (
        classes.select("h1", "h2", "cid", "least", "weight")
        .join(links.withColumnRenamed("a", "cid"), "cid", "left")
        .join(labels.withColumnRenamed("vertex", "cid"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    named = cut(named)
    smallest = cut(named.groupBy("component").agg(F.min("least").alias("component_id")))
    return cut(named.join(smallest, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))


def near(rows: DataFrame, vec: str = "vec_id", embedding: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links, component_id of every row."""
    read = rows.select(F.col(vec).alias("vec_id"), F.col(embedding).alias("v"))
    dtype = "float32" if "float" in read.schema["v"].dataType.simpleString() else "float64"
    keyed = read.select("vec_id", "v", F.xxhash64("v", F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))
    with temporary(rows.sparkSession) as keep:
        of_class = keep(_linked(keyed, dtype, similarity))
    return keyed.join(of_class, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
