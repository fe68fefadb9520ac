"""Quality by histogram gradient-boosted trees over document statistics.

A text becomes a row of statistics (``STATISTICS``) that are counted over all
of it.  Values are binned by quantiles of the training sample; trees of a fixed
depth grow level by level, each split chosen from histograms of the slopes and
curvatures of the log loss by node, statistic and bin.  All trees are stored as
arrays of complete binary trees, and a batch of texts goes down all trees at
once, one level per step.

Training reads the statistics of a bounded sample of the labelled texts, at
most ``SAMPLE_PER_CLASS`` a class, each text once and whole; they are computed
in the tasks, so no text reaches the driver.  Classes weigh as they do among
all labels, so a score is the probability of the label.

Defined results: a null text is scored as the empty one; when a class has no
labelled text, all get the share of good labels (one half without labels); rows
without label or id teach nothing; repeated labels and repeated rows of an id
teach once; copies get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainscore.llm.language import sample
from grainscore.llm.words import hashed_words

STATISTICS = (
    "words",
    "bytes_a_word",
    "upper",
    "digits",
    "stops",
    "shouts",
    "signs",
    "foreign",
    "words_a_line",
    "distinct",
    "repeats_previous",
    "top_word",
    "blanks",
)
BINS = 64
DEPTH = 4
TREES = 60
RATE = 0.2
RIDGE = 1.0
LEAST_WEIGHT = 1e-3
LIMIT = 0.3
# Bound of the sample that training reads.
SAMPLE_PER_CLASS = 4_000
ROWS = 256
SLICE = 1 << 20

_CLASSES = {
    "upper": range(65, 91),
    "digits": range(48, 58),
    "stops": b".,;:",
    "shouts": b"!?",
    "signs": b"\"#$%&'()*+-/<=>@[\\]^_`{|}~",
    "foreign": range(128, 192),  # the later bytes of a letter outside of ASCII
    "blanks": b" \t\n\x0b\x0c\r",
}


class Model(NamedTuple):
    """Trees as arrays (tree, node): statistic and limit of each inner node, value of each leaf; the sum starts at ``bias``."""

    statistic: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    bias: float


def statistics(texts: Sequence[str | None]) -> np.ndarray:
    """A row of ``STATISTICS`` per text."""
    n = len(texts)
    counts = np.zeros((n, 256))
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        for at in range(0, len(data), SLICE):
            counts[i] += np.bincount(data[at : at + SLICE], minlength=256)
    size = counts.sum(axis=1)
    shares = {name: counts[:, list(codes)].sum(axis=1) / np.maximum(size, 1) for name, codes in _CLASSES.items()}
    hashes, offsets = hashed_words(texts)
    words = np.diff(offsets)
    distinct, repeats, top = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, (start, end) in enumerate(zip(offsets[:-1], offsets[1:])):
        if end > start:
            own = hashes[start:end]
            met = np.unique(own, return_counts=True)[1]
            distinct[i], top[i], repeats[i] = len(met), met.max(), (own[1:] == own[:-1]).sum()
    some = np.maximum(words, 1)
    values = shares | {
        "words": np.log1p(words),
        "bytes_a_word": (size - counts[:, list(_CLASSES["blanks"])].sum(axis=1)) / some,
        "words_a_line": words / (counts[:, 10] + 1),
        "distinct": distinct / some,
        "repeats_previous": repeats / some,
        "top_word": top / some,
    }
    return np.stack([values[name] for name in STATISTICS], axis=1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(rows: np.ndarray, labels: np.ndarray, share: float) -> Model:
    """``share``: that of label 1 among all labels."""
    labels = np.asarray(labels, np.float64)
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    inner, n = (1 << DEPTH) - 1, len(labels)
    if not n or labels.min() == labels.max():
        return Model(np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, inner + 1)), bias)
    weight = np.where(labels == 1, share / labels.sum(), (1 - share) / (1 - labels).sum()) * n
    cuts = [np.unique(np.quantile(column, np.arange(1, BINS) / BINS)) for column in rows.T]
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, rows.T)], axis=1)
    n_stats = rows.shape[1]
    upper = np.full((n_stats, BINS), np.inf)
    for k, c in enumerate(cuts):
        upper[k, : len(c)] = c
    statistic, limit = np.zeros((TREES, inner), np.int32), np.full((TREES, inner), np.inf)
    value, sums = np.zeros((TREES, inner + 1)), np.full(n, bias)
    for tree in range(TREES):
        p = _sigmoid(sums)
        slope, curve = (p - labels) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width, first = 1 << level, (1 << level) - 1
            place = (((node - first)[:, None] * n_stats + np.arange(n_stats)) * BINS + binned).ravel()
            shape = (width, n_stats, BINS)
            g = np.bincount(place, np.repeat(slope, n_stats), width * n_stats * BINS).reshape(shape)
            h = np.bincount(place, np.repeat(curve, n_stats), width * n_stats * BINS).reshape(shape)
            left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT) | np.isinf(upper)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            better = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            # a node without a useful split sends all texts to its left child
            stat, at = np.where(better, best // BINS, 0), best % BINS
            statistic[tree, first : first + width] = stat
            limit[tree, first : first + width] = np.where(better, upper[stat, at], np.inf)
            here = node - first
            node = 2 * node + 1 + (rows[np.arange(n), stat[here]] > limit[tree, node])
        leaf = node - inner
        value[tree] = -RATE * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, curve, inner + 1) + RIDGE)
        sums += value[tree, leaf]
    return Model(statistic, limit, value, bias)


def probabilities(rows: np.ndarray, model: Model) -> np.ndarray:
    """Probability of label 1 of every row of statistics."""
    trees = np.arange(len(model.value))[None, :]
    node = np.zeros((len(rows), len(model.value)), np.int64)
    each = np.arange(len(rows))[:, None]
    for _ in range(DEPTH):
        node = 2 * node + 1 + (rows[each, model.statistic[trees, node]] > model.limit[trees, node])
    return _sigmoid(model.bias + model.value[trees, node - model.statistic.shape[1]].sum(axis=1))


def _measured(docs: DataFrame) -> DataFrame:
    """key and statistics of every row of (key, text)."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = statistics(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(found), pa.list_(pa.float64()))], names=["key", "found"])

    return docs.mapInArrow(batches, T.StructType([docs.schema["key"], T.StructField("found", T.ArrayType(T.DoubleType()))]))


def fit(labelled: DataFrame, docs: DataFrame, doc: str = "doc_id", label: str = "quality", text: str = "text") -> Model:
    """Model from ``labelled`` (id, label 0/1) and the texts of ``docs``; ids are drawn first, and the drawn ones broadcast."""
    marks = labelled.select(F.col(doc).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("key").isNotNull() & F.col("label").isin(0, 1))
    marks = marks.groupBy("key").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    drawn = F.broadcast(sample(marks, "label", "key", SAMPLE_PER_CLASS, 2))
    texts = docs.select(F.col(doc).alias("key"), F.col(text).cast("string").alias("text")).join(drawn.select("key"), "key", "left_semi")
    once = _measured(texts).groupBy("key").agg(F.min("found").alias("found"))
    found = sorted((r["key"], r["label"], r["found"]) for r in once.join(drawn, "key").collect())
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    return train(np.array([f for _, _, f in found]).reshape(len(found), len(STATISTICS)), np.array([y for _, y, _ in found]), share)


def score(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                scores = probabilities(statistics(part.column(1).to_pylist()), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= LIMIT).astype(np.int32))], names=columns)

    columns = ["doc_id", "score", "predicted"]
    read = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([read.schema["doc_id"], *map(T.StructField, columns[1:], [T.DoubleType(), T.IntegerType()])])
    return read.mapInArrow(batches, schema)
