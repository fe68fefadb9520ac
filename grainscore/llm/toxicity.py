"""Toxicity by a character n-gram linear classifier with naive Bayes features.

A text is the set of its hashed character n-grams.  For each n-gram the log
ratio of its smoothed shares among toxic and clean training texts is taken;
the strongest n-grams, scaled by their ratios, are the features of a logistic
regression that is trained in numpy.  The model is one weight per bucket.

Training reads a bounded sample of the labelled texts (at most
``SAMPLE_PER_CLASS`` per class, one text an identifier, each of at most
``SAMPLE_CHARS`` characters);
scoring reads every text whole.  Clean texts weigh as much as they are more
frequent among all labels than in the sample, so that a score stays the
probability of the label.

Defined results: a null or empty text, or one without a known n-gram, gets the
score of no evidence; when one class has no labelled text, all get the share
of toxic labels; rows without label teach nothing, repeated labels
(toxic if any says so) and repeated rows of an identifier once; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainscore.llm import grams
from grainscore.llm.language import sample

SIZES = (4, 5, 6)
BITS = 20
FEATURES = 20_000
LEAST_TEXTS = 5
LEAST_STRENGTH = 5.0
SMOOTHING = 1.0
PENALTY = 1e-3
STEPS = 150
LIMIT = 0.3
# Bounds of the sample that training reads.
SAMPLE_PER_CLASS = 3_000
SAMPLE_CHARS = 20_000


class Model(NamedTuple):
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def present(text: str) -> np.ndarray:
    """Distinct buckets of a text."""
    found = [grams.hashed(letters, n, BITS)[1] for letters, _, _ in grams.pieces([text], max(SIZES) - 1) for n in SIZES]
    return np.unique(np.concatenate(found)).astype(np.int32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(texts: list[str], toxic: list[int], share: float) -> Model:
    """``share``: that of toxic among all labels."""
    label = np.array(toxic, np.float64)
    empty = np.zeros(0, np.int32)
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not len(label) or label.min() == label.max():
        return Model(empty, np.zeros(0), prior)
    sets = [present(t) for t in texts]
    hit, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for found, is_toxic in zip(sets, toxic):
        (hit if is_toxic else clean)[found] += 1
    n_hit, n_clean = label.sum(), (1 - label).sum()
    ratio = np.log((hit + SMOOTHING) / (n_hit + 2 * SMOOTHING)) - np.log((clean + SMOOTHING) / (n_clean + 2 * SMOOTHING))
    # the strongest by how surely the shares of the two classes differ; below a few standard errors it may be chance
    share_of_all = (hit + clean) / len(label)
    error = np.sqrt(np.maximum(share_of_all * (1 - share_of_all), 1e-12) * (1 / n_hit + 1 / n_clean))
    strength = np.where(hit + clean >= LEAST_TEXTS, np.abs(hit / n_hit - clean / n_clean) / error, 0)
    chosen = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    chosen = chosen[strength[chosen] >= LEAST_STRENGTH]
    if not len(chosen):
        return Model(empty, np.zeros(0), prior)
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    rows = [p[p >= 0] for p in (place[s] for s in sets)]
    del sets
    columns = np.concatenate(rows)
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = ratio[chosen]
    # the sample's classes count as they do among all labels
    weight = np.where(label == 1, share / n_hit, (1 - share) / n_clean)
    w, moment, bias, bias_moment, rate = np.zeros(len(chosen)), np.zeros(len(chosen)), prior, 0.0, 0.3
    square, bias_square = np.zeros(len(chosen)), 0.0
    for step in range(1, STEPS + 1):
        sums = np.bincount(row_of, (w * scale)[columns], minlength=len(rows)) + bias
        slope = (_sigmoid(sums) - label) * weight
        gradient = np.bincount(columns, slope[row_of], minlength=len(chosen)) * scale + PENALTY * w
        moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        bias_moment, bias_square = 0.9 * bias_moment + 0.1 * slope.sum(), 0.99 * bias_square + 0.01 * slope.sum() ** 2
        pace = rate / np.sqrt(step)
        w = w - pace * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        bias -= pace * (bias_moment / (1 - 0.9**step)) / (np.sqrt(bias_square / (1 - 0.99**step)) + 1e-8)
    return Model(chosen.astype(np.int32), w * scale, float(bias))


def fit(labelled: DataFrame, docs: DataFrame, doc: str = "doc_id", label: str = "toxic", text: str = "text") -> Model:
    """Model from ``labelled`` (id, label 0/1) and the texts of ``docs``.

    Ids are drawn first; their number is bounded, so they are broadcast to the texts.
    """
    marks = labelled.select(F.col(doc).alias("key"), F.col(label).cast("int").alias("toxic")).where(F.col("key").isNotNull() & F.col("toxic").isin(0, 1))
    marks = marks.groupBy("key").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    drawn = sample(marks, "toxic", "key", SAMPLE_PER_CLASS, 2)
    texts = docs.select(F.col(doc).alias("key"), F.col(text).cast("string").alias("text"))
    texts = texts.where(F.col("text").isNotNull() & (F.char_length("text") <= SAMPLE_CHARS))
    once = texts.join(F.broadcast(drawn), "key").groupBy("key").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    found = sorted((r["toxic"], r["text"]) for r in once.collect())
    total = max(1, sum(counts.values()))
    return train([t for _, t in found], [y for y, _ in found], counts.get(1, 0) / total)


def score(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = np.full(1 << BITS, -1, np.int32)
        place[model.buckets] = np.arange(len(model.buckets))
        width = max(1, len(model.buckets))
        for batch in stream:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                met = [np.zeros(0, np.int64)]
                for letters, starts, numbers in grams.pieces(texts, max(SIZES) - 1):
                    for n in SIZES:
                        places, buckets = grams.hashed(letters, n, BITS)
                        features = place[buckets]
                        known = np.flatnonzero(features >= 0)
                        owner = numbers[np.searchsorted(starts, places[known], "right") - 1]
                        met.append(np.unique(owner * width + features[known]))
                pairs = np.unique(np.concatenate(met))
                sums = np.bincount(pairs // width, model.weights[pairs % width] if len(model.buckets) else None, minlength=len(texts)) + model.bias
                scores = _sigmoid(sums)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= LIMIT).astype(np.int32))], names=columns)

    columns = ["doc_id", "score", "predicted"]
    read = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([read.schema["doc_id"], *map(T.StructField, columns[1:], [T.DoubleType(), T.IntegerType()])])
    return read.mapInArrow(batches, schema)
