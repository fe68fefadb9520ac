"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed character n-grams; a linear
softmax on top gives the language.  Both are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled texts: of each of
the ``MAX_LANGUAGES`` most frequent languages at most ``SAMPLE_PER_LANGUAGE``
texts, one an identifier, and the first ``SAMPLE_CHARS`` characters of each, or
fewer, so that all are ``SAMPLE_TOTAL_CHARS`` at most.  On a part of the sample
that training never sees, a temperature makes the probabilities honest, and the
confidence below which a text is rejected is set such that about ``REJECTED`` of
the rightly predicted texts there would go.

The model is linear after the mean, so the tasks get embeddings and softmax
multiplied out: one row of scores per bucket (buckets x languages floats).

Defined results: rows without identifier, language or letter teach nothing, and
repeated rows once; a null text, or one without a letter, is ``und`` with score 0
and is rejected, and so is every text when nothing could be learned; copies
and repeated rows get equal results; ties go to the first language by name;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from grainscore.llm import grams
from grainscore.llm.shared import cut, temporary

UNKNOWN = "und"
SIZES = (3, 4)
BITS = 16
DIMENSIONS = 16
EPOCHS = 6
RATE = 0.4
REJECTED = 0.001
# Bounds of the sample that training reads.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_CHARS = 20_000
SAMPLE_TOTAL_CHARS = 1 << 26
MAX_LANGUAGES = 500
ROWS = 256

LETTER = regex.compile(r"\p{L}")


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray
    temperature: float
    threshold: float


def sample(rows: DataFrame, label: str, key: str, per_label: int, max_labels: int) -> DataFrame:
    """At most ``per_label`` rows of each of the ``max_labels`` most frequent labels, chosen by the hash of ``key``.

    Labels are counted first, so that only a share of the rows of a common
    label, some times ``per_label``, is sorted at all.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(max_labels).collect()
    if not counts:
        return rows.limit(0)
    dealt = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[label], int(min(1.0, (2 * per_label + 200) / r["count"]) * (1 << 30)))])
    drawn = rows.where(dealt < share[F.col(label)])
    order = Window.partitionBy(label).orderBy(dealt, key)
    return drawn.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_label).drop("_place")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a text; weights sum to 1."""
    found = [grams.hashed(letters, n, BITS)[1] for letters, _, _ in grams.pieces([text], max(SIZES) - 1) for n in SIZES]
    buckets, counts = np.unique(np.concatenate(found), return_counts=True)
    return buckets, (counts / max(1, counts.sum())).astype(np.float32)


def _slices(text: str, draw: np.random.Generator) -> list[str]:
    """The text, and a few of its words twice, so that short texts are learned too."""
    words = text.split()
    out = [text]
    for n in (3, 12):
        if len(words) > n:
            at = int(draw.integers(0, len(words) - n))
            out.append(" ".join(words[at : at + n]))
    return out


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    languages = sorted(set(labels))
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(texts))
    n_held = len(texts) // 5
    held, used = order[:n_held], order[n_held:]
    number = {name: i for i, name in enumerate(languages)}
    examples = [(*features(s), number[labels[i]]) for i in used for s in _slices(texts[i], draw)]
    examples = [e for e in examples if len(e[0])]
    inner = draw.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
    outer = np.zeros((len(languages), DIMENSIONS), np.float32)
    share = np.bincount([e[2] for e in examples], minlength=len(languages)) / max(1, len(examples))
    weight = np.clip(1 / np.maximum(share * len(languages), 1e-3), 0.2, 5)
    steps = EPOCHS * max(1, len(examples))
    done = 0
    for _ in range(EPOCHS):
        for i in draw.permutation(len(examples)):
            buckets, amounts, label = examples[i]
            rows = inner[buckets]
            mean = amounts @ rows
            error = _softmax(outer @ mean)
            error[label] -= 1
            error *= RATE * weight[label] * (1 - done / steps)
            # the mean is over many grams, so each embedding moves by a scaled share
            inner[buckets] = rows - np.outer(amounts * min(len(buckets), 100), error @ outer)
            outer -= np.outer(error, mean) * 5
            done += 1
    scores = np.ascontiguousarray(inner @ outer.T)
    return Model(languages, scores, *_calibrated(scores, [features(texts[i]) for i in held], [number[labels[i]] for i in held]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _calibrated(scores: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> tuple[float, float]:
    """Temperature of least log loss on the held texts, and the confidence that ``REJECTED`` of the right ones stay below."""
    if not held:
        return 1.0, 0.0
    logits = np.array([w @ scores[b] if len(b) else np.zeros(scores.shape[1]) for b, w in held])
    labels = np.array(labels)

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean())

    temperature = min((0.25 * 1.25**k for k in range(16)), key=loss)
    p = _softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == labels]
    chance = 1 / scores.shape[1]
    limit = float(np.quantile(right, REJECTED)) if len(right) else chance
    return temperature, min(0.5, chance + 0.5 * (limit - chance))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Model learned from a bounded sample of the rows with an identifier, a letter in the text, and a language.

    Identifiers are drawn first; their number is bounded, so they are broadcast to the texts.
    """
    read = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    read = read.where(F.col("key").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    with temporary(rows.sparkSession):
        ids = cut(read.groupBy("key", "lang").agg(F.count("*").alias("n")).drop("n"))
        drawn = cut(sample(ids, "lang", "key", SAMPLE_PER_LANGUAGE, MAX_LANGUAGES))
        chars = min(SAMPLE_CHARS, SAMPLE_TOTAL_CHARS // max(1, drawn.count()))
        texts = read.join(F.broadcast(drawn), ["key", "lang"]).select("key", "lang", F.substring("text", 1, chars).alias("text"))
        found = texts.groupBy("key", "lang").agg(F.min("text").alias("text")).collect()
    found = sorted((r["lang"], r["text"]) for r in found if LETTER.search(r["text"]))
    return train([t for _, t in found], [name for name, _ in found])


def probabilities(texts: list[str | None], model: Model) -> np.ndarray:
    """Calibrated probability of every language for every text."""
    sums, counts = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    size = max(1 << 14, (grams.PIECE_BYTES << 2) // max(4, len(model.languages)))
    for letters, starts, numbers in grams.pieces(texts, max(SIZES) - 1, size):
        for n in SIZES:
            places, buckets = grams.hashed(letters, n, BITS)
            edges = np.searchsorted(places, starts)
            amounts = np.diff(np.append(edges, len(places)))
            some = amounts > 0
            if some.any():
                np.add.at(sums, numbers[some], np.add.reduceat(model.scores[buckets], edges[some], axis=0))
                np.add.at(counts, numbers, amounts)
    return _softmax(sums / np.maximum(counts, 1)[:, None] / model.temperature)


def judged(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and acceptance of every text."""
    known = np.array([bool(model.languages and t and LETTER.search(t)) for t in texts], bool)
    if not known.any():
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), known
    p = probabilities(texts, model)
    names = [model.languages[i] if k else UNKNOWN for i, k in zip(p.argmax(axis=1), known)]
    score = np.where(known, p.max(axis=1), 0.0)
    return names, score, known & (score >= model.threshold)


def predict(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names, score, accepted = judged(part.column(1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], names=columns)

    columns = ["doc_id", "lang_pred", "score", "accepted"]
    read = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([read.schema["doc_id"], *map(T.StructField, columns[1:], [T.StringType(), T.DoubleType(), T.BooleanType()])])
    return read.mapInArrow(batches, schema)


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text the model does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array(judged(part.column(place).to_pylist(), shared.value)[2]))

    return docs.mapInArrow(batches, docs.schema)
