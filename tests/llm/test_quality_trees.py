"""Quality trees: one text and one tree at a time, held-out labels, and defined results."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from grainscore.llm import quality_trees

CLASH = ["key", "label", "found", "score", "predicted", "_place", "count"]


def by_hand(text):
    """Statistics of one text, counted plainly."""
    data = (text or "").encode()
    size, words = max(1, len(data)), data.split()
    shares = {name: sum(b in set(codes) for b in data) / size for name, codes in quality_trees._CLASSES.items()}
    n = max(1, len(words))
    values = shares | {
        "words": math.log1p(len(words)),
        "bytes_a_word": sum(map(len, words)) / n,
        "words_a_line": len(words) / (data.count(b"\n") + 1),
        "distinct": len(set(words)) / n,
        "repeats_previous": sum(a == b for a, b in zip(words, words[1:])) / n,
        "top_word": max(map(words.count, set(words)), default=0) / n,
    }
    return [values[name] for name in quality_trees.STATISTICS]


def down_the_trees(row, model):
    total = model.bias
    for statistic, limit, value in zip(model.statistic, model.limit, model.value):
        node = 0
        while node < len(limit):
            node = 2 * node + (2 if row[statistic[node]] > limit[node] else 1)
        total += value[node - len(limit)]
    return 1 / (1 + math.exp(-total))


@pytest.fixture(scope="module")
def learned():
    draw = random.Random(1)
    texts = [" ".join(draw.choices(["alpha", "beta", "gamma", "delta."], k=draw.randint(5, 60))) + ("\n" if i % 3 else "###") for i in range(200)]
    texts += ["spam! " * draw.randint(3, 40) for _ in range(50)] + ["é ß\n" * 4, "", "X" * 3_000_000]
    labels = np.array([1] * 200 + [0] * 50 + [1, 0, 0])
    return texts, labels, quality_trees.train(quality_trees.statistics(texts), labels, 0.8)


def test_statistics_and_scores_text_by_text(learned):
    texts, _, model = learned
    found = quality_trees.statistics(texts)
    for text, row in zip(texts, found):
        assert np.allclose(row, by_hand(text))
    assert np.allclose(quality_trees.probabilities(found, model), [down_the_trees(row, model) for row in found])


def test_training_texts_are_told_apart(learned):
    texts, labels, model = learned
    assert ((quality_trees.probabilities(quality_trees.statistics(texts), model) >= 0.5) == (labels == 1)).mean() > 0.98


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    rows = entry.queries()["op13_quality_trees"](spark, folder).collect()
    assert len(rows) == 10_000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p for p, y in held if y]) > 0.99 and np.mean([not p for p, y in held if not y]) > 0.95


def test_defined_results(spark):
    texts = [(i, "word " * 9 + str(i)) if i % 2 else (i, "!!! " * 9) for i in range(80)]
    texts += [(1, texts[1][1])] * 50 + [(100, None), (101, ""), (None, "no id"), (102, "long " * 400_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(0) for c in CLASH})
    marks = spark.createDataFrame([(i, i % 2) for i in range(80)] * 2 + [(1, None), (None, 1), (999, 1)], "doc_id long, quality int").withColumns({c: F.lit(0) for c in CLASH})
    model = quality_trees.fit(marks, docs)
    got = quality_trees.score(docs, model).collect()
    assert len(got) == len(texts)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 80)
    assert len({r["score"] for r in got if r["doc_id"] in (100, 101)}) == 1
    assert quality_trees.score(docs.limit(0), model).collect() == []
    assert {r["score"] for r in quality_trees.score(docs, quality_trees.fit(marks.limit(0), docs)).collect()} == {0.5}
    one_class = quality_trees.fit(marks.where("quality = 0"), docs)
    assert {r["predicted"] for r in quality_trees.score(docs, one_class).collect()} == {0}


def test_the_sample_is_bounded_and_reads_each_document_once(spark, monkeypatch):
    monkeypatch.setattr(quality_trees, "SAMPLE_PER_CLASS", 10)
    sizes = []
    monkeypatch.setattr(quality_trees, "train", lambda rows, labels, share: sizes.append((len(rows), share)))
    docs = spark.createDataFrame([(i, f"t {i}") for i in range(300)] + [(5, "t 5")] * 500, "doc_id long, text string")
    quality_trees.fit(docs.select("doc_id", F.when(F.col("doc_id") < 60, 0).otherwise(1).alias("quality")), docs)
    assert sizes == [(20, 0.8)]
