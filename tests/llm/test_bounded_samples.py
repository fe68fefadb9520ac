"""What training brings to the driver is bounded, and what components need is finished at any size."""

import random

import pytest
from pyspark.sql import functions as F

from grainscore.llm import components, language, ngram_join, toxicity
from grainscore.llm.shared import cut, temporary


def test_a_repeated_document_teaches_toxicity_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, share: seen.append((texts, labels)))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    many = docs.unionByName(spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("text 7").alias("text")))
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    toxicity.fit(marks.unionByName(marks), many)
    assert len(seen[0][0]) == 60 and sum(seen[0][1]) == 30


def test_languages_of_long_texts_and_many_languages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, names: seen.append((texts, names)))
    monkeypatch.setattr(language, "SAMPLE_CHARS", 1000)
    rows = [(i, "wort " * 5000, "de") for i in range(5)] + [(10 + i, "word", "en") for i in range(5)] + [(10, "word", "en")] * 500 + [(None, "w", "en"), (99, "12", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language.fit(frame)
    assert sorted((n, len(t)) for t, n in zip(*seen[0])) == [("de", 1000)] * 5 + [("en", 4)] * 5
    monkeypatch.setattr(language, "SAMPLE_TOTAL_CHARS", 1000)
    language.fit(frame)
    assert max(map(len, seen[1][0])) == 100
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    language.fit(frame.where("lang = 'de' OR doc_id < 14"))
    assert set(seen[2][1]) == {"de"}


@pytest.mark.parametrize("bound", [0, 40, 1 << 20])
def test_components_whatever_one_task_may_hold(spark, monkeypatch, bound):
    monkeypatch.setattr(components, "ONE_TASK", bound)
    draw = random.Random(8)
    edges = [(draw.randint(0, 200), draw.randint(0, 200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(30)] + [(-5, 2000 + i) for i in range(20)]
    least = {v: v for e in edges for v in e}
    for _ in range(len(least)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["vertex"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(least[v] == got.get(v, v) for v in least)


def test_written_tables_go_unless_kept(spark):
    with temporary(spark) as keep:
        first = cut(spark.range(3))
        with temporary(spark) as keep_inner:
            second = keep_inner(cut(spark.range(4)))
            third = cut(spark.range(5))
        assert second.count() == 4
        keep(first)
    assert spark.read.parquet(first.written_to).count() == 3
    for gone in (second, third):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(gone.written_to)


def test_of_equal_rows_the_least_stays(spark):
    rows = [(1, "a b c d e f", x) for x in ("z", "b", "c")] + [(2, None, "q"), (2, None, "p")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted(r["source"] for r in kept) == ["b", "p"]
