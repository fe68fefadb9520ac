"""Sets fetched for the n-gram join."""

import random

from pyspark.sql import functions as F

from grainscore.llm import ngram_join


def test_repeated_rows_give_one_set(spark, monkeypatch):
    texts = [(1, "a b c d e f g h")] * 50 + [(2, "a b c d e f g x")] * 50 + [(3, "a b c d e f g h")]
    keyed = ngram_join._keyed(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), "doc_id", "text")
    profiles = ngram_join._profiles(keyed, 5, ngram_join.Measure(ngram_join.THRESHOLD)).where("cid IS NOT NULL")
    reps = profiles.groupBy("cid").agg(F.min("key").alias("key"))
    assert sorted(r["n"] for r in ngram_join._sets(keyed, reps, 5).collect()) == [4, 4]
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", 0)
    assert sorted(r["n"] for r in ngram_join._sets(keyed, reps, 5).collect()) == [4, 4]


def test_large_clusters_meet_under_prefix_tokens(spark, monkeypatch):
    """Chains of texts that lose words at one end and gain them at the other, against all pairs."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "WHOLE_BLOCKS", 1)
    draw = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    texts = [(i, " ".join(words[at : at + 60])) for i, at in enumerate(range(0, 240, 4))]
    texts += [(1000 + i, " ".join(words[at : at + 60])) for i, at in enumerate(range(400, 700, 7))]
    base = words[800:870]
    texts += [(2000 + i, " ".join(w if draw.random() > 0.02 else "x" for w in base)) for i in range(60)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts}
    label = {i: i for i in sets}
    while True:
        before = dict(label)
        for i in sets:
            for j in sets:
                if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                    label[i] = min(label[i], label[j])
        if label == before:
            break
    found = ngram_join.join(spark.createDataFrame(texts, "doc_id long, text string").repartition(5))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == label
    assert len(set(label.values())) > 3
