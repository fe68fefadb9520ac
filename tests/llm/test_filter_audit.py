"""The filter audit against a count over every order, and its defined results."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from grainscore.llm import filter_audit

FILTERS = {"S": "size(words) < 3", "U": "text RLIKE '[A-Z]'", "C": filter_audit.COPY_OF_SMALLER}
CLASH = ["k1", "k2", "t1", "n", "part", "cell", "fails", "words", "least", "prefix", "filter", "total", "step"]
LONG = "word " * 40_000 + "X" * 100_000


def by_brute_force(docs, labels, names=tuple(FILTERS)):
    judged = []
    for doc, text, lang in docs:
        text = text or ""
        copy = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs)
        fails = {"S": len(text.split()) < 3, "U": any("A" <= c <= "Z" for c in text), "C": copy}
        marks = [(q, t) for d, q, t in labels if d == doc and d is not None]
        judged.append((lang or "", {f for f in fails if fails[f]}, any(q == 1 for q, _ in marks), any(t == 1 for _, t in marks)))
    out = {}
    for part in {j[0] for j in judged}:
        rows = [j[1:] for j in judged if j[0] == part]
        shapley = dict.fromkeys(names, 0)
        for order in permutations(names):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = [r for r in rows if f in r[0]]
                shapley[f] += len(gone)
                only = sum(r[0] == {f} for r in failing)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), only, sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(spark, docs, labels):
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in CLASH})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("clash") for c in CLASH})
    found = filter_audit.audit(frame, FILTERS, marks).collect()
    return {(r["part"], r["filter_order"], r["step"]): [*r[3:]] for r in found}


def test_nulls_copies_repeats_and_long_texts(spark):
    docs = [(1, "a b c", "en"), (2, "a b c", "en"), (2, "a b c", "en"), (2, "A", "en"), (3, None, None), (4, "", ""), (5, LONG, "de"), (6, LONG, "en")]
    docs += [(None, "a b c", "en"), (None, None, None), (7, "x y z", "fr")]
    labels = [(2, 1, 0), (2, None, 1), (2, 1, 0), (None, 1, 1), (4, 0, None), (99, 1, 1)]
    assert audited(spark, docs, labels) == by_brute_force(docs, labels)


def test_many_documents(spark):
    draw = random.Random(11)
    docs = [(i, draw.choice(["", "a", "b", "a b c", "A b c", "a b C d", f"own text {i}"]), draw.choice(["en", "de", None])) for i in range(300)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 300, 2)]
    assert audited(spark, docs, labels) == by_brute_force(docs, labels)


def test_empty_tables_and_too_many_filters(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), FILTERS, labels).collect() == []
    found = filter_audit.audit(docs, FILTERS, labels)
    assert found.count() == 18 and found.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)
    with pytest.raises(ValueError):
        filter_audit.audit(docs, {f"f{i}": "true" for i in range(7)}, labels)
