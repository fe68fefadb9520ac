"""Product codes: the tree against every entry, rounds against plain loops, and defined results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainscore.llm import vector_codes


def by_brute_force(rows, parts=8, entries=16, rounds=6):
    """(code, error) by place of rows sorted by identifier, and the codebooks."""
    width = len(rows[0]) // parts
    whole = [[math.floor(4096 * x) for x in v] for v in rows]
    cut = [[v[p * width : (p + 1) * width] for v in whole] for p in range(parts)]
    books = [[list(x) for x in cut[p][:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut[p]:
                groups.setdefault(nearest(x, books[p])[1], []).append(x)
            for i, found in groups.items():
                books[p][i] = [sum(c) // len(found) for c in zip(*found)]
    last = [[nearest(cut[p][r], books[p]) for p in range(parts)] for r in range(len(rows))]
    return [[i for _, i in row] for row in last], [sum(d for d, _ in row) for row in last], books


@pytest.mark.parametrize("spread", [1, 3, 40, 4096 * 4096])
@pytest.mark.parametrize("entries", [1, 2, 5, 16, 100])
def test_the_tree_finds_the_first_nearest_entry(spread, entries):
    draw = np.random.default_rng(entries * 7 + spread)
    points = draw.integers(-spread, spread + 1, (entries, 8))
    queries = np.concatenate([draw.integers(-spread, spread + 1, (500, 8)), points])
    tree = vector_codes.Gnat(points)
    place, gap = tree.search(queries)
    table = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
    assert (place == table.argmin(axis=1)).all() and (gap == table.min(axis=1)).all()


def test_the_tree_drops_subtrees():
    draw = np.random.default_rng(3)
    centers = draw.integers(-4096, 4096, (16, 8)) * 50
    tree = vector_codes.Gnat(np.concatenate([centers + draw.integers(-50, 50, centers.shape) for _ in range(4)]))
    tree.search(centers[draw.integers(0, 16, 1000)])
    assert tree.measured < 0.6 * 1000 * 64


def test_codes_of_clustered_vectors_with_ties_and_repeats(spark):
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(6, 16))
    rows = [(int(i), [float(np.float32(x)) for x in np.round(centers[i % 6] + 0.1 * draw.normal(size=16), 1)], int(i) % 3) for i in range(120)]
    rows += [(200, rows[0][1], None), (201, rows[0][1], None), (7, rows[7][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(0) for c in ["v", "of", "codes", "n", "part"]})
    coded, books = vector_codes.compress(frame)
    ordered = sorted(rows, key=lambda r: (r[0], r[1]))
    codes, errors, want = by_brute_force([v for _, v, _ in ordered])
    assert books.tolist() == want
    got = sorted((r["vec_id"], r["codes"], r["error"]) for r in coded.collect())
    assert got == sorted((r[0], c, e) for r, c, e in zip(ordered, codes, errors))
    by_label = {}
    for r, e in zip(ordered, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    assert {(r["label"], r["label_error"]) for r in coded.collect()} == set(by_label.items())


def test_vectors_that_cannot_be_coded(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5, -0.25] * 8
    data = [(1, None, 1), (2, [], 1), (3, [None] * 16, 1), (4, [nan] * 16, 1), (5, [*good[:15], inf], 1), (6, [1e9] * 16, 1), (9, [0.1] * 24, 1), (10, [0.1] * 12, 1)]
    data += [(8, good, 1), (7, [0.0] * 16, None), (None, good, 2)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    coded, books = vector_codes.compress(frame)
    assert books.shape == (8, 3, 2)
    got = {r["vec_id"]: (r["codes"], r["error"], r["label_error"]) for r in coded.collect()}
    # two equal entries: the lower index is taken, the other one stays as it was
    assert got == {7: ([0] * 8, 0, 0), 8: ([1] * 8, 0, 0), None: ([1] * 8, 0, 0)}
    assert np.allclose(vector_codes.decode([1] * 8, books), good, atol=1 / 4096)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.compress(frame)
    assert coded.collect() == [] and books.size == 0 and len(vector_codes.digest(books)) == 64
