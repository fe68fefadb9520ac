"""Registered queries against their SQL, or against brute force, on the small tables."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from test_line_runs import by_brute_force
from tools.compare import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.fixture(scope="module")
def documents(db):
    return db.sql("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("number", range(1, 14))
def test_sql(spark, db, number):
    name = next(n for n in entry.queries() if n.startswith(f"op{number}_"))
    if name not in entry.oracle_sql():
        pytest.skip("SQL can't express it")
    frame = entry.queries()[name](spark, FOLDER)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == canonical(names, cursor.fetchall())


def test_tokens_equal_the_library(spark, documents):
    from tokenizers import Tokenizer

    from grainscore.llm.bpe import vocabulary

    library = Tokenizer.from_file(vocabulary())
    rows = {r["doc_id"]: r for r in entry.queries()["op6_bpe"](spark, FOLDER).collect()}
    assert len(rows) == len(documents)
    for doc, text, _ in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[doc]["n_tokens"] == len(ids)
        assert rows[doc]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_alike(spark, documents):
    rows = {r["doc_id"]: r for r in entry.queries()["op2_ngram_join"](spark, FOLDER).collect()}
    sets, groups = {}, Groups([d for d, _, _ in documents])
    for doc, text, _ in documents:
        w = words((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                groups.link(a, b)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in rows.items()} == {d: (len(s), groups.find(d)) for d, s in sets.items()}


def test_near_vectors(spark, db):
    data = db.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    rows = {r["vec_id"]: r for r in entry.queries()["op3_cap_filters"](spark, FOLDER).collect()}
    x = np.array([v for _, v in data], float)
    near = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.95
    np.fill_diagonal(near, False)
    groups = Groups([i for i, _ in data])
    for a, b in zip(*np.nonzero(near)):
        groups.link(data[a][0], data[b][0])
    found = sum(r["n_links"] for r in rows.values())
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows.values())
    assert sum(rows[i]["component_id"] != groups.find(i) for i in rows) <= 0.1 * len(rows)


def test_repeats(spark, documents):
    rows = {r["doc_id"]: r for r in entry.queries()["op9_substring_dedup"](spark, FOLDER).collect()}
    seen = Counter(tuple(w[i : i + 35]) for _, t, _ in documents for w in [words(t)] for i in range(len(w) - 34))
    for doc, text, _ in documents:
        w = words(text)
        hit = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in hit)
        r = rows[doc]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest())


def test_lines(spark, documents):
    rows = {r["doc_id"]: r["kept_sha256"] for r in entry.queries()["op10_line_dedup"](spark, FOLDER).collect()}
    kept = by_brute_force([(d, t) for d, t, _ in documents])
    assert rows == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in kept.items()}


def test_languages(spark, documents):
    rows = {r["doc_id"]: r for r in entry.queries()["op8_language"](spark, FOLDER).collect()}
    lang = {d: name for d, _, name in documents}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert np.mean([r["lang_pred"] == lang[d] for d, r in rows.items() if r["held_out"]]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in set(lang.values()) for r in rows.values())


def test_toxicity(spark, db):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in entry.queries()["op5_toxicity"](spark, folder).collect()}
    labels = dict(db.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    held = [(r["predicted"], labels[d]) for d, r in rows.items() if r["held_out"] and d in labels]
    right = sum(p == y == 1 for p, y in held)
    assert right / sum(y for _, y in held) > 0.6 and right / sum(p for p, _ in held) > 0.7
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows.values())


def test_pipeline(spark, db):
    """The stages by brute force, each on what the stage before it kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from grainscore.llm.bpe import vocabulary

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert first.schema == docs.schema
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    assert len(kept) > 0.95 * docs.count()
    texts = by_brute_force(sorted(kept.items()))
    texts = {d: t for d, t in texts.items() if t == kept[d] or words(t)}
    sets = {}
    for doc, text in texts.items():
        w = words(text.translate(LOWER))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    groups = Groups(sets)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and Fraction(both, len(sets[a]) + len(sets[b]) - both) >= Fraction(8, 10):
                groups.link(a, b)
    texts = {d: t for d, t in texts.items() if groups.find(d) == d}
    separators = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    items = [separators.findall(t.translate(LOWER)) for (t,) in db.sql("SELECT text FROM benchmark").fetchall()]
    windows = {tuple(w[i : i + 13]) for w in items for i in range(max(1, len(w) - 12)) if w}
    lengths = {len(w) for w in windows}

    def clean(text):
        w = separators.findall(text.translate(LOWER))
        hit = {k for n in lengths for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        return not (hit and 20 * len(hit) >= len(w))

    library = Tokenizer.from_file(vocabulary())
    want = {}
    for doc, text in texts.items():
        if clean(text):
            want[doc] = " ".join(map(str, library.encode(text, add_special_tokens=False).ids))
    got = {r["doc_id"]: r["ids_sha256"] for r in entry.queries()["pipeline"](spark, FOLDER).collect()}
    assert got == {d: hashlib.sha256(ids.encode()).hexdigest() for d, ids in want.items()}
