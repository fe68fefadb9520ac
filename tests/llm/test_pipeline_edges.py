"""The whole pipeline over tables with nulls, repeated rows, long texts, clashing columns, and over empty tables."""

import hashlib

import corpus_pipeline
import pytest

from grainscore.llm.bpe import vocabulary

CLASH = "key string, row long, others string, id string, carried string, words long, again string, body string"
ENGLISH = [f"The quick fox number {i} ran over the hill and found the river in the valley of {i} trees." for i in range(40)]
LONG = "\n".join(f"Line {i} says that all of the people in town {i * 7} went home." for i in range(4000))


def tables(spark, folder, rows, items):
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
    extra = (None, 1, "o", "i", None, 2, "a", "b")
    spark.createDataFrame([(d, t, lang, None, None, *extra) for d, t, lang in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def results(spark, folder):
    found = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    return sorted(map(tuple, found.collect()), key=str)


def test_odd_rows(spark, folder):
    rows = [(i, t, "en") for i, t in enumerate(ENGLISH)]
    rows += [(100, None, "en"), (101, "", None), (102, " \n ", "en"), (103, "123 456", None), (None, ENGLISH[0] + " With no identifier at all, it stays.", None)]
    rows += [(200, LONG, "en")] * 3 + [(1, ENGLISH[1], "en"), (300, ENGLISH[2], None)]
    items = [(1, None), (2, "..."), (None, "never said anywhere"), (4, ENGLISH[5]), (4, ENGLISH[5])]
    tables(spark, folder, rows, items)
    got = results(spark, folder)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    # without letters: 100 to 103 go; copies: 1 and 200 stay once, 300 goes; 5 is in the benchmark
    stay = {i: t for i, t in enumerate(ENGLISH) if i != 5} | {200: LONG, None: rows[44][1]}
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in stay.items()}
    want = [(d, len(n), hashlib.sha256(" ".join(map(str, n)).encode()).hexdigest(), hashlib.sha256(library.decode(n, skip_special_tokens=False).encode()).hexdigest()) for d, n in ids.items()]
    assert {r[0] for r in got} <= set(stay)
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("rows, items", [([], []), ([(1, None, "en")], [(1, "one two")])])
def test_empty_tables(spark, folder, rows, items):
    tables(spark, folder, rows, items)
    assert results(spark, folder) == []
