"""Line dedup against a brute-force list of repeated runs of lines."""

import random

import duckdb
import pytest

import corpus_pipeline
from grainscore.llm import line_chunks


def by_brute_force(texts):
    """What is kept of (doc, text) in order: lines of no run of two or more lines that stands earlier, all of it or in parts."""
    seen, kept = set(), {}
    for doc, text in texts:
        lines = text.split("\n")
        gone = set()
        for at in range(len(lines) - 1):
            if "".join(lines[at : at + 2]).strip():
                if (lines[at], lines[at + 1]) in seen:
                    gone |= {at, at + 1}
                seen.add((lines[at], lines[at + 1]))
        kept[doc] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return kept


def kept(spark, texts):
    return {r["doc_id"]: r["text"] for r in line_chunks.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("length", [2, 3, 4, 7])
def test_no_passage_in_other_texts_is_missed(spark, length):
    draw = random.Random(length)

    def lines(n):
        return [" ".join(draw.choices("abcdefghij", k=27)) for _ in range(n)]

    texts, passages = [], []
    for i in range(40):
        passages.append(lines(length))
        for doc in (2 * i, 2 * i + 1):
            texts.append((doc, "\n".join(lines(draw.randint(1, 4)) + passages[i] + lines(draw.randint(0, 4)))))
    got = kept(spark, texts)
    for i, passage in enumerate(passages):
        first, second = texts[2 * i][1], texts[2 * i + 1][1].split("\n")
        assert got[2 * i] == first
        assert got[2 * i + 1].split("\n") == [x for x in second if x not in passage]


def test_repeated_runs_of_the_documents(spark):
    texts = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    assert kept(spark, texts) == by_brute_force(texts)


def test_copies_with_blank_lines_and_single_lines(spark):
    text = "\n\n\na\n\n\n\nb\n\nc\n\n\n"
    got = kept(spark, [(1, text), (2, text), (3, "once\nmore"), (4, "x\nmore\ny"), (5, "more"), (6, "\n\n\n\n"), (7, "\n\n\n\n"), (8, "q\nq\nq\nq")])
    assert got == {1: text, 2: "", 3: "once\nmore", 4: "x\nmore\ny", 5: "more", 6: "\n\n\n\n", 7: "\n\n\n\n", 8: "q"}


def test_the_pipeline_drops_documents_without_a_line_left(spark):
    text = "one line\nand more"
    texts = [(1, text), (2, text), (3, text + "\n\n"), (4, text + "\nown"), (5, None), (6, ""), (7, "\n\n"), (8, "\n\n"), (9, "alone"), (10, "alone")]
    docs = spark.createDataFrame([(d, t, "en", len(t or "")) for d, t in texts], "doc_id long, text string, lang string, n_chars long")
    got = corpus_pipeline.line_dedup(spark, docs, "")
    assert got.columns == docs.columns
    want = {1: text, 4: "own", 5: None, 6: "", 7: "\n\n", 8: "\n\n", 9: "alone", 10: "alone"}
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_chunks_of_a_passage_do_not_depend_on_its_surroundings():
    draw = random.Random(9)
    passage = [f"p{i}" for i in range(6)]
    for _ in range(50):
        before, after = ([f"s{draw.random()}" for _ in range(draw.randint(0, 5))] for _ in range(2))
        found = set(line_chunks.spans(before + passage + after))
        assert {(len(before) + i, len(before) + i + 2) for i in range(5)} <= found


def test_no_rule_is_needed_twice_and_long_chunks_come_from_rolling_sums():
    lines = [f"line {i}" for i in range(400)]
    found = line_chunks.spans(lines)
    assert len(found) == len(set(found))
    ends = [0, *line_chunks.boundaries([line_chunks.xxhash.xxh3_128_intdigest(x.encode()) & line_chunks._ALL for x in lines])]
    assert {(a, b) for a, b in zip(ends, ends[1:]) if b - a > 1} <= set(found)
    assert line_chunks.spans(["", " ", "", ""]) == [] and line_chunks.spans(["x"]) == []
