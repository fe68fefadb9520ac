"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainscore.llm import bpe, cap_filters, chat_format, components, decontaminate, language, line_chunks, ngram_join, substring, toxicity, url_filter
from grainscore.llm.words import SLICE_BYTES, hashed_words

LONG = "word " * 3000 + "x" * 100_000
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "One two three."), (4, "One two three."), (None, "no id at all here"), (5, LONG), (6, "é 日本 🙂 \x00 \x1c")]
CLASH = ["n", "key", "cid", "row", "id", "hit", "words", "token", "score", "carried", "component_id", "n_words", "places", "_place", "label", "kept"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return frame.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(frame):
    return frame.collect()


def test_chat(spark):
    said = [(1, 0, "user", None), (1, 1, "assistant", "a\\<|end|>\n|>"), (1, 1, "assistant", "a\\<|end|>\n|>"), (2, 5, None, ""), (None, None, "we|ird<|", "[INST]")]
    frame = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in CLASH})
    examples = chat_format.expand(frame)
    parsed = examples.where("is_last").select("conv_id", chat_format.turns(F.col("formatted")).alias("t")).collect()
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in parsed} == {
        1: [("user", ""), ("assistant", "a\\<|end|>\n|>"), ("assistant", "a\\<|end|>\n|>")],
        2: [("", "")],
        None: [("we|ird<|", "[INST]")],
    }
    back = {r["conv_id"]: r for r in chat_format.read_back(examples).collect()}
    assert (back[1]["n_examples"], back[1]["loss_chars"], back[2]["loss_chars"]) == (2, 2 * len("a\\<|end|>\n|>"), 0)
    assert rows(chat_format.read_back(chat_format.expand(frame.limit(0)))) == []


def test_only_the_last_reply_is_under_the_mask(spark):
    said = [(1, i, r, f"{r}{i}") for i, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    examples = chat_format.expand(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    masked = [e["formatted"][e["loss_start"] : e["loss_start"] + e["loss_chars"]] for e in examples]
    assert masked == ["assistant2", "assistant4"]
    assert examples[1]["formatted"].startswith(examples[0]["formatted"])


def test_urls(spark):
    rules = [url_filter.Rule("block", "b.org", "/x/"), url_filter.Rule("allow", "a.b.org", "/x/"), url_filter.Rule("allow", "b.org", "/x/y")]
    urls = [None, "", "nothing", "http://", "http://A.b.ORG/x/", "http://b.org/x/?q", "http://b.org/x/yz", "http://cb.org/x/", "http://h/XXX", "http://h/xxxl", "http://h/sex/poker", "http://h/sex-sex"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({c: F.lit(0) for c in ["host", "rule"]})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(frame, rules).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.b.org", "/x/", "a.b.org/x/", "allow")
    assert got[5][2:] == ("b.org/x/", "block") and got[6][2:] == ("b.org/x/y", "allow") and got[7][2] is None
    assert [got[i][3] for i in (8, 9, 10, 11)] == ["block", "allow", "block", "allow"]
    assert rows(url_filter.judge(frame.limit(0), rules)) == []


def test_automaton_finds_every_occurrence():
    draw = random.Random(1)
    for _ in range(200):
        terms = ["".join(draw.choices("ab", k=draw.randint(1, 4))) for _ in range(5)]
        text = "".join(draw.choices("ab", k=30))
        auto = url_filter.Automaton(terms)
        want = {(t, i + len(t)) for t in terms for i in range(30) if text.startswith(t, i)}
        assert {(auto.terms[n], end) for n, end in auto.hits(text)} == want


def test_tokens(docs, none):
    got = rows(bpe.encode(docs, bpe.vocabulary()))
    assert len(got) == len(TEXTS)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert rows(bpe.encode(none, bpe.vocabulary())) == []


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    library, coder, draw = Tokenizer.from_file(bpe.vocabulary()), bpe.Coder(bpe.load(bpe.vocabulary())), random.Random(2)
    pool = [chr(i) for i in [*range(0x250), *range(0x370, 0x400), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600]]
    odd = ["<|endoftext|>a<|startoftext|> b", "ΑΣ ΟΔΟΣ Σ", "İ ǅ ß ẞ", "don't we'll I'D'S"] + ["".join(draw.choices(pool, k=40)) for _ in range(300)]
    for text in odd:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids
        assert coder.coded(text)[2] == library.decode(ids, skip_special_tokens=False)


def test_language(spark, docs, none):
    learned = spark.createDataFrame(
        [(i, t, name) for i in range(40) for t, name in ((f"the house is on the hill {i}", "en"), (f"das haus steht auf dem berg {i}", "de"))]
        + [(99, "no label", None), (98, None, "fr"), (97, "123", "fr")],
        "doc_id long, text string, lang string",
    )
    model = language.fit(learned)
    assert model.languages == ["de", "en"]
    got = {(r["doc_id"], r["lang_pred"], r["accepted"]) for r in rows(language.predict(docs, model))}
    assert {(1, "und", False), (2, "und", False), (3, "und", False)} <= got
    assert [r["lang_pred"] for r in rows(language.predict(learned.where("doc_id = 3"), model))] == ["en", "de"]
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and not {1, 2, 3} & {r["doc_id"] for r in rows(kept)}
    nothing = language.fit(learned.limit(0))
    assert {r["lang_pred"] for r in rows(language.predict(docs, nothing))} == {"und"}
    assert rows(language.predict(none, model)) == []


def test_toxicity(spark, docs, none):
    texts = spark.createDataFrame([(i, f"you {'vermin' if i % 2 else 'friend'} number {i}") for i in range(60)], "doc_id long, text string")
    marks = texts.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).unionByName(
        spark.createDataFrame([(7, None), (None, 1)], "doc_id long, toxic int")
    )
    model = toxicity.fit(marks, texts)
    got = {r["doc_id"]: r["predicted"] for r in rows(toxicity.score(texts, model))}
    assert got == {i: i % 2 for i in range(60)}
    assert all(0 <= r["score"] <= 1 for r in rows(toxicity.score(docs, model)))
    one_class = toxicity.fit(marks.where("toxic = 0"), texts)
    assert {r["predicted"] for r in rows(toxicity.score(docs, one_class))} == {0}
    assert rows(toxicity.score(none, model)) == [] and toxicity.fit(marks.limit(0), texts).bias < 0


def test_decontamination(spark, docs, none):
    long_item = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, long_item), (1, long_item), (2, "Three"), (3, None), (4, "..."), (None, "one two"), (5, "word word")], "item_id long, text string")
    texts = docs.unionByName(
        spark.createDataFrame([(7, "a " + long_item.upper() + " b"), (8, " ".join(f"w{i}" for i in range(12)))], "doc_id long, text string"), allowMissingColumns=True
    )
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in rows(decontaminate.decontaminate(texts, items))}
    assert got[1] == got[2] == got[3] == (0, 0, [], False)
    assert got[4] == (3, 3, ["2"], True)
    assert got[5] == (3001, 3000, ["5"], True)
    assert got[7] == (22, 20, ["1"], True) and got[8] == (12, 0, [], False)
    kept = decontaminate.clean(texts, items)
    assert kept.columns == texts.columns and sorted(str(r["doc_id"]) for r in rows(kept)) == ["1", "2", "3", "6", "8", "None"]
    assert len(rows(decontaminate.decontaminate(texts, items.limit(0)))) == len(TEXTS) + 2
    assert rows(decontaminate.decontaminate(none, items)) == []


def test_large_benchmarks_are_joined_in_parts(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"v{i}x{j}" for j in range(15))) for i in range(20)], "item_id long, text string")
    texts = items.select(F.col("item_id").alias("doc_id"), "text")
    monkeypatch.setattr(decontaminate, "PART_ROWS", 20)
    got = rows(decontaminate.decontaminate(texts, items))
    assert sorted((r["doc_id"], r["n_hit"], r["item_ids"]) for r in got) == [(i, 15, [str(i)]) for i in range(20)]


def test_joins(spark, docs, none):
    got = rows(ngram_join.join(docs))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(
        [("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 1, "4"), ("4", 1, "4"), ("None", 1, "None"), ("5", 2, "5"), ("6", 1, "6")]
    )
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and len(rows(kept)) == len(TEXTS) - 1
    assert rows(ngram_join.join(none)) == []


def test_near_copies_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    draw = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    texts = [(i, " ".join(w + "x" * (draw.random() < 0.02) for w in base[draw.randint(0, 3) :])) for i in range(80)]
    texts += [(i, " ".join(draw.choices(base, k=30))) for i in range(100, 140)]
    got = {r["doc_id"]: r["component_id"] for r in rows(ngram_join.join(spark.createDataFrame(texts, "doc_id long, text string")))}
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in texts}
    least = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and Fraction(both, len(sets[a] | sets[b])) >= Fraction(8, 10) and least[b] < least[a]:
                    least[a], changed = least[b], True
    assert got == least


@pytest.mark.parametrize("threshold", [Fraction(85, 100), Fraction(8, 10)])
def test_trie_join_is_exact(threshold):
    measure, draw = ngram_join.Measure(threshold), random.Random(5)
    for _ in range(60):
        base = draw.sample(range(1000), 40)
        sets = []
        for _ in range(12):
            own = set(draw.sample(base, draw.randint(30, 40))) | set(draw.sample(range(1000), draw.randint(0, 3)))
            sets.append(np.array(sorted(own), np.uint64))
        linked = ngram_join.trie_join(sets, measure, list(range(12)))
        groups = list(range(12))
        for a, b in linked:
            assert Fraction(len(np.intersect1d(sets[a], sets[b])), len(np.union1d(sets[a], sets[b]))) >= threshold
            groups = [groups[a] if g == groups[b] else g for g in groups]
        for a in range(12):
            for b in range(a):
                if Fraction(len(np.intersect1d(sets[a], sets[b])), len(np.union1d(sets[a], sets[b]))) >= threshold:
                    assert groups[a] == groups[b]


def test_vectors(spark):
    unit = [1.0] + [0.0] * 15
    data = [(1, unit), (1, unit), (2, [2.0] + [0.0] * 15), (3, [0.0] * 16), (4, None), (5, [None] * 16), (6, [float("nan")] * 16), (7, []), (None, unit), (8, [1.0, 1.0])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({c: F.lit(0) for c in ["v", "cid", "weight", "a"]})
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in rows(cap_filters.near(frame)))
    assert got == sorted([("1", 3, 1), ("1", 3, 1), ("2", 3, 1), ("3", 0, 3), ("4", 0, 4), ("5", 0, 5), ("6", 0, 6), ("7", 0, 7), ("None", 3, 1), ("8", 0, 8)])
    assert rows(cap_filters.near(frame.limit(0))) == []


def test_components(spark):
    draw = random.Random(6)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5)]
    least = {v: v for e in edges for v in e}
    for _ in range(len(least)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["vertex"]: r["component"] for r in rows(components.components(spark.createDataFrame(edges, "a long, b long")))}
    assert all(least[v] == got.get(v, v) for v in least)
    assert rows(components.components(spark.createDataFrame([], "a long, b long"))) == []


def test_substrings(spark, docs, none):
    run = " ".join(f"r{i}" for i in range(40))
    texts = docs.unionByName(
        spark.createDataFrame([(7, "x " + run + " y"), (8, run), (9, run + " " + run), (10, " ".join(run.split()[:34]))], "doc_id long, text string"), allowMissingColumns=True
    )
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows(substring.dedup(texts))}
    assert got[1] == got[2] == got[3] == (0, 0, "")
    assert got[4] == (3, 0, "One two three.")
    assert got[5] == (3001, 3000, "x" * 100_000)
    assert got[7] == (42, 40, "x y") and got[8] == (40, 40, "") and got[9] == (80, 80, "") and got[10][1] == 0
    assert rows(substring.dedup(none)) == []


def test_repeated_rows_repeat_each_other(spark):
    text = " ".join(f"q{i}" for i in range(50))
    frame = spark.createDataFrame([(1, text), (1, text), (2, "alone")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows(substring.dedup(frame))) == [(1, 50), (1, 50), (2, 0)]


def test_lines(spark, docs, none):
    part = "\n".join(f"line {i}" for i in range(12))
    texts = docs.unionByName(spark.createDataFrame([(7, part), (8, "other\n" + part), (9, "\n\n\n\n")], "doc_id long, text string"), allowMissingColumns=True)
    got = {r["doc_id"]: r for r in rows(line_chunks.dedup(texts, carry=["key"]))}
    assert got[1]["text"] is None and got[2]["text"] == "" and got[7]["text"] == part and got[9]["text"] == "\n\n\n\n"
    assert got[8]["n_removed"] > 0 and got[8]["n_lines"] == 13 and got[4]["carried"]["key"] == "clash"
    assert rows(line_chunks.dedup(none)) == []


def test_boundaries_move_with_the_lines():
    draw = random.Random(7)
    body = [draw.getrandbits(64) for _ in range(200)]
    for shift in range(1, 6):
        moved = [draw.getrandbits(64) for _ in range(shift)] + body
        ends, other = set(line_chunks.boundaries(body)), {e - shift for e in line_chunks.boundaries(moved)}
        assert len(ends & other) > 0.8 * len(ends)
        assert sum(np.diff([0, *line_chunks.boundaries(moved)])) == len(moved)


def test_word_hashes_do_not_depend_on_slices():
    long_text = "alpha beta " * (SLICE_BYTES // 8)
    hashes, offsets = hashed_words([None, "alpha beta", long_text, ""])
    assert list(np.diff(offsets)) == [0, 2, len(long_text.split()), 0]
    assert set(hashes[2:]) == set(hashes[:2])
    assert (hashed_words(["ABC é"], lower=True)[0] == hashed_words(["abc é"])[0]).all()
    assert (hashed_words(["É"], lower=True)[0] != hashed_words(["é"])[0]).all()
