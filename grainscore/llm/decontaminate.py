"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

An item's windows are its runs of ``window`` consecutive words (the whole item
when it is shorter).  A window occurs in a text only with all its shingles, so
one necessary shingle per window, its prefix, finds every occurrence: the
rarest by its count over all texts.  Occurrences of prefix shingles in the
texts are joined to the windows; a place is dropped when the window would begin
before the text or end behind it; what is left is compared word by word.

Texts are split into words twice for each shingle width in use (``SHINGLE``, and one
for items of fewer words) and each part of the windows, once to count the item
shingles and once to join, and read once more to give every row its result.
Words are exploded within one stage that keeps only what matches.  What is
shuffled are counts, hits and identifiers, never texts; rows go by two hashes of
identifier and text, 128 bits, so nothing depends on the order rows come in.  Windows are broadcast in parts of
at most ``PART_ROWS`` rows, as many parts as a benchmark needs, so the size of
a broadcast is bounded and nothing depends on the benchmark being small.

Defined results: null, empty and wordless texts have no words and no hits;
items without words have no windows; items with equal windows are all named;
repeated rows of a text give repeated results, repeated item rows count once;
null item ids are not named; empty tables give no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainscore.llm.shared import ascii_lower, cut

WINDOW = 13
SHINGLE = 2
PART_ROWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    """Words of a text; only the first and the last may be empty."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def shingle(words: Column, at: Column, width: int) -> Column:
    """Hash of ``width`` words from place ``at``; behind the end there is nothing to add."""
    return F.xxhash64(F.lit(width), *[F.get(words, at + k) for k in range(width)])


def windows(items: DataFrame, item: str, text: str, length: int) -> DataFrame:
    """Distinct windows with the items that have them: window_id, words, n, item_ids."""
    words = items.select(F.col(item).alias("item_id"), F.array_remove(split_words(F.col(text).cast("string")), "").alias("words"))
    words = words.where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - length, F.lit(0)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i + 1, length))).alias("words"))
    found = each.groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))
    return found.select(F.xxhash64("words", F.lit(1)).alias("window_id"), "words", F.size("words").alias("n"), "item_ids")


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(
        F.col(doc).alias("doc_id"), F.xxhash64(F.col(doc), body).alias("key"), F.xxhash64(F.lit(2), body, F.col(doc)).alias("again"), body.alias("body")
    )


def _texts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc_id, key, again, words and n_words of every row; equal rows have equal hashes ``key`` and ``again``."""
    read = _keyed(docs, doc, text).select("doc_id", "key", "again", split_words(F.col("body")).alias("words"))
    blank_first = (F.get("words", F.lit(0)) == "").cast("int")
    blank_last = F.when(F.size("words") > 1, (F.element_at("words", -1) == "").cast("int")).otherwise(0)
    return read.withColumn("n_words", F.size("words") - blank_first - blank_last)


def _parts(frame: DataFrame, rows: int) -> list[DataFrame]:
    """``frame`` in parts of about ``PART_ROWS`` rows."""
    n = max(1, -(-rows // PART_ROWS))
    return [frame.where(F.pmod(F.xxhash64("token"), F.lit(n)) == k) if n > 1 else frame for k in range(n)]


def _counts(docs: DataFrame, tokens: DataFrame, width: int, text: str) -> DataFrame:
    """How often each of the tokens occurs in all texts: token, seen."""
    places = docs.select(split_words(F.col(text).cast("string")).alias("words")).select("words", F.posexplode("words").alias("at", "word"))
    return places.select(shingle(F.col("words"), F.col("at"), width).alias("token")).join(F.broadcast(tokens), "token").groupBy("token").agg(F.count("*").alias("seen"))


def prefixes(docs: DataFrame, found: DataFrame, text: str, width: int = SHINGLE) -> dict[int, DataFrame]:
    """Per shingle width in use, the windows with their rarest shingle: token, offset, words, n, window_id.

    Windows of fewer words than ``width`` use a shingle of all their words.
    """
    out = {}
    for size in sorted({min(width, r["n"]) for r in found.select("n").distinct().collect()}):
        own = found.where(F.least(F.col("n"), F.lit(width)) == size)
        places = own.select("window_id", "words", "n", F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("offset"))
        places = places.withColumn("token", shingle(F.col("words"), F.col("offset"), size))
        tokens = cut(places.select("token").distinct())
        seen = None
        for part in _parts(tokens, tokens.count()):
            counts = _counts(docs, part, size, text)
            seen = counts if seen is None else seen.unionByName(counts)
        ranked = places.join(seen, "token", "left").groupBy("window_id").agg(
            F.min_by(F.struct("token", "offset", "words", "n"), F.struct(F.coalesce("seen", F.lit(0)), "token", "offset")).alias("first"),
            F.min(F.coalesce("seen", F.lit(0))).alias("seen"),
        )
        # a window whose rarest shingle is nowhere has no occurrence
        out[size] = cut(ranked.where(F.col("seen") > 0).select("window_id", "first.*"))
    return out


def occurrences(texts: DataFrame, windows_of: DataFrame, width: int) -> DataFrame:
    """Verified occurrences, and one row with null ``hit`` per text: doc_id, key, again, n_words, hit."""
    places = texts.select("doc_id", "key", "again", "n_words", "words", F.posexplode("words").alias("at", "word"))
    places = places.withColumn("token", shingle(F.col("words"), F.col("at"), width))
    found = windows_of.select(F.col("token").alias("prefix"), "offset", "n", F.col("words").alias("said"), "window_id")
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("n") <= F.size("words"))
    # the words of a text stay in the stage that explodes them: only what is verified becomes a row
    same = F.slice(F.col("words"), F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("said")
    joined = places.join(F.broadcast(found), (F.col("token") == F.col("prefix")) & inside & same, "left")
    hit = F.when(F.col("window_id").isNotNull(), F.struct(start.alias("start"), "n", "window_id"))
    return joined.where((F.col("at") == 0) | F.col("window_id").isNotNull()).select("doc_id", "key", "again", "n_words", hit.alias("hit"))


def hit_words(spans: Column) -> Column:
    """Number of places under sorted (start, n) spans."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )


def _judged(docs: DataFrame, items: DataFrame, doc: str, text: str, item: str, item_text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, again, n_words, n_hit, window_ids, contaminated of every distinct row, and the windows: written tables."""
    found = cut(windows(items, item, item_text, window))
    by_width = prefixes(docs, found, text)
    texts = _texts(docs, doc, text)
    parts = [
        occurrences(texts, part, width)
        for width, all_windows in by_width.items()
        for part in _parts(all_windows, all_windows.count())
    ]
    if not parts:
        parts = [texts.select("doc_id", "key", "again", "n_words", F.lit(None).cast("struct<start:int,n:int,window_id:bigint>").alias("hit"))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    per_text = rows.groupBy("key", "again").agg(
        F.min("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("hit").isNotNull(), F.struct("hit.start", "hit.n"))).alias("spans"),
        F.collect_set("hit.window_id").alias("window_ids"),
    )
    hit = hit_words(F.sort_array("spans"))
    per_text = per_text.select("doc_id", "key", "again", F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), "window_ids")
    over = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return cut(per_text.withColumn("contaminated", over)), found


def decontaminate(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """doc_id, key (hash of identifier and text), n_words, n_hit, item_ids (sorted strings), contaminated of every row."""
    per_text, found = _judged(docs, items, doc, text, item, item_text, window)
    named = (
        per_text.select("key", "again", F.explode("window_ids").alias("window_id"))
        .join(found.select("window_id", F.explode("item_ids").alias("item_id")), "window_id")
        .groupBy("key", "again")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    results = per_text.drop("doc_id").join(named, ["key", "again"], "left")
    none = F.array().cast("array<string>")
    return _keyed(docs, doc, text).join(results, ["key", "again"]).select(
        "doc_id", "key", "n_words", "n_hit", F.coalesce("item_ids", none).alias("item_ids"), "contaminated"
    )


def clean(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with all their columns."""
    found, _ = _judged(docs, items, doc, text, item, item_text, window)
    dropped = found.where("contaminated").select(F.col("doc_id").alias("id"), "key")
    whole = docs.select(F.struct("*").alias("row"), F.col(doc).alias("id"), F.xxhash64(F.col(doc), F.col(text).cast("string")).alias("key"))
    same = (F.col("a.key") == F.col("b.key")) & F.col("a.id").eqNullSafe(F.col("b.id"))
    return whole.alias("a").join(dropped.alias("b"), same, "left_anti").select("row.*")
