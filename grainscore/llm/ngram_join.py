"""N-gram Jaccard join: which texts are alike, by a prefix-tree join.

A text is the set of its hashed n-word shingles.  Texts with equal sets form a
class.  All tokens have one global order: first those with a hash below
``low``, by how many texts have them; then the others by hash; last the few
that are in so many texts that a bounded list names them all.  By the prefix
filter two sets that are alike share a token among their first
``n - ceil(t n) + 1``, so a token that no other set has in its prefix is
useless, and a set whose prefix is made of tokens of its own needs no
comparison at all.  That is so for nearly all texts.

What two sets share of their low tokens, and their sizes, bound their overlap.
Sets under one prefix token that may be alike by that bound are connected, and
the components of these hopes are clusters, nearly all of a few sets.  Whole
sets are only fetched for clusters, once each, and joined in blocks of bounded
size: the block's sets, in the block's order of rarity, make up a trie; each
set runs through it and shares the overlap so far with all sets below a node; a
subtree is left as soon as what remains of the set or of the longest branch
cannot reach the overlap that its smallest set needs.  Sets that are already
known to be connected are not compared again.  A cluster of more than
``WHOLE_BLOCKS`` blocks is no group of its own: its sets meet under their prefix
tokens, so what is sent grows with the sets and not with the cluster's square.

To keep a group of very many near copies linear, in hopes as in links, two
rounds first join one set per component and token, each set under one token
only.  The last round takes every token whose sets are in several components
yet: blocks of the sets outside of the token's largest component meet each
other and that component's blocks.  So every pair of sets that shares a prefix
token has been compared, or is connected through others.

Hashes: 64 bits for tokens and classes, compared as such.

Defined results: null, empty and wordless texts have empty sets and are linked
with nothing; a text of fewer words than ``width`` is one shingle; the words
are in lower case for A-Z alone; repeated rows are copies; the component of a
text is its least identifier, null identifiers apart; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainscore.llm.cap_filters import forest
from grainscore.llm.components import components
from grainscore.llm.shared import cut, temporary
from grainscore.llm.words import hashed_words, sequences, signed

WIDTH = 5
THRESHOLD = Fraction(8, 10)
BLOCK = 256
ROUNDS = 2
ROWS = 256
# A token in this share of all texts, and in this many, is named in the list of frequent ones.
FREQUENT_SHARE = 0.005
FREQUENT_LEAST = 50
SEEN_CLASSES = 100_000
# Keys of the texts whose sets are wanted that are broadcast; more are joined by exchange.
BROADCAST_KEYS = 1 << 20
# A cluster of more blocks than this is joined under its prefix tokens, not as a whole.
WHOLE_BLOCKS = 64


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    hashes, offsets = hashed_words(texts, lower=True)
    every = sequences(hashes, np.arange(max(0, len(hashes) - width + 1)), width)
    out = []
    for start, end in zip(offsets[:-1], offsets[1:]):
        if end - start >= width:
            out.append(np.unique(every[start : end - width + 1]))
        elif end > start:
            out.append(sequences(hashes[start:end], np.zeros(1, np.int64), int(end - start)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(tokens: np.ndarray) -> int | None:
    return int(signed(sequences(tokens, np.zeros(1, np.int64), len(tokens)))[0]) if len(tokens) else None


class Measure:
    """Jaccard similarity of at least ``threshold``, in whole numbers."""

    def __init__(self, threshold: Fraction):
        self.top, self.bottom = threshold.numerator, threshold.denominator
        # tokens below this hash are counted: somewhat more than any prefix needs
        self.low = np.uint64(min(1.0, 1.5 * (1 - float(threshold))) * (2**64 - 2048))

    def prefix(self, n: int) -> int:
        return n + (-n * self.top // self.bottom) + 1

    def prefix_sql(self, n: Column) -> Column:
        return n - F.ceil(n * self.top / F.lit(self.bottom).cast("double") - 1e-9).cast("int") + 1

    def overlap(self, m: int, n: int) -> int:
        """Least overlap of alike sets of ``m`` and ``n`` tokens."""
        return -(-(m + n) * self.top // (self.top + self.bottom))


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(F.col(doc).alias("doc_id"), F.xxhash64(F.col(doc), body).alias("key"), body.alias("text"))


def _profiles(keyed: DataFrame, width: int, measure: Measure) -> DataFrame:
    """A row per text: doc_id, key, n, low, cid; and rows of frequent tokens of a batch: token, seen."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lows, ns, low, cids = [], [], [], []
            for at in range(0, batch.num_rows, ROWS):
                for tokens in shingle_sets(batch.column(2).slice(at, ROWS).to_pylist(), width):
                    below = int(np.searchsorted(tokens, measure.low))
                    ns.append(len(tokens))
                    low.append(below)
                    cids.append(class_of(tokens))
                    lows.append(tokens[:below])
            n = batch.num_rows
            empty = pa.nulls(n, pa.int64())
            arrays = [batch.column(0), batch.column(1), pa.array(ns, pa.int32()), pa.array(low, pa.int32()), pa.array(cids, pa.int64()), empty, empty]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            met, times = np.unique(np.concatenate(lows) if lows else np.zeros(0, np.uint64), return_counts=True)
            often = times >= max(3, FREQUENT_SHARE / 2 * n)
            met, times = met[often], times[often]
            m = len(met)
            arrays = [pa.nulls(m, batch.schema.field(0).type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(signed(met)), pa.array(times)], names=names)

    names = ["doc_id", "key", "n", "low", "cid", "token", "seen"]
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(batches, f"doc_id {kind}, key long, n int, low int, cid long, token long, seen long")


def _tokens(keyed: DataFrame, width: int, measure: Measure, frequent: np.ndarray) -> DataFrame:
    """Tokens that may be in a prefix: token, cid, kind (0 low, 1 not low, 2 frequent)."""
    shared = keyed.sparkSession.sparkContext.broadcast(frequent)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = shared.value, {}
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                parts, cids, kinds = [], [], []
                for tokens in shingle_sets(batch.column(0).slice(at, ROWS).to_pylist(), width):
                    cid = class_of(tokens)
                    if cid is None or cid in met:
                        continue
                    if len(met) >= SEEN_CLASSES:
                        met.clear()
                    met[cid] = True
                    below = int(np.searchsorted(tokens, measure.low))
                    low = tokens[:below]
                    often = known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low if len(known) else np.zeros(below, bool)
                    more = max(0, measure.prefix(len(tokens)) - int((~often).sum()))
                    own = np.concatenate((low, tokens[below : below + more]))
                    kind = np.ones(len(own), np.int8)
                    kind[:below] = often * 2
                    parts.append(own)
                    kinds.append(kind)
                    cids.append(np.full(len(own), cid, np.int64))
                if parts:
                    arrays = [pa.array(signed(np.concatenate(parts))), pa.array(np.concatenate(cids)), pa.array(np.concatenate(kinds))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["token", "cid", "kind"])

    return keyed.select("text").mapInArrow(batches, "token long, cid long, kind tinyint")


def _prefixes(tokens: DataFrame, classes: DataFrame, measure: Measure) -> tuple[DataFrame, DataFrame]:
    """(token, cid) of prefix tokens that other classes have too; (cid, n, low, shared) with all low tokens of a class that others have.

    Only classes with such a prefix are in either.
    """
    own = Window.partitionBy("token")
    counted = tokens.where("kind < 2").select(
        "*", F.count("*").over(own).alias("seen"), F.min("cid").over(own).alias("first"), F.max("cid").over(own).alias("last")
    )
    shared = counted.where("first <> last").select("token", "cid", "kind", "seen")
    shared = shared.unionByName(tokens.where("kind = 2").select("token", "cid", "kind", F.lit(0).cast("long").alias("seen")))
    per_class = shared.groupBy("cid").agg(F.sort_array(F.collect_set(F.struct("kind", "seen", "token"))).alias("all"))

    def of(kind: int) -> Column:
        return F.filter("all", lambda t: t["kind"] == kind)

    sized = per_class.join(classes.select("cid", "n", "low"), "cid").select(
        "cid", "n", "low", of(0).alias("rare"), of(1).alias("rest"), of(2).alias("often"), measure.prefix_sql(F.col("n")).alias("p")
    )
    plain = F.col("low") - F.size("often")
    n_rare = F.greatest(F.lit(0), F.least(F.size("rare"), F.col("p") - (plain - F.size("rare"))))
    n_often = F.greatest(F.lit(0), F.least(F.size("often"), F.col("p") - plain - (F.col("n") - F.col("low"))))
    prefix = F.concat(F.slice("rare", F.lit(1), n_rare), F.col("rest"), F.slice("often", F.lit(1), n_often))
    found = cut(
        sized.select(
            "cid",
            "n",
            "low",
            F.transform(prefix, lambda t: t["token"]).alias("prefix"),
            F.transform(F.concat("rare", "often"), lambda t: t["token"]).alias("shared"),
        ).where(F.size("prefix") > 0)
    )
    return found.select("cid", F.explode("prefix").alias("token")), found.select("cid", "n", "low", "shared")


def _sets(keyed: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """Sets of the texts that stand for the classes in ``reps`` (cid, key), one row each: cid, n, tokens as bytes.

    Texts are found by a semi join; up to ``BROADCAST_KEYS`` keys go to the texts, beyond that Spark joins by exchange.
    """
    keys = reps.select("key")
    if reps.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = {}
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                once = {}
                for tokens in shingle_sets(batch.column(0).slice(at, ROWS).to_pylist(), width):
                    # rows repeated with equal id and text; the few that other tasks have too go below
                    cid = class_of(tokens)
                    if cid in met:
                        continue
                    if len(met) >= SEEN_CLASSES:
                        met.clear()
                    met[cid] = True
                    once[cid] = tokens
                arrays = [pa.array(list(once), pa.int64()), pa.array([len(s) for s in once.values()], pa.int32())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([s.tobytes() for s in once.values()], pa.binary())], names=["cid", "n", "tokens"])

    read = keyed.join(keys, "key", "left_semi").select("text").mapInArrow(batches, "cid long, n int, tokens binary")
    return read.dropDuplicates(["cid"])


def trie_join(sets: list[np.ndarray], measure: Measure, known: list[int], apart: list[bool] | None = None) -> list[tuple[int, int]]:
    """Pairs of places that link sets not yet connected; ``known``: component of each; two ``apart`` are not compared."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    # tokens of one set only count for its size; the others get ranks by rarity in this block
    tokens, times = np.unique(np.concatenate(sets), return_counts=True)
    rank = np.full(len(tokens), -1, np.int64)
    often = np.flatnonzero(times > 1)
    rank[often[np.argsort(times[often], kind="stable")]] = np.arange(len(often))
    ranked = [np.searchsorted(tokens, s) for s in sets]
    ranked = [np.sort(r[r >= 0]) for r in (rank[p] for p in ranked)]
    listed = [r.tolist() for r in ranked]
    order = sorted(range(len(sets)), key=lambda i: listed[i])
    rows, sizes = [listed[i] for i in order], [len(sets[i]) for i in order]
    links: list[tuple[int, int]] = []

    def visit(probe: int, lo: int, hi: int, depth: int, at: int, overlap: int) -> None:
        """Compare ``probe`` with the sets ``lo:hi``, which agree in their first ``depth`` tokens."""
        row, size = rows[probe], sizes[probe]
        while True:
            if hi - lo == 1:
                a, b = order[probe], order[lo]
                if find(known[a]) == find(known[b]) or apart and apart[a] and apart[b]:
                    return
                need = measure.overlap(size, sizes[lo])
                if need > min(size, sizes[lo]) or overlap + min(len(row) - at, len(rows[lo]) - depth) < need:
                    return
                rest = np.intersect1d(ranked[a][at:], ranked[b][depth:], assume_unique=True)
                if overlap + len(rest) >= need:
                    parent[find(known[a])] = find(known[b])
                    links.append((a, b))
                return
            least = min(sizes[lo:hi])
            longest = max(map(len, rows[lo:hi])) - depth
            if overlap + min(len(row) - at, longest) < measure.overlap(size, least):
                return
            if len(rows[lo]) == depth:
                end = lo
                while end < hi and len(rows[end]) == depth:
                    visit(probe, end, end + 1, depth, at, overlap)
                    end += 1
                lo = end
                if lo == hi:
                    return
                continue
            token = rows[lo][depth]
            end = hi if rows[hi - 1][depth] == token else lo + 1
            while end < hi and rows[end][depth] == token:
                end += 1
            next_at = at
            while next_at < len(row) and row[next_at] < token:
                next_at += 1
            hit = next_at < len(row) and row[next_at] == token
            if end < hi:
                visit(probe, lo, end, depth + 1, next_at + hit, overlap + hit)
                lo = end
            else:
                depth, at, overlap = depth + 1, next_at + hit, overlap + hit

    for probe in range(len(rows) - 1):
        visit(probe, probe + 1, len(rows), 0, 0, 0)
    return links


def hopeful(sizes: np.ndarray, low: np.ndarray, shared: list[np.ndarray], known: np.ndarray, apart: np.ndarray, measure: Measure) -> np.ndarray:
    """Matrix of the sets of a block that may be alike and are of different components, by their low tokens and their sizes.

    Low tokens of two sets overlap by what they share of them; the others overlap by the smaller number at most.
    """
    need = -(-(sizes[:, None] + sizes[None, :]) * measure.top // (measure.top + measure.bottom))
    lengths, rest = np.array([len(s) for s in shared]), sizes - low
    fits = (need <= np.minimum.outer(sizes, sizes)) & (known[:, None] != known[None, :]) & ~(apart[:, None] & apart[None, :])
    fits &= np.minimum.outer(lengths, lengths) + np.minimum.outer(rest, rest) >= need
    # sizes alone settle most sets; the tokens are only looked at for the others
    some = np.flatnonzero(fits.any(axis=1))
    out = np.zeros(fits.shape, bool)
    if not len(some):
        return out
    tokens, places, times = np.unique(np.concatenate([shared[i] for i in some]), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(some)), lengths[some])
    several = times[places] > 1
    names, rows = (np.cumsum(times > 1) - 1)[places[several]], rows[several]
    overlap = np.zeros((len(some), len(some)), np.float32)
    width, n = min(4096, max(1, int((times > 1).sum()))), int((times > 1).sum())
    for at in range(0, n, width):
        here = (names >= at) & (names < at + width)
        member = np.zeros((len(some), width), np.float32)
        member[rows[here], names[here] - at] = 1
        overlap += member @ member.T
    here = np.ix_(some, some)
    out[here] = fits[here] & (overlap + np.minimum.outer(rest[some], rest[some]) >= need[here])
    return out


def _hopes(rows: DataFrame, lists: DataFrame, measure: Measure) -> DataFrame:
    """Edges (a, b) that connect the sets of each (token, block) that may be alike.  Rows: token, block, cid, component, apart."""

    def block(table: pa.Table) -> pa.Table:
        cids = table.column("cid").to_numpy()
        size, low, known, apart = (table.column(c).to_numpy() for c in ("n", "low", "component", "apart"))
        shared = [np.array(t, np.int64) for t in table.column("shared").to_pylist()]
        a, b = forest(hopeful(size.astype(np.int64), low.astype(np.int64), shared, known, apart.astype(bool), measure), cids)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.join(lists, "cid").groupBy("token", "block").applyInArrow(block, "a long, b long")


def _joined(rows: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """Links between the sets of each (token, block): a, b.  Rows: token, block, cid, component, apart."""

    def block(table: pa.Table) -> pa.Table:
        cids = table.column("cid").to_pylist()
        found = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        links = trie_join(found, measure, table.column("component").to_pylist(), table.column("apart").to_pylist()) if len(cids) > 1 else []
        return pa.table({"a": pa.array([cids[i] for i, _ in links], pa.int64()), "b": pa.array([cids[j] for _, j in links], pa.int64())})

    return rows.join(sets, "cid").groupBy("token", "block").applyInArrow(block, "a long, b long")


def _connected(rows: DataFrame, edges: Callable[[DataFrame], DataFrame], whole: DataFrame | None = None) -> DataFrame:
    """Edges that connect whatever ``edges`` finds between two classes under one token.  Rows: token, cid.

    ``whole``: tokens that one block holds, so the first round has settled them.
    """
    links = None
    for number in range(ROUNDS):
        found = edges(_first_round(_labelled(rows, links), number))
        links = cut(found if links is None else found.unionByName(links))
        if number == 0 and whole is not None:
            rows = cut(rows.join(whole, "token", "left_anti"))
            if rows.isEmpty():
                return links
    return cut(edges(_last_round(cut(_labelled(rows, links)))).unionByName(links))


def _labelled(prefix: DataFrame, links: DataFrame | None) -> DataFrame:
    """``prefix`` with the component of every class so far."""
    if links is None:
        return prefix.withColumn("component", F.col("cid"))
    labels = components(links).withColumnRenamed("vertex", "cid")
    return prefix.join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))


def _first_round(rows: DataFrame, number: int) -> DataFrame:
    """One set per token and component, each set under one token."""
    ones = rows.groupBy("token", "component").agg(F.min("cid").alias("cid"))
    mine = cut(ones.groupBy("cid", "component").agg(F.min_by("token", F.xxhash64("token", F.lit(number))).alias("token")))
    sizes = cut(mine.groupBy("token").agg(F.count("*").alias("size"), F.min("cid").alias("first"), F.max("cid").alias("last")).where("first <> last"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    return mine.join(sizes, "token").select(
        "token", "cid", "component", F.lit(False).alias("apart"), F.pmod(F.xxhash64("cid", F.lit(number)), blocks).cast("string").alias("block")
    )


def _last_round(rows: DataFrame) -> DataFrame:
    """All sets of the tokens that still have several components, one token per set of sets."""
    spread = rows.groupBy("token", "component").agg(
        F.count("*").alias("size"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("mark")
    )
    per_token = spread.groupBy("token").agg(
        F.count("*").alias("parts"), F.max("size").alias("most"), F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("mark").alias("mark"), F.sum("size").alias("size")
    ).where("parts > 1")
    tokens = cut(
        per_token.groupBy("mark", "size").agg(F.min_by(F.struct("token", "main", "most", "size"), "token").alias("one")).select("one.*")
    )
    met = rows.join(tokens, "token").select(
        "token",
        "cid",
        "component",
        (F.col("component") != F.col("main")).alias("outside"),
        "size",
        F.ceil(F.col("most") / BLOCK).cast("int").alias("inner"),
        F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("outer"),
    )
    spot = F.xxhash64("cid")
    own, home = F.pmod(spot, F.col("outer").cast("long")).cast("int"), F.pmod(spot, F.col("inner").cast("long")).cast("int")

    def to(first: Column, second: Column, mark: str) -> Column:
        return F.concat_ws(mark, first.cast("string"), second.cast("string"))

    others = F.sequence(F.lit(0), F.col("outer") - 1)
    with_main = F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda j: F.struct(to(own, j, "-").alias("block"), F.lit(True).alias("apart")))
    with_own = F.transform(others, lambda i: F.struct(to(F.least(own, i), F.greatest(own, i), "+").alias("block"), F.lit(False).alias("apart")))
    of_main = F.transform(others, lambda i: F.struct(to(i, home, "-").alias("block"), F.lit(False).alias("apart")))
    alone = F.array(F.struct(F.lit("all").alias("block"), F.lit(False).alias("apart")))
    parts = F.when(F.col("size") <= BLOCK, alone).when(F.col("outside"), F.concat(with_main, with_own)).otherwise(of_main)
    dealt = met.select("token", "cid", "component", F.explode(parts).alias("to"))
    return dealt.select("token", "cid", "component", "to.apart", "to.block")


def join(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, key (hash of identifier and text), n_shingles, group_id (null for empty sets), component_id of every row."""
    with temporary(docs.sparkSession) as keep:
        rows, of_class = _classes_in_components(_keyed(docs, doc, text), width, Measure(threshold), keep)
    return rows.join(of_class, "cid", "left").select(
        "doc_id",
        "key",
        F.col("n").cast("long").alias("n_shingles"),
        F.col("component").alias("group_id"),
        F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _classes_in_components(keyed: DataFrame, width: int, measure: Measure, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, cid of every row; cid, component, component_id of every class), kept tables."""
    rows = keep(cut(_profiles(keyed, width, measure)))
    profiles, rows = rows, rows.where("n IS NOT NULL")
    least = max(FREQUENT_LEAST, FREQUENT_SHARE * rows.count())
    often = profiles.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least)
    # the shares of all tokens sum up to the mean set size, so few can be this frequent
    frequent = np.sort(np.array([r["token"] for r in often.select("token").collect()], np.int64).view(np.uint64))
    classes = cut(
        rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.max("low").alias("low"), F.min("doc_id").alias("least"))
    )
    prefix, lists = _prefixes(_tokens(keyed, width, measure, frequent), classes, measure)
    counts = cut(prefix.groupBy("token").agg(F.min("cid").alias("first"), F.max("cid").alias("last")).where("first <> last").select("token"))
    prefix = cut(prefix.join(counts, "token", "left_semi"))
    hopes = _connected(prefix, lambda rows: _hopes(rows, lists, measure))
    clusters = components(hopes).select(F.col("component").alias("token"), F.col("vertex").alias("cid"))
    sets = cut(_sets(keyed, cut(classes.join(clusters.select("cid"), "cid", "left_semi").select("cid", "key")), width))
    sized = cut(clusters.groupBy("token").agg(F.count("*").alias("size")))
    loose = clusters.join(sized.where(F.col("size") > WHOLE_BLOCKS * BLOCK), "token", "left_semi").select("cid")
    whole = clusters.join(sized.where(F.col("size") <= WHOLE_BLOCKS * BLOCK), "token", "left_semi")
    groups = cut(whole.unionByName(prefix.join(loose, "cid", "left_semi").select("token", "cid")))
    small = sized.where(F.col("size") <= BLOCK).select("token")
    links = _connected(groups, lambda rows: _joined(rows, sets, measure), small)
    labels = components(links).withColumnRenamed("vertex", "cid")
    named = classes.join(labels, "cid", "left").select("cid", F.coalesce("component", "cid").alias("component"), "least")
    smallest = cut(named.groupBy("component").agg(F.min("least").alias("component_id")))
    return rows, keep(cut(named.join(smallest, "component").select("cid", "component", "component_id")))


def one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` without all but one text of each group, the one of the least identifier.

    Texts without words are in no group and all stay, but for repeated rows.
    """
    found = join(docs, doc, text, width, threshold)
    best = found.where("group_id IS NOT NULL").groupBy("group_id").agg(F.min(F.struct("doc_id", "key")).alias("best")).select("best.*")
    kept = cut(best.unionByName(found.where("group_id IS NULL").select("doc_id", "key")).select(F.col("doc_id").alias("id"), "key").distinct())
    # rows of equal identifier and text may differ in their other columns: the least of them stays
    others = F.to_json(F.struct(*(F.col(c) for c in docs.columns if c not in (doc, text)), F.lit(1).alias("_")))
    whole = docs.select(F.struct("*").alias("row"), others.alias("others"), F.col(doc).alias("id"), F.xxhash64(F.col(doc), F.col(text).cast("string")).alias("key"))
    same = (F.col("a.key") == F.col("b.key")) & F.col("a.id").eqNullSafe(F.col("b.id"))
    met = whole.alias("a").join(kept.alias("b"), same, "left_semi")
    return met.groupBy("key", "id").agg(F.min_by("row", "others").alias("row")).select("row.*")
