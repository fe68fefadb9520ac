"""Line dedup over content-defined chunks of lines.

A rule decides from the lines alone where a text is cut, so a passage is cut
alike wherever it stands; what lies between two cuts is a chunk.  Boundaries of
one rule miss passages that end within a chunk, so several rules are used and
the union of their chunks of two or more lines:

* a rolling sum over the hashes of the last ``ROLL`` lines vanishes
  (``boundaries``), for chunks of several lines;
* under each of ``OWN_RULES`` bits of a line's own hash, a line is cut off from
  the line before it, or from the line after it.  Two neighboring lines are a
  chunk of one rule in four whatever is around them, so the share of pairs that
  no rule has is 0.75 to the power of ``OWN_RULES``, about one in 10^8;
* the same under ``GAP_RULES`` more bits, with no cut at several blank lines in
  a row, so that these go with the lines around them;
* in a run of equal lines, after every second line, from the first or from the
  second one.

The lines of every occurrence of a chunk but the first, in the order of
``doc_id`` and place, are removed.  So each removed line stands in an earlier
place that keeps it; a first occurrence loses a line only to another chunk, or
to itself where it overlaps, that began before; and a line without a repeated
neighbor stays, even if it stands twice.

Occurrences are first counted by chunk hash, on rows of a few bytes; only
chunks whose hash repeats are compared, and they are grouped by hash and by
their bytes, so chunks that merely collide stay apart.  The grouping sums up
before its exchange, so a passage in a third of all documents costs one row
per task.

Defined results: a null text stays null and has no lines, an empty one has one
empty line; chunks of blank lines alone are never removed; of equal documents
of several lines, not all blank, the first loses no more than it would alone and
the others lose every line; repeated rows of one id and text count as one
document; null ids come before others; lines end with ``\\n``, and a text whose
last lines go loses the line end before them too; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainscore.llm.shared import cut, temporary

ROLL = 2
LEAST = 2
MOST = 16
MASK = 3
OWN_RULES = 64
GAP_RULES = 48
SALTS = 64
ROWS = 1 << 16
_RATE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def boundaries(hashes: list[int]) -> list[int]:
    """Ends of the chunks over a list of line hashes; a rest of one line joins the chunk before it."""
    ends, start, rolling = [], 0, 0
    power = pow(_RATE, ROLL, 1 << 64)
    for at, value in enumerate(hashes, 1):
        rolling = (rolling * _RATE + value) & _ALL
        if at > ROLL:
            rolling = (rolling - hashes[at - ROLL - 1] * power) & _ALL
        size = at - start
        if size >= MOST or size >= LEAST and not (rolling >> 40) & MASK:
            ends.append(at)
            start = at
    if start < len(hashes):
        if len(hashes) - start < LEAST and ends:
            ends[-1] = len(hashes)
        else:
            ends.append(len(hashes))
    return ends


def _digests(part: str) -> tuple[int, int]:
    """Two signed 64-bit hashes."""
    data = part.encode("utf-8", "replace")
    return tuple(h - (1 << 64) if h >> 63 else h for h in (xxhash.xxh64_intdigest(data, seed=1), xxhash.xxh64_intdigest(data, seed=2)))


def _cuts(lines: list[str], filled: list[bool], hashes: list[int]) -> list[int]:
    """For every place between two lines the rules that cut there, as bits."""
    n = len(lines)
    both, own, turns = (1 << OWN_RULES + GAP_RULES) - 1, (1 << OWN_RULES) - 1, OWN_RULES + GAP_RULES
    places, run = [], 0
    for at in range(n - 1):
        here, there = (own if not filled[k] and (k > 0 and not filled[k - 1] or k + 1 < n and not filled[k + 1]) else both for k in (at, at + 1))
        # a set bit cuts after the line, a clear one before it
        cuts = hashes[at] & here | ~hashes[at + 1] & there
        run = run + 1 if hashes[at] == hashes[at + 1] else 0
        places.append(cuts | (1 << run % 2 if run else 3) << turns)
    rolling = 1 << turns + 2
    for end in boundaries([h & _ALL for h in hashes])[:-1]:
        places[end - 1] |= rolling
    return places


def spans(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, end) of the chunks of two or more lines, not all blank, that any rule cuts a text into."""
    n = len(lines)
    if n < 2:
        return []
    filled = [bool(x.strip()) for x in lines]
    places = _cuts(lines, filled, [xxhash.xxh3_128_intdigest(x.encode("utf-8", "replace")) for x in lines])
    every = (1 << OWN_RULES + GAP_RULES + 3) - 1
    before, out = every, []
    for start in range(n - 1):
        # the rules under which a chunk begins here and has not ended
        live, end, some = before & ~places[start], start + 1, filled[start]
        before = places[start]
        while live:
            some = some or filled[end]
            end += 1
            cut = every if end == n else places[end - 1]
            if some and live & cut:
                out.append((start, end))
            live &= ~cut
    return out


def _occurrences(keyed: DataFrame) -> DataFrame:
    """Chunks of several lines: k1, k2, doc_id, place (the number of the chunk in its text), d1, d2."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            owners, places, digests = [], [], []

            def rows() -> pa.RecordBatch:
                arrays = [batch.column(k).take(pa.array(owners, pa.int64())) for k in range(3)]
                arrays += [pa.array(places, pa.int32()), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1))]
                return pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "doc_id", "place", "d1", "d2"])

            for owner in range(batch.num_rows):
                text = batch.column(3)[owner].as_py()
                if text is None:
                    continue
                lines = text.split("\n")
                for place, (start, end) in enumerate(spans(lines)):
                    owners.append(owner)
                    places.append(place)
                    digests.append(_digests("\n".join(lines[start:end])))
                    if len(owners) >= ROWS:
                        yield rows()
                        owners, places, digests = [], [], []
            yield rows()

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.select("k1", "k2", "doc_id", "text").mapInArrow(batches, f"k1 long, k2 long, doc_id {kind}, place int, d1 long, d2 long")


def _candidates(joined: DataFrame) -> DataFrame:
    """Bytes of the chunks at ``places``: d1, d2, chunk."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts, places = batch.column("text"), batch.column("places")
            for at in range(0, batch.num_rows, 256):
                found = []
                for text, wanted in zip(texts.slice(at, 256).to_pylist(), places.slice(at, 256).to_pylist()):
                    if wanted:
                        wanted, lines = set(wanted), text.split("\n")
                        found += ["\n".join(lines[start:end]) for place, (start, end) in enumerate(spans(lines)) if place in wanted]
                digests = [_digests(c) for c in found]
                arrays = [pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(found, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["d1", "d2", "chunk"])

    return joined.mapInArrow(batches, "d1 long, d2 long, chunk string")


def _kept(joined: DataFrame, schema: str) -> DataFrame:
    """Texts without the lines of the chunks at ``places``: doc_id, text, n_lines, n_removed, carried."""

    def cut_text(text: str | None, wanted: list[int] | None) -> tuple[str | None, int, int]:
        if text is None:
            return None, 0, 0
        if not wanted:
            return text, text.count("\n") + 1, 0
        wanted, lines = set(wanted), text.split("\n")
        gone = {k for place, span in enumerate(spans(lines)) if place in wanted for k in range(*span)}
        return "\n".join([x for k, x in enumerate(lines) if k not in gone]), len(lines), len(gone)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [cut_text(t, w) for t, w in zip(part.column("text").to_pylist(), part.column("places").to_pylist())]
                arrays = [part.column("doc_id"), pa.array([r[0] for r in rows], pa.string())]
                arrays += [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*arrays, part.column("carried")], names=["doc_id", "text", "n_lines", "n_removed", "carried"])

    return joined.mapInArrow(batches, schema)


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text (what is kept), n_lines, n_removed, carried (a struct of the columns ``carry``) of every row."""
    body = F.col(text).cast("string")
    keyed = docs.select(
        F.xxhash64(F.col(doc), body, F.lit(1)).alias("k1"),
        F.xxhash64(F.lit(2), body, F.col(doc)).alias("k2"),
        F.col(doc).alias("doc_id"),
        body.alias("text"),
        F.struct(*(F.col(c) for c in carry), F.lit(None).cast("boolean").alias("_")).alias("carried"),
    )
    first = F.min(F.struct("doc_id", "k1", "k2", "place")).alias("first")
    with temporary(docs.sparkSession) as keep:
        found = cut(_occurrences(keyed))
        # read back, so that Spark can split a digest that many chunks share in the join below
        digests = cut(found.groupBy("d1", "d2").agg(F.count("*").alias("n"), first).where("n > 1").drop("n"))
        repeated = keep(cut(found.join(digests, ["d1", "d2"])))

    def with_places(rows: DataFrame) -> DataFrame:
        # both uses exchange the same columns of the texts by the same keys, so Spark moves the texts once;
        # without the hint it would broadcast the places while they are few, and sort only beyond that
        return keyed.join(rows.groupBy("k1", "k2").agg(F.collect_set("place").alias("places")).hint("merge"), ["k1", "k2"], "left")

    compared = _candidates(with_places(repeated)).groupBy("d1", "d2", "chunk").agg(F.count("*").alias("n"))
    # two equal hashes and yet other bytes: such chunks all stay
    unequal = compared.groupBy("d1", "d2").agg(F.count("*").alias("texts")).where("texts > 1").select("d1", "d2")
    # nearly always there are none, and a passage in a third of all texts is spread over SALTS tasks all the same
    here, salts = F.struct("doc_id", "k1", "k2", "place"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    later = repeated.where(~here.eqNullSafe(F.col("first"))).withColumn("salt", F.pmod("k1", F.lit(SALTS)))
    removed = later.join(unequal.select("d1", "d2", salts.alias("salt")), ["d1", "d2", "salt"], "left_anti")
    kind = keyed.schema["doc_id"].dataType.simpleString()
    carried = keyed.schema["carried"].dataType.simpleString()
    return _kept(with_places(removed), f"doc_id {kind}, text string, n_lines long, n_removed long, carried {carried}")
