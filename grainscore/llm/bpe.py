"""BPE encoding and decoding from a public vocabulary file.

A text is cut at special tokens, normalized (NFC, white space to one blank,
lower case letter by letter), split into words, spelled in byte letters and
merged: the adjacent pairs of a word wait in a priority queue by merge rank,
over a doubly linked list of symbols; an entry whose symbols have changed
since is stale and is skipped.  Decoding looks every id up in the vocabulary
and joins the strings by blanks, which is what a file without a decoder asks
for.

The file is a parameter; the driver reads it once and its tables (one
vocabulary, some MB at most) go to the tasks as a broadcast.  Words repeat, so
each task keeps the ids of recent words in a table of bounded size.

Defined results: a null or empty text has no tokens and decodes to the empty
text; repeated rows give repeated results; ties of rank go to the left pair;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHED_WORDS = 200_000
SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# white space to str.split() alone
SEPARATOR = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def vocabulary() -> str:
    """Place of the production vocabulary among the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str) -> dict:
    """What the coder needs from a tokenizer file: vocabulary, merges, special tokens, word pattern, word end."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, (split, _) = data["model"], data["pre_tokenizer"]["pretokenizers"]
    return {
        "path": path,
        "vocab": model["vocab"],
        "merges": [tuple(m) for m in model["merges"]],
        "end": model["end_of_word_suffix"] or "",
        "special": {t["content"]: t["id"] for t in data["added_tokens"]},
        "pattern": split["pattern"]["Regex"],
    }


class Recent(dict):
    """What ``make`` gives for recent keys: at most two generations of ``CACHED_WORDS``."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key):
        found = self.older.get(key) or self.make(key)
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class Coder:
    def __init__(self, tables: dict):
        vocab: dict[str, int] = tables["vocab"]
        self.end = tables["end"]
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in tables["special"].items()}
        # one integer for a pair, and one for its rank and what it becomes: ids stay below 2^20
        self.ranks = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(tables["merges"])}
        self.special: dict[str, int] = tables["special"]
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(tables["pattern"])
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + self.end] for x in letters]
        self.shown = {i: str(i) for i in self.strings}
        self.known = Recent(self.run)

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        ranks, inner, spelled = self.ranks, self.inner, word.encode()
        symbols = [inner[b] for b in spelled]
        symbols[-1] = self.last[spelled[-1]]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # an entry: rank and merged id, then the place of the left symbol; ranks never equal but for equal pairs
        queue = [(r, i) for i in range(n - 1) if (r := ranks.get(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry, left = heapq.heappop(queue)
            right = after[left]
            if symbols[left] < 0 or right < 0 or ranks.get(symbols[left] << 20 | symbols[right]) != entry:
                continue  # stale
            symbols[left], symbols[right] = entry & 0xFFFFF, -1
            following = after[left] = after[right]
            if following >= 0:
                before[following] = left
                if (r := ranks.get(symbols[left] << 20 | symbols[following])) is not None:
                    heapq.heappush(queue, (r, left))
            previous = before[left]
            if previous >= 0 and (r := ranks.get(symbols[previous] << 20 | symbols[left])) is not None:
                heapq.heappush(queue, (r, previous))
        return [s for s in symbols if s >= 0]

    def run(self, run: str) -> tuple[int, str, str]:
        """Number of ids, the ids and the strings of a run of letters without white space."""
        if run.isalpha():
            ids = self.merge(run)
        elif run[:-1].isalpha() and run[-1] in ".,":
            ids = [*self.merge(run[:-1]), self.last[ord(run[-1])]]
        else:
            ids = [i for word in self.words.findall(run) for i in self.merge(word)]
        shown = self.shown
        return len(ids), " ".join([shown[i] for i in ids]), self.decode(ids)

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        found = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                found.append((1, str(self.special[part]), part))
                continue
            if not part.isascii():
                # lower() sees the letters around a sigma, the normalizer doesn't
                part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")
            part = part.lower()
            found += map(self.known.__getitem__, SPACE.split(part) if SEPARATOR.search(part) else part.split())
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.pieces(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])

    def coded(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, ids joined by blanks, decoded text."""
        found = [p for p in self.pieces(text or "") if p[0]]
        return sum([p[0] for p in found]), " ".join([p[1] for p in found]), " ".join([p[2] for p in found])


_CODERS: dict[str, Coder] = {}


def coder_for(tables: dict) -> Coder:
    """The coder of this process for these tables, with the words it has met before."""
    if tables["path"] not in _CODERS:
        _CODERS.clear()
        _CODERS[tables["path"]] = Coder(tables)
    return _CODERS[tables["path"]]


def encode(docs: DataFrame, path: str, digests: bool = False, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, then ids (array) and decoded, or the SHA-256 of both when ``digests``."""
    tables = docs.sparkSession.sparkContext.broadcast(load(path))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(tables.value)
        for batch in stream:
            for part in range(0, batch.num_rows, 64):
                piece = batch.slice(part, 64)
                rows = [coder.coded(t) for t in piece.column(1).to_pylist()]
                if digests:
                    last = [pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows], pa.string()) for k in (1, 2)]
                else:
                    last = [pa.array([list(map(int, r[1].split())) for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([r[0] for r in rows], pa.int64()), *last], names=names)

    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    read = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = [T.StringType(), T.StringType()] if digests else [T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([read.schema["doc_id"], *map(T.StructField, names[1:], [T.LongType(), *kinds])])
    return read.mapInArrow(batches, schema)
