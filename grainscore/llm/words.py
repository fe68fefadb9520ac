"""Words of many texts at once as 64-bit hashes, in numpy.

A word is a run of bytes other than blank, tab, line end and their like
(0x20, 0x09-0x0D), which is what ``bytes.split()`` gives.  The hash is a
polynomial over random byte values modulo 2^64, read off running sums, and
mixed with the length at the end.  Sequences of words are hashed in the same
way from the hashes of their words.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

SLICE_BYTES = 1 << 18

_SPACE = re.compile(rb"[ \t-\r]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mix of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd base and of its inverse, modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        _powers[base] = tuple(both)
    up, down = _powers[base]
    return up[:n], down[:n]


def hashed_words(texts: Sequence[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets): words of text ``i`` are ``offsets[i]:offsets[i + 1]``.

    ``lower`` takes A-Z for a-z.  Long texts are hashed in slices that end between words.
    """
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    held: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        if held:
            hashes, places = _hash_slice(held, _LOWERED if lower else _VALUES)
            found.append(hashes)
            np.add.at(counts, np.array(owners)[places] + 1, 1)
            held.clear()
            owners.clear()

    for i, text in enumerate(texts):
        data = text.encode("utf-8", "replace") if text else b""
        at = 0
        while at < len(data):
            end = at + SLICE_BYTES
            if end < len(data):
                space = _SPACE.search(data, end)
                end = space.start() if space else len(data)
            held.append(data[at:end])
            owners.append(i)
            size += len(held[-1])
            at = end
            if size >= SLICE_BYTES:
                flush()
                size = 0
    flush()
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.cumsum(counts)


def _hash_slice(parts: list[bytes], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the parts, and the part each is in."""
    raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    space = _IS_SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers(BASES[0], len(raw))
    sums = np.cumsum(values[raw] * up, dtype=np.uint64)
    hashes = mix((sums[ends - 1] - sums[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])]) + 1
    return hashes, np.searchsorted(first, starts, "right") - 1


def sequences(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int, base: int = BASES[0]) -> np.ndarray:
    """Hash of the word sequences from ``starts``, each of ``lengths`` words."""
    up, down = powers(base, len(hashes) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)))
    return mix((sums[starts + lengths] - sums[starts]) * down[starts] + np.uint64(1) * np.asarray(lengths, np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
