"""Hashed character n-grams of many texts at once, in numpy.

Texts are lower-cased and encoded; every ASCII byte that is no letter counts
as a blank, and an n-gram may hold blanks at its ends only, so it lies in one
word with its boundaries.  Long texts are read in pieces of bounded size that
overlap by one n-gram less one byte, so whole texts are covered in bounded
memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

PIECE_BYTES = 1 << 20

BLANK = 32
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:128] = [b if 97 <= b <= 122 else BLANK for b in range(128)]


def pieces(texts: Sequence[str | None], overlap: int, size: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, text numbers): at most about ``size`` bytes, a blank before and after each text or part of one.

    The grams of text ``numbers[i]`` in the piece start at ``starts[i]`` up to the next start.
    """
    held, numbers, n = [], [], 1
    for number, text in enumerate(texts):
        data = (text or "").lower().encode("utf-8", "replace")
        for at in range(0, max(len(data), 1), size):
            part = data[max(0, at - overlap) : at + size]
            if held and n + len(part) > size:
                yield _joined(held, numbers)
                held, numbers, n = [], [], 1
            # a part that isn't the text's start or end must not look like a word's start or end
            held.append((part, at > 0, at + size < len(data)))
            numbers.append(number)
            n += len(part) + 1
    if held:
        yield _joined(held, numbers)


def _joined(held: list[tuple[bytes, bool, bool]], numbers: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" " + b" ".join(part for part, _, _ in held) + b" ", np.uint8)
    letters = _LETTERS[raw]
    starts = np.concatenate(([0], np.cumsum([len(part) + 1 for part, _, _ in held])[:-1])).astype(np.int64)
    for (part, before, after), start in zip(held, starts):
        if before:
            letters[start] = 0
        if after:
            letters[start + len(part) + 1] = 0
    return letters, starts, np.array(numbers)


def hashed(letters: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, buckets) of the valid n-grams; ``n`` is at most 8.  Byte 0 marks a cut and is in no gram."""
    count = len(letters) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank, cut = letters == BLANK, letters == 0
    valid = ~(blank[:count] & blank[1 : count + 1]) if n == 2 else ~blank[1 : count + 1]
    for k in range(2, n - 1):
        valid &= ~blank[k : count + k]
    if cut.any():
        for k in range(n):
            valid &= ~cut[k : count + k]
    places = np.flatnonzero(valid)
    code = np.zeros(count, np.uint64)
    for k in range(n):
        code |= letters[k : count + k].astype(np.uint64) << np.uint64(8 * k)
    code = code[places]
    code *= np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    code *= np.uint64((0xBF58476D1CE4E5B9 + 2 * n) & 0xFFFFFFFFFFFFFFFF)
    return places, (code >> np.uint64(64 - bits)).astype(np.int64)
