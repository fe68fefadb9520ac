"""URL filters: host and path rules, then a weighted vocabulary.

A rule names a host and a path start; it fits the host and its subdomains when
the path starts with the rule's, and the longest fitting rule decides.  Other
URLs are judged by words: an Aho-Corasick automaton finds all vocabulary terms
of the lower-cased URL in one pass, a hit counts when no ASCII letter or digit
touches it on either side, and one strict term or ``soft_limit`` distinct soft
terms block the URL.

Rules and vocabulary are parameters of the job, at most ``MAX_ENTRIES`` in
all; the automaton goes to the tasks with the function.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule and is judged by its words (null: none).  Ties between
rules of one length go to the longer host, then to block.  Repeated rows give
repeated results; an empty table gives none.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ENTRIES = 100_000

# Default vocabulary.
STRICT_TERMS = ["porn", "xxx", "hentai", "camgirls", "escorts", "warez", "keygen"]
SOFT_TERMS = ["sex", "adult", "nude", "casino", "betting", "poker", "viagra", "torrent", "crack", "hookup"]


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class Automaton:
    """Aho-Corasick over ``terms``: goto, failure and output links by state."""

    def __init__(self, terms: Sequence[str]):
        self.terms = list(dict.fromkeys(t for t in terms if t))
        self.step: list[dict[str, int]] = [{}]
        self.fail = [0]
        self.ends: list[tuple[int, ...]] = [()]
        for number, term in enumerate(self.terms):
            state = 0
            for letter in term:
                if letter not in self.step[state]:
                    self.step[state][letter] = len(self.step)
                    self.step.append({})
                    self.fail.append(0)
                    self.ends.append(())
                state = self.step[state][letter]
            self.ends[state] += (number,)
        queue = deque(self.step[0].values())
        while queue:
            state = queue.popleft()
            for letter, below in self.step[state].items():
                back = self.fail[state]
                while back and letter not in self.step[back]:
                    back = self.fail[back]
                target = self.step[back].get(letter, 0)
                self.fail[below] = target if target != below else 0
                self.ends[below] += self.ends[self.fail[below]]
                queue.append(below)

    def hits(self, text: str) -> Iterator[tuple[int, int]]:
        """(term number, end) of every occurrence."""
        state, step, fail, ends = 0, self.step, self.fail, self.ends
        for end, letter in enumerate(text, 1):
            while state and letter not in step[state]:
                state = fail[state]
            state = step[state].get(letter, 0)
            for number in ends[state]:
                yield number, end

    def distinct(self, text: str) -> set[int]:
        """Terms that occur with a boundary on both sides."""
        found = set()
        for number, end in self.hits(text):
            start = end - len(self.terms[number])
            if number not in found and not (start and _word(text[start - 1])) and not (end < len(text) and _word(text[end])):
                found.add(number)
        return found


def _word(letter: str) -> bool:
    return letter.isascii() and letter.isalnum()


_LOWER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-cased host and path, both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host.translate(_LOWER), tail[:cut]


def fitting(rules: dict[str, list[Rule]], host: str, path: str) -> Rule | None:
    """Longest rule for the host or one of its parents."""
    found, rest = [], host
    while rest:
        found += [r for r in rules.get(rest, ()) if path.startswith(r.path)]
        rest = rest.partition(".")[2]
    return max(found, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] = (),
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    soft_limit: int = 2,
    page: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft of every row."""
    if len(rules) + len(strict) + len(soft) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} rules and terms")
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)
    automaton = Automaton([*strict, *soft])
    is_strict = set(strict)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out: dict[str, list] = {n: [] for n in names}
            for address in batch.column(1).to_pylist():
                host, path = split_url(address)
                terms = [automaton.terms[i] for i in automaton.distinct((address or "").translate(_LOWER))]
                n_strict = sum(t in is_strict for t in terms)
                rule = fitting(by_host, host, path)
                blocked = n_strict > 0 or len(terms) - n_strict >= soft_limit
                row = (host, path, rule and rule.text, rule.verdict if rule else ("block" if blocked else "allow"), n_strict, len(terms) - n_strict)
                for name, value in zip(names, row):
                    out[name].append(value)
            arrays = [pa.array(out[n], pa.int64() if n.startswith("n_") else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["page_id", *names])

    names = ["host", "path", "rule", "verdict", "n_strict", "n_soft"]
    read = pages.select(F.col(page).alias("page_id"), F.col(url).cast("string").alias("url"))
    schema = T.StructType([read.schema["page_id"], *(T.StructField(n, T.LongType() if n.startswith("n_") else T.StringType()) for n in names)])
    return read.mapInArrow(batches, schema)
