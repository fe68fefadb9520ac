"""Text and list expressions with Python's semantics, as Spark SQL text.

Expressions are composed as text and reach the JVM once per projection; built
from thousands of Column calls the same plan takes many seconds to set up.
Arguments are SQL expressions, results are SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from grainscore.functions.patterns import WHITESPACE, literal

# str.splitlines() boundaries; one set of single characters first, which is one test per position
LINE_BREAK = literal(r"[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}](?:(?<=\r)\n)?")
_WHITESPACE = literal(WHITESPACE)
_REPLACEMENT = literal(chr(0xFFFD))

EMPTY = "CAST(array() AS array<string>)"


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add computed columns that everything downstream uses as values.

    Written as a one-element ``inline``.  With a plain projection the optimizer
    would copy these large expressions into every filter set on them, running
    them twice, and would carry each of them along as a constraint, which makes
    planning slow.  Filters on other columns still pass to the scan.
    """
    return df.selectExpr("*", f"inline(array({row(columns)}))")


def derive_from(df: DataFrame, value: str, name: str, columns: dict[str, str]) -> DataFrame:
    """``derive`` columns that share ``value``, evaluated once and called ``name`` in them."""
    return df.selectExpr("*", f"inline(transform(array({value}), {name} -> {row(columns)}))")


def row(columns: dict[str, str]) -> str:
    """struct of named expressions."""
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in columns.items()) + ")"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``.

    A plain column reference inside a lambda can be replaced by its defining
    expression during optimization and then run once per element; a lambda
    variable stays at one evaluation per row.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def strings(*items: str) -> str:
    """array<string> of the given expressions."""
    return f"array({', '.join(items)})" if items else EMPTY


def listed(condition: str, items: str) -> str:
    """``items`` when the condition holds, otherwise an empty list."""
    return f"CASE WHEN {condition} THEN {items} ELSE {EMPTY} END"


def joined(label: str, items: str) -> str:
    """List with the one string ``label`` followed by the comma-separated items."""
    return strings(f"concat({literal(label)}, array_join({items}, ', '))")


def strip(text: str) -> str:
    return f"trim(BOTH {_WHITESPACE} FROM {text})"


def strip_end(text: str) -> str:
    return f"trim(TRAILING {_WHITESPACE} FROM {text})"


def last_stripped(text: str, n: int) -> str:
    """Last ``n`` characters of ``strip_end(text)``, for which the end of a long text is enough unless it is mostly white space."""
    near = n + 16
    short = f"CASE WHEN length(s) >= {n} OR length(t) <= {near} THEN right(s, {n}) ELSE right({strip_end('t')}, {n}) END"
    return let(text, "t", let(strip_end(f"right(t, {near})"), "s", short))


def ends_before(text: str, mark: str, words: list[str]) -> str:
    """array<string>: what stands before each ``mark`` (a character, escaped if need be) and white space, where it ends with a word."""
    ends = f"transform(slice(pieces, 1, size(pieces) - 1), p -> {last_stripped('p', max(map(len, words)))})"
    return let(f"split({text}, {literal(mark)}, -1)", "pieces", f"filter({ends}, e -> {ends_with_any('e', words)})")


def ends_with_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"endswith({text}, {literal(w)})" for w in words) + ")"


def is_blank(text: str) -> str:
    """True for text of white space only; stops at the first other character."""
    return f"(trim(LEADING {_WHITESPACE} FROM {text}) = '')"


def unify_newlines(text: str) -> str:
    both = rf"replace(replace(t, '\r\n', '\n'), '\r', '\n')"
    return let(text, "t", rf"CASE WHEN contains(t, '\r') THEN {both} ELSE t END")


def decode_utf8(raw: str) -> str:
    """Decode bytes as UTF-8 and drop invalid sequences.

    ``make_valid_utf8`` marks invalid bytes with U+FFFD.  Genuine U+FFFD
    characters are escaped around the call so that only the marks are removed.
    """
    esc = literal("\x01")
    escaped = f"replace(replace(t, {esc}, concat({esc}, 'a')), {_REPLACEMENT}, concat({esc}, 'b'))"
    cleaned = f"replace(make_valid_utf8({escaped}), {_REPLACEMENT}, '')"
    restored = f"replace(replace({cleaned}, concat({esc}, 'b'), {_REPLACEMENT}), concat({esc}, 'a'), {esc})"
    return let(f"CAST({raw} AS STRING)", "t", f"CASE WHEN is_valid_utf8(t) THEN t ELSE {restored} END")


def split_lines(text: str) -> str:
    """str.splitlines(): no element for the end of a final terminated line."""
    trimmed = "CASE WHEN element_at(parts, -1) = '' THEN slice(parts, 1, size(parts) - 1) ELSE parts END"
    return let(f"split({text}, {LINE_BREAK}, -1)", "parts", trimmed)


def stripped_lines(text: str) -> str:
    return f"transform({split_lines(text)}, l -> {strip('l')})"


def replaced(text: str, old: str, new: str) -> str:
    """``replace`` of a literal that most texts do not hold; testing for it first is the cheaper search."""
    return let(text, "t", f"CASE WHEN contains(t, {literal(old)}) THEN replace(t, {literal(old)}, {literal(new)}) ELSE t END")


def fold_case(text: str) -> str:
    """Lower-cased text in which every character that case-insensitively equals
    an ASCII letter is that letter (dotted/dotless i, long s; lower() folds the
    Kelvin sign), so substring tests on it never miss a case-insensitive match."""
    for source, target in ((0x130, "i"), (0x131, "i"), (0x17F, "s")):
        text = replaced(text, chr(source), target)
    return f"lower({text})"


# The measure that all detectors with rules on case-folded text share.
FOLDED = {"text_folded": fold_case("text")}

# Letters from the rarest to the most frequent; all other characters count as rarer.
_FREQUENT = "qjxzkvbpgwyfmucldhrsinoate"


def contains_word(text: str, word: str) -> str:
    """``contains``, which tries every place that has the first byte looked for.

    So the rest of the word from its rarest character on is looked for first,
    which the word implies, and the word itself only where that is there.
    """
    start = min(range(max(1, len(word) - 2)), key=lambda k: _FREQUENT.find(word[k]))
    whole = f"contains({text}, {literal(word)})"
    return f"(contains({text}, {literal(word[start:])}) AND {whole})" if start else whole


def contains_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(contains_word(text, w) for w in words) + ")"


def percent(ratio: str) -> str:
    """``ratio`` as a percentage with one decimal, rounding the exact binary value half-even.

    ``ratio * 100 * 2**47`` is an integer for every double of at least 1, so
    integer arithmetic decides the rounding exactly.
    """
    unit = f"{1 << 47}L"
    quotient = (
        f"p.q + CASE WHEN p.r * 2 > {unit} OR (p.r * 2 = {unit} AND p.q % 2 = 1) THEN 1 ELSE 0 END"
    )
    scaled = f"CAST(r * 100.0D * {float(1 << 47)!r}D AS BIGINT) * 10"
    tenths = let(let(scaled, "s", f"named_struct('q', s div {unit}, 'r', s % {unit})"), "p", quotient)
    exact = let(tenths, "t", "concat(t div 10, '.', t % 10, '%')")
    return let(ratio, "r", f"CASE WHEN r < 65.0D THEN {exact} ELSE format_string('%.1f%%', r * 100.0D) END")


def three_places(value: str) -> str:
    """Round a score to three places as Python does: on the exact binary value, ties to even.

    For doubles in [2**-10, 1], ``value * 2**62`` is an integer, so decimal
    integer arithmetic decides exactly; smaller ones round to 0 or 0.001.  Away
    from ties, by more than the error of one product, the product decides.
    """
    unit = f"CAST({1 << 62} AS DECIMAL(20, 0))"
    scaled = f"CAST(CAST(v * {float(1 << 62)!r}D AS BIGINT) AS DECIMAL(20, 0)) * 1000"
    parts = let(scaled, "s", f"named_struct('q', s div {unit}, 'r2', s % {unit} * 2)")
    nearest = let(
        parts, "p", f"p.q + CASE WHEN p.r2 > {unit} OR (p.r2 = {unit} AND p.q % 2 = 1) THEN 1 ELSE 0 END"
    )
    return let(
        value,
        "v",
        f"CASE WHEN v < {2.0**-10!r}D THEN CASE WHEN v >= 0.0005D THEN 0.001D ELSE 0.0D END "
        "WHEN v = 1.0D THEN 1.0D "
        "WHEN v < 1.0D AND abs(v * 1000.0D - floor(v * 1000.0D) - 0.5D) > 1e-9D THEN rint(v * 1000.0D) / 1000.0D "
        f"ELSE {nearest} / 1000.0D END",
    )


def group_in_order(entries: str, least: int) -> str:
    """Group ``array<struct<key, pos, value>>`` by key inside the row.

    Returns ``array<struct<pos, values>>``, one element per key with at least
    ``least`` members, in order of first position; members keep their order.
    Sort plus run boundaries keeps the cost at O(n log n) per row.
    """
    starts = "filter(transform(es, (e, i) -> CASE WHEN e.key <=> get(es, i - 1).key THEN NULL ELSE i + 1 END), i -> i IS NOT NULL)"
    runs = let(
        starts, "ss", "transform(ss, (b, k) -> slice(es, b, coalesce(get(ss, k + 1), size(es) + 1) - b))"
    )
    groups = f"filter({let(f'sort_array({entries})', 'es', runs)}, g -> size(g) >= {least})"
    return f"sort_array(transform({groups}, g -> named_struct('pos', g[0].pos, 'values', transform(g, e -> e.value))))"
