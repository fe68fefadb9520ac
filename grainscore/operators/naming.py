"""Generic naming: names from the syntax facts, or text patterns where there are none."""

from __future__ import annotations

from grainscore import fixed_values as fixed
from grainscore.functions import text as tx
from grainscore.functions.patterns import java, literal


def _among(name: str, words: list[str]) -> str:
    return f"{name} IN ({', '.join(map(literal, words))})"


def is_generic_variable(name: str) -> str:
    return _among(f"lower({name})", fixed.GENERIC_VARIABLE_NAMES)


def is_generic_function(name: str) -> str:
    return _among(f"lower({name})", fixed.GENERIC_FUNCTION_NAMES)


def is_single_letter(name: str) -> str:
    return f"length({name}) = 1 AND NOT {_among(name, fixed.ACCEPTED_SINGLE_LETTERS)}"


def _assigned(text: str) -> str:
    """SQL: the words before an equals sign that the first text pattern matches.

    A match ends with its equals sign, so the text is cut there and only the end
    of each piece is looked at.
    """
    words = fixed.TEXT_NAMING_PATTERNS[0][0].removeprefix(r"\b").removesuffix(r"\s*=")
    longest = max(map(len, words.strip("()").split("|")))
    end = tx.last_stripped("piece", longest + 1)
    tested = literal(java(rf"(?:^|[^\w]){words}\z", True))
    pieces = tx.let(f"split({text}, '=', -1)", "pieces", "slice(pieces, 1, size(pieces) - 1)")
    return f"filter(transform({pieces}, piece -> regexp_extract({end}, {tested}, 1)), w -> w <> '')"


def _named(text: str, folded: str, pattern: str) -> str:
    """SQL: names that one of the other text patterns matches, which only run on texts with its first word and one of the names."""
    names = pattern[pattern.index("(") + 1 : pattern.index(")")].lower().split("|")
    found = f"regexp_extract_all({text}, {literal(java(pattern, True))}, 1)"
    none = f"CASE WHEN {text} IS NOT NULL THEN {tx.EMPTY} END"
    first = tx.contains_word(folded, pattern[: pattern.index("\\")])
    return f"CASE WHEN {first} AND {tx.contains_any(folded, names)} THEN {found} ELSE {none} END"


def text_matches(text: str, folded: str | None = None) -> list[str]:
    """Matched words per pattern family, in text order; ``folded`` is the case-folded text if there is one."""
    others = [p for p, _ in fixed.TEXT_NAMING_PATTERNS[1:]]
    if folded is None:
        return [_assigned(text), *(tx.let(tx.fold_case(text), "folded", _named(text, "folded", p)) for p in others)]
    return [_assigned(text), *(_named(text, folded, p) for p in others)]


# Names come from the facts for Python files that parse.
_BY_NAMES = "(parse_status = 'ok' AND (is_py_ext OR is_py))"
_FAMILIES = range(len(fixed.TEXT_NAMING_PATTERNS))

MEASURES = [
    {
        **tx.FOLDED,
        "nam_by_names": _BY_NAMES,
        "nam_variables": f"CASE WHEN {_BY_NAMES} THEN array_distinct(transform(names, n -> n.name)) END",
        "nam_functions": f"CASE WHEN {_BY_NAMES} THEN transform(functions, f -> f.name) END",
    },
    {
        **{
            f"nam_words_{k}": f"CASE WHEN NOT nam_by_names THEN slice({words}, 1, 5) END"
            for k, words in enumerate(text_matches("text", "text_folded"))
        },
        "nam_generic_variables": f"filter(nam_variables, n -> {is_generic_variable('n')})",
        "nam_generic_functions": f"filter(nam_functions, n -> {is_generic_function('n')})",
        "nam_single_letters": f"filter(nam_variables, n -> {is_single_letter('n')})",
        "nam_total": "size(nam_variables) + size(array_distinct(nam_functions))",
    },
]

_HITS = " + ".join(f"CASE WHEN size(nam_words_{k}) > 0 THEN 1 ELSE 0 END" for k in _FAMILIES)

SCORE = (
    f"CASE WHEN NOT nam_by_names THEN least(1.0D, ({_HITS}) * 0.1D) WHEN nam_total = 0 THEN 0.0D ELSE "
    "least(1.0D, (size(nam_generic_variables) + size(nam_generic_functions)) / nam_total * 0.8D "
    "+ least(0.2D, size(nam_single_letters) * 0.03D)) END"
)

_FROM_NAMES = [
    tx.listed(
        "size(nam_generic_variables) > 0",
        tx.joined("Generic variable names: ", "slice(nam_generic_variables, 1, 10)"),
    ),
    tx.listed("size(nam_generic_functions) > 0", tx.joined("Generic function names: ", "nam_generic_functions")),
    tx.listed(
        "size(nam_single_letters) > 3",
        tx.joined("Many single-letter variable names: ", "sort_array(nam_single_letters)"),
    ),
]
_FROM_TEXT = [
    tx.listed(
        f"size(nam_words_{k}) > 0", tx.joined(f"Found {label}: ", f"sort_array(array_distinct(nam_words_{k}))")
    )
    for k, (_, label) in enumerate(fixed.TEXT_NAMING_PATTERNS)
]

FINDINGS = f"CASE WHEN nam_by_names THEN concat({', '.join(_FROM_NAMES)}) ELSE concat({', '.join(_FROM_TEXT)}) END"
