"""Share of documentation: docstrings and comments against all non-blank lines."""

from __future__ import annotations

from grainscore import fixed_values as fixed
from grainscore.functions import text as tx
from grainscore.functions.patterns import any_of, literal, matches
from grainscore.operators import lines as ln

_DOUBLE, _SINGLE = literal('"""'), literal("'''")


def code_line_count(lines: str) -> str:
    """Lines that are neither blank, nor ``#`` comments, nor in a triple-quoted string.

    State: the delimiter of the string being skipped and the lines counted.  A
    line with one delimiter opens a string; a line that opens and closes one is
    not code.
    """
    removed = lambda quote: f"length(l) - length(replace(l, {quote}, ''))"  # three per delimiter
    opened = (
        f"CASE WHEN contains(l, {_DOUBLE}) THEN CASE WHEN {removed(_DOUBLE)} = 3 THEN {_DOUBLE} ELSE '' END "
        f"WHEN {removed(_SINGLE)} = 3 THEN {_SINGLE} ELSE '' END"
    )
    plain = f"CASE WHEN contains(l, {_DOUBLE}) OR contains(l, {_SINGLE}) THEN 0 ELSE 1 END"
    state = lambda quote, n: f"named_struct('quote', {quote}, 'n', {n})"
    closed = "CASE WHEN contains(l, st.quote) THEN '' ELSE st.quote END"
    step = (
        "CASE WHEN l = '' OR startswith(l, '#') THEN st "
        f"WHEN st.quote = '' THEN {state(opened, f'st.n + {plain}')} "
        f"ELSE {state(closed, 'st.n')} END"
    )
    return f"aggregate({lines}, {state(literal(''), '0')}, (st, l) -> {step}, st -> st.n)"


def is_boilerplate(docstring: str) -> str:
    return matches(f"lower({docstring})", any_of(fixed.BOILERPLATE_DOCSTRING_PATTERNS))


_PARSED = "is_py AND parse_status = 'ok'"
_DOCS = "docstrings"
_LONG = "filter(functions, f -> f.has_docstring AND f.doc_lines > (f.n_body - 1) * 2 AND f.doc_lines > 3)"

MEASURES = [
    {
        "rat_mode": f"CASE WHEN NOT is_py THEN 'text' WHEN {_PARSED} THEN 'docs' END",
        "rat_comments": ln.hash_start_count("hash_lines"),
        "rat_nonblank": ln.nonblank_count("lines"),
        "rat_doc_lines": f"CASE WHEN {_PARSED} THEN aggregate({_DOCS}, 0, (n, d) -> n + d.n_lines) END",
        "rat_docstrings": f"CASE WHEN {_PARSED} THEN size({_DOCS}) END",
        "rat_boilerplate": f"CASE WHEN {_PARSED} THEN size(filter({_DOCS}, d -> {is_boilerplate('d.text')})) END",
        "rat_long_docs": f"CASE WHEN {_PARSED} THEN size({_LONG}) END",
    }
]

_DOC_RATIO = "((rat_doc_lines + rat_comments) / rat_nonblank)"
_COMMENT_RATIO = "(rat_comments / rat_nonblank)"

SCORE = (
    f"CASE WHEN rat_mode = 'text' THEN least(1.0D, greatest(0.0D, ({_COMMENT_RATIO} - 0.3D) * 1.5D)) "
    f"WHEN rat_mode = 'docs' THEN least(1.0D, greatest(0.0D, ({_DOC_RATIO} - 0.3D) * 1.2D) "
    "+ least(0.3D, rat_boilerplate * 0.08D) + least(0.2D, rat_long_docs * 0.07D)) ELSE 0.0D END"
)

_DOCUMENTED = (
    "concat("
    + ", ".join(
        [
            tx.listed(
                f"{_DOC_RATIO} > 0.4D",
                f"array(concat(CASE WHEN {_DOC_RATIO} > 0.6D THEN 'Extremely high' ELSE 'High' END, "
                f"' documentation ratio: ', {tx.percent(_DOC_RATIO)}, "
                "format_string(' (%d doc/comment lines vs %d code lines)', "
                f"rat_doc_lines + rat_comments, {code_line_count('lines')})))",
            ),
            tx.listed(
                "rat_boilerplate > 0",
                "array(format_string('Boilerplate/filler docstrings detected: %d out of %d total docstrings', "
                "rat_boilerplate, rat_docstrings))",
            ),
            tx.listed(
                "rat_long_docs > 0",
                "array(format_string('Functions where docstring is longer than body: %d', rat_long_docs))",
            ),
        ]
    )
    + ")"
)
_COMMENTED = tx.listed(
    f"{_COMMENT_RATIO} > 0.5D",
    f"array(concat('High comment ratio in non-Python file: ', {tx.percent(_COMMENT_RATIO)}))",
)

FINDINGS = f"CASE WHEN rat_mode = 'text' THEN {_COMMENTED} WHEN rat_mode = 'docs' THEN {_DOCUMENTED} ELSE {tx.EMPTY} END"
