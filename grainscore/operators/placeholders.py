"""Unfinished code: marker comments in any language, empty and stub functions in Python."""

from __future__ import annotations

from grainscore import fixed_values as fixed
from grainscore.functions import text as tx
from grainscore.functions.patterns import any_by_letter, first_label, matches


def marker_lines(hash_lines: str) -> str:
    """array<struct<line_no, text>>; every marker pattern needs a ``#``."""
    test = matches("s.text", any_by_letter([p for p, _ in fixed.MARKER_PATTERNS]), True)
    return f"filter({hash_lines}, s -> {test})"


def marker_label(line: str) -> str:
    return first_label(line, fixed.MARKER_PATTERNS)


def label_counts(markers: str) -> str:
    """array<struct<label, n>> in first-seen order."""
    return tx.let(
        f"transform({markers}, s -> {marker_label('s.text')})",
        "labels",
        "transform(array_distinct(labels), d -> named_struct('label', d, 'n', size(filter(labels, x -> x = d))))",
    )


_PARSED = "is_py AND parse_status = 'ok'"


def _names(test: str) -> str:
    return tx.listed(_PARSED, f"transform(filter(functions, f -> {test}), f -> f.name)")


MEASURES = [
    {
        "pla_markers": marker_lines("hash_lines"),
        "pla_broken": "is_py AND parse_status = 'syntax_error'",
        "pla_docstring_only": _names("f.only_stub AND f.has_docstring AND f.n_body = 1"),
        "pla_pass_only": _names("f.only_stub AND NOT f.has_docstring"),
        "pla_not_implemented": _names("f.raises_nie"),
    }
]

SCORE = (
    "CASE WHEN pla_broken THEN least(1.0D, size(pla_markers) * 0.08D) ELSE "
    "least(1.0D, least(0.5D, size(pla_markers) * 0.06D) + least(0.3D, size(pla_docstring_only) * 0.08D) "
    "+ least(0.3D, size(pla_pass_only) * 0.1D) + least(0.2D, size(pla_not_implemented) * 0.07D)) END"
)

_SUMMARY = f"array_join(transform({label_counts('pla_markers')}, c -> concat(c.n, 'x ', c.label)), ', ')"
_MARKED = (
    f"concat(array(concat('Placeholder/incomplete markers: ', {_SUMMARY})), "
    "transform(slice(pla_markers, 1, 5), s -> concat('  Line ', s.line_no, ': ', left(s.text, 80))), "
    + tx.listed("size(pla_markers) > 5", "array(format_string('  ... and %d more', size(pla_markers) - 5))")
    + ")"
)


def _named(label: str, column: str) -> str:
    return tx.listed(f"size({column}) > 0", tx.joined(label, column))


FINDINGS = (
    "concat("
    + ", ".join(
        [
            tx.listed("size(pla_markers) > 0", _MARKED),
            _named("Empty functions (docstring only): ", "pla_docstring_only"),
            _named("Empty function bodies (pass/... only): ", "pla_pass_only"),
            _named("Stub functions (raise NotImplementedError): ", "pla_not_implemented"),
        ]
    )
    + ")"
)
