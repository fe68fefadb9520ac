"""Over-commenting, judged from the text of ``#`` comments in any language."""

from __future__ import annotations

from grainscore import fixed_values as fixed
from grainscore.functions import text as tx
from grainscore.functions.patterns import any_by_letter, first_label, matches
from grainscore.operators import lines as ln


def comment_text(line: str) -> str:
    """Comment of a stripped line that holds ``#``; an inline one is rebuilt as ``# text``."""
    after = tx.strip(f"substr({line}, instr({line}, '#') + 1)")
    return f"CASE WHEN startswith({line}, '#') THEN {line} ELSE concat('# ', {after}) END"


def comment_lines(hash_lines: str) -> str:
    """array<struct<line_no, text>> of all comments."""
    return f"transform({hash_lines}, s -> named_struct('line_no', s.line_no, 'text', {comment_text('s.text')}))"


def is_obvious(comment: str) -> str:
    return matches(comment, any_by_letter([p for p, _ in fixed.OBVIOUS_COMMENT_PATTERNS]), True)


def is_narrative(comment: str) -> str:
    return matches(comment, any_by_letter(fixed.NARRATIVE_COMMENT_PATTERNS), True)


def is_found(comment: str) -> str:
    """Obvious or narrative."""
    return matches(comment, any_by_letter([*(p for p, _ in fixed.OBVIOUS_COMMENT_PATTERNS), *fixed.NARRATIVE_COMMENT_PATTERNS]), True)


def obvious_label(comment: str) -> str:
    return first_label(comment, fixed.OBVIOUS_COMMENT_PATTERNS)


def longest_run(lines: str) -> str:
    """Most consecutive lines that start with ``#``."""
    marks = f"array_join(transform({lines}, l -> CASE WHEN startswith(l, '#') THEN '#' ELSE ' ' END), '')"
    return f"array_max(transform(split({marks}, ' '), m -> length(m)))"


MEASURES = [
    {
        "com_lines": comment_lines("hash_lines"),
        "com_nonblank": ln.nonblank_count("lines"),
        "com_run": f"CASE WHEN size(hash_lines) > 0 THEN {longest_run('lines')} ELSE 0 END",
    },
    # one pass for both kinds; the few lines of either are told apart
    {
        "com_count": "size(com_lines)",
        "com_found": f"filter(com_lines, c -> {is_found('c.text')})",
    },
    {
        "com_obvious": f"filter(com_found, c -> {is_obvious('c.text')})",
        "com_narrative": f"size(filter(com_found, c -> {is_narrative('c.text')}))",
    },
]

_RATIO = "com_count / com_nonblank"
_DENSE = f"com_nonblank > 10 AND {_RATIO} > 0.4D"

SCORE = (
    "least(1.0D, least(0.5D, size(com_obvious) * 0.05D) + least(0.2D, com_narrative * 0.04D) "
    f"+ CASE WHEN {_DENSE} THEN least(0.3D, ({_RATIO} - 0.4D) * 1.5D) ELSE 0.0D END "
    "+ least(0.1D, com_run * 0.005D))"
)

_SHOWN = (
    "transform(slice(com_obvious, 1, 5), c -> "
    f"concat('  Line ', c.line_no, ': ', {obvious_label('c.text')}, ' (', left(c.text, 60), ')'))"
)
_RESTATING = (
    "concat(array(format_string('Code-restating comments found (%d instances):', size(com_obvious))), "
    + _SHOWN + ", "
    + tx.listed("size(com_obvious) > 5", "array(format_string('  ... and %d more', size(com_obvious) - 5))")
    + ")"
)

FINDINGS = (
    "concat("
    + ", ".join(
        [
            tx.listed("size(com_obvious) > 0", _RESTATING),
            tx.listed(
                "com_narrative >= 3",
                "array(format_string('Narrative/tutorial-style comments: %d instances "
                "(step-by-step narration detected)', com_narrative))",
            ),
            tx.listed(
                _DENSE,
                f"array(concat('Very high comment density: ', {tx.percent(_RATIO)}, "
                "' of non-empty lines are comments ', "
                "format_string('(%d comments / %d lines)', com_count, com_nonblank)))",
            ),
            tx.listed(
                "com_run > 8",
                "array(format_string('Large comment block found: %d consecutive comment lines', com_run))",
            ),
        ]
    )
    + ")"
)
