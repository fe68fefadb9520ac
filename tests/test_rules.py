"""Every rule decides something in the generated code."""

import re

import pytest

from grainscore import fixed_values as fixed
from workload.corpora import PARTS

LINES = [line for part in PARTS for piece in part.pieces for line in piece.text.split("\n")]


@pytest.mark.parametrize("rules", [fixed.OBVIOUS_COMMENT_PATTERNS, [(p, p) for p in fixed.NARRATIVE_COMMENT_PATTERNS], fixed.MARKER_PATTERNS])
def test_every_rule_comes_first_somewhere(rules):
    fired = set()
    for line in LINES:
        fired.update([p for p, _ in rules if re.search(p, line, re.IGNORECASE)][:1])
    assert [p for p, _ in rules if p not in fired] == []


@pytest.mark.parametrize("rules", [fixed.SECRET_PATTERNS, fixed.SQL_INJECTION_PATTERNS])
def test_every_security_rule_counts_some_line(rules):
    assert [label for p, label in rules if not any(re.search(p, line) for line in LINES)] == []


def test_every_boilerplate_rule_alone_decides_a_docstring():
    docstrings = [text.lower() for part in PARTS for piece in part.pieces for _, text, _ in piece.docstrings]
    alone = [hits[0] for hits in ([p for p in fixed.BOILERPLATE_DOCSTRING_PATTERNS if re.search(p, d)] for d in docstrings) if len(hits) == 1]
    assert [p for p in fixed.BOILERPLATE_DOCSTRING_PATTERNS if p not in alone] == []


@pytest.mark.parametrize("rule", [p for p, _ in fixed.TEXT_NAMING_PATTERNS])
def test_every_family_of_names_in_other_languages_is_hit(rule):
    assert any(re.search(rule, line, re.IGNORECASE) for line in LINES)
