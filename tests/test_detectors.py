"""Scores and findings of small files, worked out by hand from the rules."""

from textwrap import dedent

import pytest


def text(snippet):
    return dedent(snippet).lstrip("\n")


GENERIC = text('''
    def load_data(data, value, tmp):
        items = data
        res = value
        return res
    ''')
OBVIOUS = text('''
    # increment counter
    n += 1
    # return the result
    total = n
    # loop through rows
    for k in rows:
        # append row to list
        seen.append(k)
    # open the file
    # close the file
    ''')
MARKERS = text('''
    def a():
        # TODO: write
        pass

    def b():
        """Only words."""

    def c():
        raise NotImplementedError

    def d():
        """Doc."""
        pass
    # FIXME: wrong
    ''')
RISKY = text('''
    import subprocess
    secret = "abcdefgh1"
    subprocess.run(cmd, shell=True)
    exec(body)
    cursor.execute("SELECT a FROM b WHERE c = " + name)
    pickle.loads(blob)
    ''')
TWINS = text('''
    def one(a):
        for k in a:
            print(k)
        return a

    def two(b):
        for k in b:
            print(k)
        return b

    def other():
        return 1
    ''')
DOCS = text('''
    """This module provides things.

    second
    """

    def f(v):
        """This function handles the value.
        a
        b
        c
        """
        return v
    ''')
BLOCK = "".join(f"v{k} = {k}\n" for k in range(5))
CASES = {
    "generic.py": (GENERIC, "naming", 6 / 6 * 0.8),
    "obvious.py": (OBVIOUS, "comments", 6 * 0.05 + 2 * 0.005),
    "markers.py": (MARKERS, "placeholders", 2 * 0.06 + 0.08 + 0.1 + 0.07),
    "risky.py": (RISKY, "security", 1.0),
    "twins.py": (TWINS, "repetitive", 2 / 3 * 0.7),
    "one_function.py": ("def f():\n    return 1\n", "repetitive", 0.0),
    "broken.py": ("def f(:\n    # TODO: x\n", "placeholders", 0.08),
    "broken_secret.py": ('token = "abcdefghijkl"\ndef (\n', "security", 0.3),
    "secret.py": ('password = "not_a_secret"\n', "security", 0.36),
    "eval.py": ("v = eval(text)\n", "security", 0.24),
    "sql.py": ('cursor.execute("SELECT a FROM t WHERE i = " + key)\n', "security", 0.48),
    "assert5.py": ("assert a\n" * 5, "security", 0.0),
    "assert6.py": ("assert a\n" * 6, "security", 0.12),
    "invented.py": ("import advanced_tool\nfrom smart_kit import x\nimport magic_wand\n", "imports", 0.8),
    "known.py": ("import os, sys\nimport numpy as np\nfrom pandas import DataFrame\n", "imports", 0.0),
    "relative.py": ("from .nearby import f\n", "imports", 0.3),
    "upper.PY": ("import zz_local_thing\n# TODO: x\n", "imports", 0.0),
    "script.js": ("var data = 1; let temp = 2;\n", "naming", 0.1),
    "slashes.js": ("// note\n" * 20 + "a = 1\nb = 2\n", "ratio", 0.0),
    "hashes.sh": ("# a\n# b\n# c\nx=1\n", "ratio", (0.75 - 0.3) * 1.5),
    "stub_calls.py": (
        "def a():\n    raise NotImplementedError('x')\n\ndef b():\n    raise NotImplementedError\n", "placeholders", 0.14,
    ),
    "text_functions.js": ("def a():\n    pass\n\n\ndef b():\n    pass\n", "repetitive", 0.7),
    "block_last.py": (BLOCK + BLOCK + "def a(): pass\ndef b(): return 1\n", "repetitive", 0.15 * 0.3),
    "block_end.py": ("def a(): pass\ndef b(): return 1\n" + BLOCK + BLOCK, "repetitive", 0.0),
    "dense10.py": ("# n\nx1 = 1\n" * 5, "comments", 0.005),
    "dense11.py": ("# n\nx1 = 1\n" * 5 + "# m\n", "comments", min(0.3, (6 / 11 - 0.4) * 1.5) + 0.005),
    "docs.py": (DOCS, "ratio", min(1.0, (6 / 10 - 0.3) * 1.2 + 2 * 0.08 + 0.07)),
}


@pytest.fixture(scope="module")
def results(spark):
    from grainscore import detect, files_from_table

    rows = [("repo", path, case[0]) for path, case in CASES.items()]
    frame = spark.createDataFrame(rows, "repo_id string, path string, content string")
    return {r["path"]: r for r in detect(files_from_table(frame)).collect()}


@pytest.mark.parametrize("path", CASES)
def test_score(results, path):
    _, detector, expected = CASES[path]
    assert results[path]["status"] == "analyzed"
    assert results[path][f"{detector}_score"] == pytest.approx(expected, abs=1e-9)


def test_findings(results):
    assert results["twins.py"]["repetitive_findings"] == ["Structurally identical functions: one, two"]
    assert results["generic.py"]["naming_findings"] == [
        "Generic variable names: data, value, tmp, items, res",
        "Generic function names: load_data",
    ]
    assert results["block_last.py"]["repetitive_findings"] == ["Repeated code block found at lines: [1, 6]"]
    assert results["markers.py"]["placeholders_findings"] == [
        "Placeholder/incomplete markers: 1x TODO comment, 1x FIXME comment",
        "  Line 2: # TODO: write",
        "  Line 14: # FIXME: wrong",
        "Empty functions (docstring only): b",
        "Empty function bodies (pass/... only): a",
        "Stub functions (raise NotImplementedError): c",
    ]
    assert results["obvious.py"]["comments_findings"][0] == "Code-restating comments found (6 instances):"
    assert results["obvious.py"]["comments_findings"][6] == "  ... and 1 more"
    assert results["dense11.py"]["comments_findings"] == [
        "Very high comment density: 54.5% of non-empty lines are comments (6 comments / 11 lines)"
    ]
    assert results["script.js"]["naming_findings"] == ["Found generic variable assignment: data, temp"]


def test_admission_and_errors(score):
    found = score(
        {
            "empty.py": "",
            "blank.py": " \t\u00a0\n\x0c",
            "limit.py": "#" + "a" * 511_999,
            "over.py": "#" + "a" * 512_000,
            "deep.py": "x = " + "-" * 50_000 + "1\n",
            "chain.js": "a" + ".b" * 50_000 + "\n",
            "nul.py": "x = 1\x00\n",
            "surrogate.py": 'def f():\n    "\\ud800"\n',
        }
    )
    assert found["empty.py"]["skip_reason"] == "empty file"
    assert found["blank.py"]["skip_reason"] == "empty content"
    assert found["limit.py"]["status"] == "analyzed"
    assert found["over.py"]["skip_reason"] == "file too large (500KB > 500KB)"
    assert found["deep.py"]["status"] == found["chain.js"]["status"] == "error"
    assert found["deep.py"]["error"].startswith("analysis error: ")
    assert found["nul.py"]["status"] == "analyzed"
    assert found["surrogate.py"]["placeholders_score"] == pytest.approx(0.08)
