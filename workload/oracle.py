"""SQL counterparts of the registered queries, for an engine that cannot parse Python.

Text facts are computed from the text; syntax facts of the generated corpora
come from counting pieces (see ``corpora``).
"""

from __future__ import annotations

from grainscore import fixed_values as fixed
from grainscore.functions.patterns import WHITESPACE, any_of, re2
from grainscore.operators import imports
from workload import corpora as cp

WS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def q(text: str) -> str:
    """String literal."""
    return "'" + text.replace("'", "''") + "'"


def _strings(items) -> str:
    return ", ".join(q(i) for i in items)


def _case(column: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {q(re2(p, True))}) THEN {q(l)}" for p, l in rules) + " END"


def _text(value: str) -> str:
    """Literal that may span lines."""
    return "(" + " || chr(10) || ".join(q(line) for line in value.split("\n")) + ")"


def _values(name: str, columns: str, rows: list[str]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join(f'({r})' for r in rows)})"


def _nullable(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else q(value)


def _piece_tables() -> list[str]:
    rows: dict[str, list[str]] = {k: [] for k in ("piece", "pfun", "pvar", "pimp", "pcall", "pdoc")}
    for o, part in enumerate(cp.PARTS):
        for j, p in enumerate(part.pieces, start=1):
            key = f"{q(part.name)}, {o}, {j}"
            rows["piece"].append(f"{key}, {p.asserts}, {p.code}")
            for f in p.functions:
                rows["pfun"].append(
                    f"{key}, {q(f.name)}, {q(f.types)}, {q(f.body)}, {f.is_async}, {f.n_args}, {f.n_body}, "
                    f"{f.has_doc}, {f.doc_lines}, {f.only_stub}, {f.raises_nie}"
                )
            for k, n in enumerate(p.targets + p.args):
                rows["pvar"].append(f"{key}, {k}, {q(n)}, {q('target' if k < len(p.targets) else 'arg')}")
            for k, m in enumerate(p.imports):
                rows["pimp"].append(f"{key}, {k}, {q(m)}")
            for base, attr, shell in p.calls:
                rows["pcall"].append(f"{key}, {q(base)}, {_nullable(attr)}, {shell}")
            for owner, text, n in p.docstrings:
                rows["pdoc"].append(f"{key}, {q(owner)}, {_text(text)}, {n}")
    head = "part, ord, j"
    return [
        _values("piece", f"{head}, asserts, code", rows["piece"]),
        _values(
            "pfun",
            f"{head}, name, types, body, is_async, n_args, n_body, has_doc, doc_lines, only_stub, raises_nie",
            rows["pfun"],
        ),
        _values("pvar", f"{head}, k, name, kind", rows["pvar"]),
        _values("pimp", f"{head}, k, module", rows["pimp"]),
        _values("pcall", f"{head}, base, attr, shell_true", rows["pcall"]),
        _values("pdoc", f"{head}, owner, text, n_lines", rows["pdoc"]),
    ]


def _admission(corpus: str) -> list[str]:
    generated = corpus in ("code", "annotated")
    parse = (
        f"CASE WHEN {cp._FAILED} THEN 'error' WHEN n_broken > 0 THEN 'syntax_error' ELSE 'ok' END"
        if generated
        else "CAST(NULL AS VARCHAR)"
    )
    limit = fixed.MAX_FILE_BYTES
    return [
        f"src AS ({cp.SQL[corpus]()})",
        f"""sized AS (SELECT *, strlen(content) AS size_bytes,
            CASE WHEN strlen(content) = 0 THEN 'empty file'
                 WHEN strlen(content) > {limit}
                 THEN 'file too large (' || CAST(strlen(content) // 1024 AS VARCHAR) || 'KB > {limit // 1024}KB)'
                 WHEN trim(content, {WS}) = '' THEN 'empty content' END AS skip_reason,
            ends_with(lower(path), '.py') AS is_py_ext, ends_with(path, '.py') AS is_py FROM src)""",
        f"""f AS (SELECT *, CASE WHEN skip_reason IS NULL THEN {parse} END AS parse_status,
            CASE WHEN skip_reason IS NOT NULL THEN 'skipped'
                 WHEN {parse} = 'error' THEN 'error' ELSE 'analyzed' END AS status FROM sized)""",
        f"""cut AS (SELECT path, regexp_split_to_array(content, {q(LINE_BREAK)}) AS parts FROM f
            WHERE skip_reason IS NULL)""",
        f"""numbered AS (SELECT path, unnest(parts) AS raw, generate_subscripts(parts, 1) AS line_no, len(parts) AS n
            FROM cut)""",
        f"""lines AS (SELECT path, CAST(line_no AS INT) AS line_no, raw, trim(raw, {WS}) AS line FROM numbered
            WHERE NOT (line_no = n AND raw = ''))""",
        """line_m AS (SELECT path, count(*) AS n_lines, count(*) FILTER (line <> '') AS nonblank,
            count(*) FILTER (starts_with(line, '#')) AS n_hash FROM lines GROUP BY path)""",
    ]


def _facts() -> list[str]:
    unions = " UNION ALL ".join(
        f"SELECT path, {q(p.name)} AS part, n_{p.name} AS n FROM f WHERE parse_status = 'ok'" for p in cp.PARTS
    )
    use = lambda t: f"FROM amounts JOIN {t} ON {t}.part = amounts.part AND {t}.j <= amounts.n"
    return [
        *_piece_tables(),
        f"amounts AS ({unions})",
        f"""funs AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY ord, j) AS INT) AS pos,
            pfun.* EXCLUDE (part, ord, j) {use('pfun')})""",
        f"vars AS (SELECT path, ord * 100 + j * 10 + k AS pos, name, kind {use('pvar')})",
        f"imps AS (SELECT path, module {use('pimp')})",
        f"calls AS (SELECT path, base, attr, shell_true {use('pcall')})",
        f"docs AS (SELECT path, owner, text, n_lines {use('pdoc')})",
        f"sums AS (SELECT path, sum(asserts) AS n_asserts, sum(code) AS n_code {use('piece')} GROUP BY path)",
        "fun_m AS (SELECT path, count(*) AS n FROM funs GROUP BY path)",
    ]


def _blocks() -> list[str]:
    leads = ", ".join(f"lead(line, {k}) OVER w AS l{k}" for k in range(1, 6))
    filled = " AND ".join(["line <> ''"] + [f"l{k} <> ''" for k in range(1, 5)])
    return [
        f"windows AS (SELECT path, line_no, line, {leads} FROM lines WINDOW w AS (PARTITION BY path ORDER BY line_no))",
        f"""blocks AS (SELECT path, md5(concat_ws(chr(10), line, l1, l2, l3, l4)) AS block, min(line_no) AS pos,
            string_agg(CAST(line_no AS VARCHAR), ', ' ORDER BY line_no) AS positions, count(*) AS n FROM windows
            WHERE l5 IS NOT NULL AND {filled} GROUP BY path, block HAVING count(*) >= 2)""",
    ]


def _repetitive() -> list[str]:
    return [
        """dup AS (SELECT path, types, min(pos) AS pos, count(*) AS n, string_agg(name, ', ' ORDER BY pos) AS names
            FROM funs GROUP BY path, types HAVING count(*) >= 2)""",
        """same AS (SELECT path, body, min(pos) AS pos, string_agg(name, ', ' ORDER BY pos) AS names
            FROM funs GROUP BY path, body HAVING count(*) >= 3)""",
        """rep_m AS (SELECT f.path, coalesce(fun_m.n, 0) AS n_functions,
            coalesce((SELECT sum(n) FROM dup WHERE dup.path = f.path), 0) AS duplicated,
            coalesce((SELECT count(*) FROM blocks WHERE blocks.path = f.path), 0) AS n_blocks
            FROM f LEFT JOIN fun_m USING (path) WHERE status = 'analyzed')""",
        """rep_s AS (SELECT path, CASE WHEN n_functions < 2 THEN 0::DOUBLE ELSE least(1::DOUBLE,
            duplicated::DOUBLE / n_functions::DOUBLE * 0.7::DOUBLE
            + least(1::DOUBLE, n_blocks * 0.15::DOUBLE) * 0.3::DOUBLE) END AS score FROM rep_m)""",
        """rep_f AS (SELECT path, 1 AS grp, pos, 'Structurally identical functions: ' || names AS finding FROM dup
            UNION ALL SELECT same.path, 2, min(pos), 'Functions with identical body statement patterns: ' || names
            FROM same JOIN fun_m ON fun_m.path = same.path AND fun_m.n >= 2 GROUP BY same.path, names
            UNION ALL SELECT blocks.path, 3, pos, 'Repeated code block found at lines: [' || positions || ']'
            FROM blocks JOIN fun_m ON fun_m.path = blocks.path AND fun_m.n >= 2)""",
    ]


def _naming() -> list[str]:
    words = lambda p: f"regexp_extract_all(content, {q(re2(p, True))}, 1)"
    families = " UNION ALL ".join(
        f"""SELECT path, {k} AS pos, {q(label)} AS label, list_slice({words(p)}, 1, 5) AS found FROM f
            WHERE status = 'analyzed' AND NOT (coalesce(parse_status = 'ok', false) AND is_py_ext)"""
        for k, (p, label) in enumerate(fixed.TEXT_NAMING_PATTERNS)
    )
    return [
        "distinct_vars AS (SELECT path, name, min(pos) AS pos FROM vars GROUP BY path, name)",
        f"""gen_vars AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS rn FROM distinct_vars
            WHERE lower(name) IN ({_strings(fixed.GENERIC_VARIABLE_NAMES)}))""",
        f"gen_funs AS (SELECT * FROM funs WHERE lower(name) IN ({_strings(fixed.GENERIC_FUNCTION_NAMES)}))",
        f"""letters AS (SELECT * FROM distinct_vars WHERE length(name) = 1
            AND name NOT IN ({_strings(fixed.ACCEPTED_SINGLE_LETTERS)}))""",
        f"families AS ({families})",
        """nam_m AS (SELECT path, coalesce(parse_status = 'ok', false) AND is_py_ext AS by_names,
            (SELECT count(*) FROM distinct_vars v WHERE v.path = f.path) AS n_vars,
            (SELECT count(DISTINCT name) FROM funs v WHERE v.path = f.path) AS n_funs,
            (SELECT count(*) FROM gen_vars v WHERE v.path = f.path) AS n_gen_vars,
            (SELECT count(*) FROM gen_funs v WHERE v.path = f.path) AS n_gen_funs,
            (SELECT count(*) FROM letters v WHERE v.path = f.path) AS n_letters,
            (SELECT count(*) FROM families v WHERE v.path = f.path AND len(found) > 0) AS n_families
            FROM f WHERE status = 'analyzed')""",
        """nam_s AS (SELECT path, CASE WHEN NOT by_names THEN least(1::DOUBLE, n_families * 0.1::DOUBLE)
            WHEN n_vars + n_funs = 0 THEN 0::DOUBLE
            ELSE least(1::DOUBLE, (n_gen_vars + n_gen_funs)::DOUBLE / (n_vars + n_funs)::DOUBLE * 0.8::DOUBLE
            + least(0.2::DOUBLE, n_letters * 0.03::DOUBLE)) END AS score FROM nam_m)""",
        """nam_f AS (
            SELECT path, 1 AS grp, 0 AS pos, 'Generic variable names: ' || string_agg(name, ', ' ORDER BY pos) AS finding
            FROM gen_vars JOIN (SELECT path FROM nam_m WHERE by_names) USING (path) WHERE rn <= 10 GROUP BY path
            UNION ALL SELECT path, 2, 0, 'Generic function names: ' || string_agg(name, ', ' ORDER BY pos)
            FROM gen_funs JOIN (SELECT path FROM nam_m WHERE by_names) USING (path) GROUP BY path
            UNION ALL SELECT path, 3, 0, 'Many single-letter variable names: ' || string_agg(name, ', ' ORDER BY name)
            FROM letters JOIN (SELECT path FROM nam_m WHERE by_names) USING (path) GROUP BY path HAVING count(*) > 3
            UNION ALL SELECT path, 4, pos, 'Found ' || label || ': '
                || array_to_string(list_sort(list_distinct(found)), ', ') FROM families WHERE len(found) > 0)""",
    ]


def _comments() -> list[str]:
    narrative = re2(any_of(fixed.NARRATIVE_COMMENT_PATTERNS), True)
    return [
        f"""com AS (SELECT path, line_no, CASE WHEN starts_with(line, '#') THEN line
            ELSE '# ' || trim(substr(line, strpos(line, '#') + 1), {WS}) END AS text
            FROM lines WHERE contains(line, '#'))""",
        f"""com_l AS (SELECT *, {_case('text', fixed.OBVIOUS_COMMENT_PATTERNS)} AS label,
            regexp_matches(text, {q(narrative)}) AS narrative FROM com)""",
        """obvious AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rn FROM com_l
            WHERE label IS NOT NULL)""",
        """runs AS (SELECT path, count(*) AS n FROM (SELECT path,
            line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS island
            FROM lines WHERE starts_with(line, '#')) GROUP BY path, island)""",
        "longest AS (SELECT path, max(n) AS run FROM runs GROUP BY path)",
        """com_c AS (SELECT path, count(*) AS n, count(label) AS n_obvious,
            count(*) FILTER (narrative) AS n_narrative FROM com_l GROUP BY path)""",
        """com_m AS (SELECT path, nonblank, coalesce(n, 0) AS n, coalesce(n_obvious, 0) AS n_obvious,
            coalesce(n_narrative, 0) AS n_narrative, coalesce(run, 0) AS run,
            coalesce(n, 0)::DOUBLE / nonblank::DOUBLE AS ratio
            FROM line_m LEFT JOIN com_c USING (path) LEFT JOIN longest USING (path))""",
        """com_s AS (SELECT path, least(1::DOUBLE, least(0.5::DOUBLE, n_obvious * 0.05::DOUBLE)
            + least(0.2::DOUBLE, n_narrative * 0.04::DOUBLE)
            + CASE WHEN nonblank > 10 AND ratio > 0.4::DOUBLE
                   THEN least(0.3::DOUBLE, (ratio - 0.4::DOUBLE) * 1.5::DOUBLE) ELSE 0::DOUBLE END
            + least(0.1::DOUBLE, run * 0.005::DOUBLE)) AS score FROM com_m)""",
        """com_f AS (
            SELECT path, 1 AS grp, 0 AS pos, 'Code-restating comments found (' || n_obvious || ' instances):' AS finding
            FROM com_m WHERE n_obvious > 0
            UNION ALL SELECT path, 2, line_no, '  Line ' || line_no || ': ' || label || ' (' || left(text, 60) || ')'
            FROM obvious WHERE rn <= 5
            UNION ALL SELECT path, 3, 0, '  ... and ' || (n_obvious - 5) || ' more' FROM com_m WHERE n_obvious > 5
            UNION ALL SELECT path, 4, 0, 'Narrative/tutorial-style comments: ' || n_narrative
                || ' instances (step-by-step narration detected)' FROM com_m WHERE n_narrative >= 3
            UNION ALL SELECT path, 5, 0, 'Very high comment density: ' || printf('%.1f%%', ratio * 100)
                || ' of non-empty lines are comments (' || n || ' comments / ' || nonblank || ' lines)'
            FROM com_m WHERE nonblank > 10 AND ratio > 0.4::DOUBLE
            UNION ALL SELECT path, 6, 0, 'Large comment block found: ' || run || ' consecutive comment lines'
            FROM com_m WHERE run > 8)""",
    ]


def _imports() -> list[str]:
    starts = "|".join(fixed.SUSPICIOUS_MODULE_PREFIXES)
    ends = "|".join(p.rstrip("_") for p in fixed.SUSPICIOUS_MODULE_PREFIXES)
    invented = f"^(?:{starts})|(?:{ends})$"
    return [
        "imp_d AS (SELECT DISTINCT path, module FROM imps JOIN f USING (path) WHERE is_py)",
        f"""unknown AS (SELECT path, module, regexp_matches(lower(module), {q(invented)}) AS invented FROM imp_d
            WHERE module NOT IN ({_strings(imports.known_modules())}))""",
        """imp_m AS (SELECT f.path, (SELECT count(*) FROM imp_d d WHERE d.path = f.path) AS n,
            (SELECT count(*) FROM unknown d WHERE d.path = f.path AND invented) AS suspicious,
            (SELECT count(*) FROM unknown d WHERE d.path = f.path AND NOT invented) AS unresolvable
            FROM f WHERE status = 'analyzed')""",
        """imp_s AS (SELECT path, CASE WHEN n = 0 THEN 0::DOUBLE ELSE least(1::DOUBLE,
            suspicious::DOUBLE / n::DOUBLE * 0.8::DOUBLE + unresolvable::DOUBLE / n::DOUBLE * 0.3::DOUBLE) END AS score
            FROM imp_m)""",
        """imp_f AS (SELECT path, CASE WHEN invented THEN 1 ELSE 2 END AS grp, 0 AS pos, CASE WHEN invented
                THEN 'Suspicious module names (likely hallucinated): '
                ELSE 'Unresolvable imports (not in stdlib/known packages, may be local or hallucinated): ' END
            || string_agg(module, ', ' ORDER BY module) AS finding FROM unknown GROUP BY path, invented)""",
    ]


def _placeholders() -> list[str]:
    names = lambda test, label, grp: (
        f"""SELECT path, {grp}, 0, {q(label + ': ')} || string_agg(name, ', ' ORDER BY pos)
            FROM funs JOIN (SELECT path FROM f WHERE is_py) USING (path) WHERE {test} GROUP BY path"""
    )
    docstring_only, pass_only = "only_stub AND has_doc AND n_body = 1", "only_stub AND NOT has_doc"
    return [
        f"""marks AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rn FROM
            (SELECT path, line_no, line, {_case('line', fixed.MARKER_PATTERNS)} AS label FROM lines)
            WHERE label IS NOT NULL)""",
        "mark_l AS (SELECT path, label, count(*) AS n, min(line_no) AS pos FROM marks GROUP BY path, label)",
        f"""pla_m AS (SELECT path, is_py AND coalesce(parse_status = 'syntax_error', false) AS broken,
            (SELECT count(*) FROM marks m WHERE m.path = f.path) AS n_marks,
            (SELECT count(*) FROM funs m WHERE m.path = f.path AND is_py AND {docstring_only}) AS docstring_only,
            (SELECT count(*) FROM funs m WHERE m.path = f.path AND is_py AND {pass_only}) AS pass_only,
            (SELECT count(*) FROM funs m WHERE m.path = f.path AND is_py AND raises_nie) AS not_implemented
            FROM f WHERE status = 'analyzed')""",
        """pla_s AS (SELECT path, CASE WHEN broken THEN least(1::DOUBLE, n_marks * 0.08::DOUBLE)
            ELSE least(1::DOUBLE, least(0.5::DOUBLE, n_marks * 0.06::DOUBLE)
            + least(0.3::DOUBLE, docstring_only * 0.08::DOUBLE) + least(0.3::DOUBLE, pass_only * 0.1::DOUBLE)
            + least(0.2::DOUBLE, not_implemented * 0.07::DOUBLE)) END AS score FROM pla_m)""",
        f"""pla_f AS (
            SELECT path, 1 AS grp, 0 AS pos, 'Placeholder/incomplete markers: '
                || string_agg(n || 'x ' || label, ', ' ORDER BY pos) AS finding FROM mark_l GROUP BY path
            UNION ALL SELECT path, 2, line_no, '  Line ' || line_no || ': ' || left(line, 80) FROM marks WHERE rn <= 5
            UNION ALL SELECT path, 3, 0, '  ... and ' || (n_marks - 5) || ' more' FROM pla_m WHERE n_marks > 5
            UNION ALL {names(docstring_only, 'Empty functions (docstring only)', 4)}
            UNION ALL {names(pass_only, 'Empty function bodies (pass/... only)', 5)}
            UNION ALL {names('raises_nie', 'Stub functions (raise NotImplementedError)', 6)})""",
    ]


def _ratio() -> list[str]:
    boilerplate = re2(any_of(fixed.BOILERPLATE_DOCSTRING_PATTERNS))
    long_doc = "has_doc AND doc_lines > (n_body - 1) * 2 AND doc_lines > 3"
    return [
        f"""rat_m AS (SELECT f.path, CASE WHEN NOT is_py THEN 'text' WHEN parse_status = 'ok' THEN 'docs' END AS mode,
            n_hash, nonblank, n_hash::DOUBLE / nonblank::DOUBLE AS comment_ratio,
            coalesce((SELECT sum(n_lines) FROM docs d WHERE d.path = f.path), 0) AS doc_lines,
            (SELECT count(*) FROM docs d WHERE d.path = f.path) AS n_docs,
            (SELECT count(*) FROM docs d WHERE d.path = f.path AND regexp_matches(lower(text), {q(boilerplate)})) AS n_boiler,
            (SELECT count(*) FROM funs d WHERE d.path = f.path AND {long_doc}) AS n_long,
            coalesce(n_code, 0) AS n_code
            FROM f JOIN line_m USING (path) LEFT JOIN sums USING (path) WHERE status = 'analyzed')""",
        "rat_r AS (SELECT *, (doc_lines + n_hash)::DOUBLE / nonblank::DOUBLE AS doc_ratio FROM rat_m)",
        """rat_s AS (SELECT path, CASE mode
            WHEN 'text' THEN least(1::DOUBLE, greatest(0::DOUBLE, (comment_ratio - 0.3::DOUBLE) * 1.5::DOUBLE))
            WHEN 'docs' THEN least(1::DOUBLE, greatest(0::DOUBLE, (doc_ratio - 0.3::DOUBLE) * 1.2::DOUBLE)
                + least(0.3::DOUBLE, n_boiler * 0.08::DOUBLE) + least(0.2::DOUBLE, n_long * 0.07::DOUBLE))
            ELSE 0::DOUBLE END AS score FROM rat_r)""",
        """rat_f AS (
            SELECT path, 1 AS grp, 0 AS pos, CASE WHEN doc_ratio > 0.6::DOUBLE
                THEN 'Extremely high documentation ratio: ' ELSE 'High documentation ratio: ' END
                || printf('%.1f%%', doc_ratio * 100) || ' (' || CAST(doc_lines + n_hash AS BIGINT)
                || ' doc/comment lines vs ' || CAST(n_code AS BIGINT) || ' code lines)' AS finding
            FROM rat_r WHERE mode = 'docs' AND doc_ratio > 0.4::DOUBLE
            UNION ALL SELECT path, 2, 0, 'Boilerplate/filler docstrings detected: ' || n_boiler || ' out of '
                || n_docs || ' total docstrings' FROM rat_r WHERE mode = 'docs' AND n_boiler > 0
            UNION ALL SELECT path, 3, 0, 'Functions where docstring is longer than body: ' || n_long
            FROM rat_r WHERE mode = 'docs' AND n_long > 0
            UNION ALL SELECT path, 4, 0, 'High comment ratio in non-Python file: ' || printf('%.1f%%', comment_ratio * 100)
            FROM rat_r WHERE mode = 'text' AND comment_ratio > 0.5::DOUBLE)""",
    ]


SHELL_METHOD = f"base = 'subprocess' AND attr IN ({_strings(fixed.SHELL_METHODS)})"
CALL_KINDS = [
    ("evals", f"attr IS NULL AND base IN ({_strings(fixed.EVAL_NAMES)})"),
    ("shells", f"shell_true AND (({SHELL_METHOD}) OR (attr IS NULL AND base IN ({_strings(fixed.SHELL_NAMES)})))"),
    ("loads", f"attr = 'loads' AND base IN ({_strings(fixed.UNSAFE_LOADERS)})"),
]


def _security() -> list[str]:
    rules = [(k, "secret", p, l) for k, (p, l) in enumerate(fixed.SECRET_PATTERNS)]
    rules += [(k, "sql", p, l) for k, (p, l) in enumerate(fixed.SQL_INJECTION_PATTERNS)]
    hits = " UNION ALL ".join(
        f"""SELECT path, {q(kind)} AS kind, {k} AS rule, {q(label)} AS label,
            len(regexp_extract_all(content, {q(re2(p))})) AS n FROM f WHERE skip_reason IS NULL"""
        for k, kind, p, label in rules
    )
    dash = "chr(8212)"
    counts = ", ".join(
        f"(SELECT count(*) FROM calls c WHERE c.path = f.path AND is_py AND {test}) AS {name}" for name, test in CALL_KINDS
    )
    return [
        f"hits AS ({hits})",
        f"""sec_m AS (SELECT f.path, is_py AND coalesce(parse_status = 'syntax_error', false) AS broken,
            (SELECT sum(n) FROM hits h WHERE h.path = f.path AND kind = 'secret') AS secrets,
            (SELECT sum(n) FROM hits h WHERE h.path = f.path AND kind = 'sql') AS sql_n,
            {counts}, CASE WHEN is_py THEN coalesce(sums.n_asserts, 0) ELSE 0 END AS n_asserts
            FROM f LEFT JOIN sums USING (path) WHERE status = 'analyzed')""",
        """sec_i AS (SELECT *, secrets * 3 + sql_n * 2 + (evals + shells) * 2 + loads
            + CASE WHEN n_asserts > 5 THEN 1 ELSE 0 END AS issues FROM sec_m)""",
        """sec_s AS (SELECT path, least(1::DOUBLE, issues::DOUBLE
            * CASE WHEN broken THEN 0.1::DOUBLE ELSE 0.12::DOUBLE END) AS score FROM sec_i)""",
        f"""sec_f AS (
            SELECT path, 1 AS grp, rule AS pos, 'SECURITY: ' || label || ' detected' AS finding FROM hits
            WHERE kind = 'secret' AND n > 0
            UNION ALL SELECT path, 2, rule, 'SECURITY: ' || label || ' (' || n || ' instance(s))' FROM hits
            WHERE kind = 'sql' AND n > 0
            UNION ALL SELECT path, 3, 0, 'SECURITY: Direct use of ' || base || '() ' || {dash}
                || ' code execution from strings' FROM calls JOIN f USING (path) WHERE is_py AND {CALL_KINDS[0][1]}
            UNION ALL SELECT path, 4, 0, 'SECURITY: subprocess call with shell=True ' || {dash}
                || ' command injection risk' FROM calls JOIN f USING (path) WHERE is_py AND {CALL_KINDS[1][1]}
            UNION ALL SELECT path, 5, 0, 'SECURITY: ' || base || '.loads() ' || {dash}
                || ' deserializing untrusted data is unsafe' FROM calls JOIN f USING (path) WHERE is_py AND {CALL_KINDS[2][1]}
            UNION ALL SELECT path, 6, 0, 'SECURITY: Heavy use of assert (' || CAST(n_asserts AS BIGINT)
                || ' times) for validation ' || {dash} || ' assert statements can be disabled with Python -O flag'
            FROM sec_m WHERE n_asserts > 5)""",
    ]


SHORT = {n: n[:3] for n in fixed.DETECTORS}


def _results() -> list[str]:
    total = "0::DOUBLE" + "".join(f" + {n} * {w}::DOUBLE" for n, w in fixed.DETECTOR_WEIGHTS.items())
    used = 0.0
    for w in fixed.DETECTOR_WEIGHTS.values():
        used += w
    bands = lambda field: "CASE " + " ".join(f"WHEN final_score >= {b[0]} THEN {q(b[field])}" for b in fixed.SCORE_BANDS) + " END"
    joins = " ".join(f"JOIN (SELECT path, score AS {n} FROM {s}_s) USING (path)" for n, s in SHORT.items())
    findings = " UNION ALL ".join(
        f"SELECT path, {k} AS det, grp, pos, finding FROM {s}_f" for k, s in enumerate(SHORT.values())
    )
    return [
        f"scores AS (SELECT path, {', '.join(fixed.DETECTORS)} FROM f {joins} WHERE status = 'analyzed')",
        f"""final AS (SELECT *, CAST(greatest(0, least(100, round_even(({total}) / {used}::DOUBLE * 100, 0))) AS INT)
            AS final_score FROM scores)""",
        f"all_findings AS ({findings})",
        f"""found AS (SELECT path, list(finding ORDER BY det, grp, pos) AS findings FROM all_findings
            JOIN f USING (path) WHERE status = 'analyzed' GROUP BY path)""",
        f"""results AS (SELECT repo_id, path, status, skip_reason, final_score, {bands(1)} AS label, {bands(2)} AS color,
            {', '.join(fixed.DETECTORS)}, coalesce(findings, []) AS findings
            FROM f LEFT JOIN final USING (path) LEFT JOIN found USING (path))""",
        f"""summary AS (SELECT repo_id, count(*) AS total_files,
            count(*) FILTER (status = 'analyzed') AS analyzed_files, count(*) FILTER (status = 'skipped') AS skipped_files,
            count(*) FILTER (status = 'error') AS error_files,
            coalesce(CAST(round_even(avg(pow(final_score, 1.5)) / 1000 * 100, 0) AS BIGINT), 0) AS repo_score,
            coalesce(CAST(floor(sum(final_score) / count(final_score)) AS BIGINT), 0) AS average_score,
            max(final_score) AS max_score, min(final_score) AS min_score,
            count(*) FILTER (final_score >= {fixed.HIGH_RISK}) AS high_risk_files,
            count(*) FILTER (final_score >= {fixed.MEDIUM_RISK} AND final_score < {fixed.HIGH_RISK}) AS medium_risk_files
            FROM results GROUP BY repo_id)""",
    ]


def over(corpus: str, select: str) -> str:
    """``select`` with everything known about a corpus in scope; unused parts cost nothing."""
    tables = _admission(corpus) + _blocks() + _comments()
    if corpus in ("code", "annotated"):
        tables += (
            _facts() + _repetitive() + _naming() + _imports() + _placeholders() + _ratio() + _security() + _results()
        )
    else:
        tables += _security()[:1]
        tables += _placeholders()[:2]
    return "WITH " + ",\n".join(tables) + "\n" + select
