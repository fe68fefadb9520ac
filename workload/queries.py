"""Registered queries: one or more per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainscore import fixed_values as fixed
from grainscore.functions import scoring as sc
from grainscore.functions import text as tx
from grainscore.functions.patterns import literal
from grainscore.functions.storage import scratch
from grainscore.operators import comments, imports, lines, naming, placeholders, ratio, repetitive, security, syntax
from grainscore.operators.registry import Detector, FrameDetector, builtin_detectors, imports_from_tables
from grainscore.plans import reports, rollup
from grainscore.plans import scoring as plan
from grainscore.sources import corpus, ignore
from workload import corpora as cp
from workload.oracle import CALL_KINDS, SHORT, over, q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return keep


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _lined(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Corpus with lines, no parse."""
    return lines.with_lines(corpus.admit(cp.files(spark, sf_dir, name)))


def _prepared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return plan.prepare(cp.files(spark, sf_dir, name))


def _parsed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return plan.parse(cp.files(spark, sf_dir, name))


def _analyzed(spark: SparkSession, sf_dir: str, name: str, module) -> DataFrame:
    """Measures of one detector for files that were analyzed."""
    detector = [d for d in builtin_detectors() if SHORT[d.name] == module]
    return plan.with_measures(_prepared(spark, sf_dir, name), detector).where(
        F.col("skip_reason").isNull() & (F.col("parse_status") != "error")
    )


def _results(spark: SparkSession, sf_dir: str, name: str = "code") -> DataFrame:
    return plan.score_files(cp.files(spark, sf_dir, name))


def _long(column: str) -> Column:
    return F.col(column).cast("long")


# Scans and admission ----------------------------------------------------------


@register(
    "corpus_scan",
    f"SELECT repo_id, path, strlen(content) AS size_bytes, md5(content) AS digest FROM ({cp.documents_sql()})",
)
def _(spark, sf_dir):
    return cp.files(spark, sf_dir, "documents").select("repo_id", "path", "size_bytes", F.md5("content").alias("digest"))


_SUFFIXES = ["'.py'", "'.PY'", "'.md'", "'.txt'", "'.Tsx'", "'/.py'", "'.'"]


@register(
    "extension_filter",
    f"""SELECT lang || '/' || doc_id || CASE doc_id % 7 {' '.join(f'WHEN {k} THEN {s}' for k, s in enumerate(_SUFFIXES))}
        END AS path FROM documents WHERE doc_id % 7 IN (0, 1, 4)""",
)
def _(spark, sf_dir):
    suffix = f"CASE doc_id % 7 {' '.join(f'WHEN {k} THEN {s}' for k, s in enumerate(_SUFFIXES))} END"
    paths = _documents(spark, sf_dir).selectExpr(f"lang || '/' || doc_id || {suffix} AS path")
    return corpus.filter_extensions(paths)


_FOLDERS = "src/ node_modules/pkg/ a/build/ pkg.egg-info/ lib/dist/x/ x/ env/ environment/".split()
_FOLDER_PATH = (
    f"CASE doc_id % 8 {' '.join(f'WHEN {k} THEN {q(d)}' for k, d in enumerate(_FOLDERS))} END || doc_id "
    "|| CASE WHEN doc_id % 8 = 5 THEN '.min.js' WHEN doc_id % 24 = 0 THEN '.lock' ELSE '.js' END"
)


@register(
    "default_ignore",
    rf"""SELECT path FROM (SELECT {_FOLDER_PATH} AS path FROM documents)
        WHERE NOT regexp_matches(path, '(^|/)(\.git|\.venv|venv|env|__pycache__|[^/]*\.egg-info|dist|build|\.tox|'
            || '\.mypy_cache|\.pytest_cache|node_modules)/')
        AND NOT regexp_matches(path, '\.(pyc|pyo|pyd|min\.js|min\.css|lock|log)(/|$)')
        AND NOT regexp_matches(path, '(^|/)\.DS_Store(/|$)')""",
)
def _(spark, sf_dir):
    return ignore.filter_ignored(_documents(spark, sf_dir).selectExpr(f"{_FOLDER_PATH} AS path"))


_REPO_PATH = (
    "CASE doc_id % 5 WHEN 0 THEN 'vendor/a' || doc_id || '.js' WHEN 1 THEN 'x/vendor/b' || doc_id || '.js' "
    "WHEN 2 THEN 'keep' || doc_id || '.gen.js' WHEN 3 THEN 'y' || doc_id || '.gen.js' ELSE 'z' || doc_id || '.log' END"
)
_REPO_FILE = "concat_ws(chr(10), '# generated', '', CASE WHEN n % 3 = 0 THEN '*.gen.js' END, CASE WHEN n % 2 = 0 THEN '!keep*' END, CASE WHEN n % 5 = 0 THEN '/vendor/' END, CASE WHEN n % 7 = 0 THEN '!z*' END)"


@register(
    "repo_ignore",
    f"""SELECT repo_id, path FROM (SELECT source AS repo_id, {_REPO_PATH} AS path, doc_id % 5 AS m,
        CAST(substr(source, 4) AS INT) AS n FROM documents)
        WHERE CASE m WHEN 0 THEN n % 5 <> 0 WHEN 1 THEN TRUE WHEN 2 THEN n % 3 <> 0 OR n % 2 = 0
            WHEN 3 THEN n % 3 <> 0 ELSE n % 7 = 0 END""",
)
def _(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    repos = docs.selectExpr("source AS repo_id", "CAST(substr(source, 4) AS INT) AS n").distinct()
    patterns = ignore.ignore_lines(repos.selectExpr("repo_id", f"{_REPO_FILE} AS content"))
    return ignore.filter_ignored(docs.selectExpr("source AS repo_id", f"{_REPO_PATH} AS path"), patterns)


_PRUNE_PATH = (
    "CASE doc_id % 4 WHEN 0 THEN 'out/' || doc_id || '/keep.py' WHEN 1 THEN 'in/' || doc_id || '/keep.py' "
    "WHEN 2 THEN 'tmp2' || doc_id || '/a.py' ELSE 'tmp1' || doc_id || '/a.py' END"
)


@register("directory_pruning", f"SELECT {_PRUNE_PATH} AS path FROM documents WHERE doc_id % 4 IN (1, 3)")
def _(spark, sf_dir):
    return ignore.filter_ignored(
        _documents(spark, sf_dir).selectExpr(f"{_PRUNE_PATH} AS path"),
        extra=["out/", "!keep.py", "tmp*/", "!tmp1*/"],
    )


@register(
    "relative_path",
    """SELECT '/data/' || source || '/' || lang || '/' || doc_id AS full_path,
        CASE WHEN doc_id % 3 = 0 THEN '/data/' || source || '/' || lang || '/' || doc_id
             ELSE lang || '/' || doc_id END AS rel_path, CAST(doc_id AS VARCHAR) AS file_name FROM documents""",
)
def _(spark, sf_dir):
    paths = _documents(spark, sf_dir).selectExpr(
        "'/data/' || source || '/' || lang || '/' || doc_id AS full_path",
        "CASE WHEN doc_id % 3 = 0 THEN '/elsewhere' ELSE '/data/' || source || '/' END AS base",
    )
    return paths.selectExpr(
        "full_path",
        f"{corpus.relative_path('full_path', 'base')} AS rel_path",
        f"{corpus.relative_path('full_path')} AS file_name",
    )


@register("size_and_blank_skips", over("code", "SELECT path, skip_reason FROM f WHERE skip_reason IS NOT NULL"))
def _(spark, sf_dir):
    return corpus.admit(cp.files(spark, sf_dir, "code")).where("skip_reason IS NOT NULL").select("path", "skip_reason")


@register("admitted_text", over("pages", "SELECT path, md5(content) AS digest FROM f WHERE skip_reason IS NULL"))
def _(spark, sf_dir):
    admitted = corpus.admit(cp.files(spark, sf_dir, "pages")).where("skip_reason IS NULL")
    return admitted.select("path", F.md5("text").alias("digest"))


@register(
    "text_decode",
    """SELECT doc_id, md5(text || chr(65533) || 'end') AS digest, length(text) + 4 AS n_chars FROM documents""",
)
def _(spark, sf_dir):
    raw = _documents(spark, sf_dir).selectExpr(
        "doc_id",
        "concat(CAST(replace(text, chr(10), chr(13) || chr(10)) AS BINARY), unhex('FFC0'), unhex('EFBFBD'), "
        "CAST('end' AS BINARY), unhex('E282')) AS content",
    )
    return raw.selectExpr("doc_id", f"{tx.unify_newlines(tx.decode_utf8('content'))} AS text").select(
        "doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars")
    )


@register("file_status", over("code", "SELECT path, status FROM f"))
def _(spark, sf_dir):
    return _results(spark, sf_dir).select("path", "status")


@register("language_dispatch", over("code", "SELECT path, is_py_ext, is_py, parse_status FROM f WHERE skip_reason IS NULL"))
def _(spark, sf_dir):
    return (
        _parsed(spark, sf_dir, "code")
        .where("skip_reason IS NULL")
        .select("path", "is_py_ext", "is_py", F.col("parse_status").alias("parse_status"))
    )


# Lines and syntax facts -------------------------------------------------------


@register("line_split", over("documents", "SELECT path, line_no, md5(raw) AS digest FROM lines"))
def _(spark, sf_dir):
    rows = lines.line_table(corpus.admit(cp.files(spark, sf_dir, "documents")), "path")
    return rows.select("path", "line_no", F.md5("line").alias("digest"))


def _line_counts(name: str):
    @register(f"line_counts_{name}", over(name, "SELECT path, CAST(n_lines AS BIGINT) AS n_lines, CAST(nonblank AS BIGINT) AS nonblank, CAST(n_hash AS BIGINT) AS n_hash FROM line_m"))
    def _(spark, sf_dir):
        return (
            _lined(spark, sf_dir, name)
            .where("text IS NOT NULL")
            .select(
                "path",
                F.size("lines").cast("long").alias("n_lines"),
                F.expr(lines.nonblank_count("lines")).cast("long").alias("nonblank"),
                F.expr(lines.hash_start_count("hash_lines")).cast("long").alias("n_hash"),
            )
        )


for _name in ("documents", "pages", "turns", "annotated"):
    _line_counts(_name)


@register(
    "function_facts",
    over(
        "code",
        """SELECT path, pos, name, is_async, n_args, md5(types) AS fingerprint, body AS body_types, n_body, has_doc,
        doc_lines, only_stub, raises_nie FROM funs""",
    ),
)
def _(spark, sf_dir):
    rows = syntax.function_table(_parsed(spark, sf_dir, "code"), "path")
    return rows.withColumn("body_types", F.array_join("body_types", "|")).withColumnRenamed("has_docstring", "has_doc")


@register(
    "name_facts",
    over(
        "code",
        """SELECT path, name, kind, count(*) AS n FROM (SELECT path, name, kind FROM vars
        UNION ALL SELECT path, name, 'store' FROM vars WHERE kind = 'target') GROUP BY path, name, kind""",
    ),
)
def _(spark, sf_dir):
    rows = syntax.name_table(_parsed(spark, sf_dir, "code"), "path")
    return rows.groupBy("path", "name", "kind").agg(F.count(F.lit(1)).alias("n"))


@register("import_facts", over("code", "SELECT path, module FROM imps"))
def _(spark, sf_dir):
    return syntax.import_table(_parsed(spark, sf_dir, "code"), "path").select("path", "module")


@register("docstring_facts", over("code", "SELECT path, owner, md5(text) AS digest, n_lines FROM docs"))
def _(spark, sf_dir):
    rows = syntax.docstring_table(_parsed(spark, sf_dir, "code"), "path")
    return rows.select("path", "owner", F.md5("text").alias("digest"), "n_lines")


@register(
    "call_facts",
    over("code", "SELECT path, base, coalesce(attr, '') AS attr, shell_true, count(*) AS n FROM calls GROUP BY ALL"),
)
def _(spark, sf_dir):
    rows = syntax.call_table(_parsed(spark, sf_dir, "code"), "path")
    return rows.groupBy("path", "base", F.coalesce("attr", F.lit("")).alias("attr"), "shell_true").agg(
        F.count(F.lit(1)).alias("n")
    )


@register("assert_facts", over("code", "SELECT path, CAST(n_asserts AS BIGINT) AS n_asserts FROM sums WHERE n_asserts > 0"))
def _(spark, sf_dir):
    counts = _parsed(spark, sf_dir, "code").select("path", _long("n_asserts").alias("n_asserts"))
    return counts.where("n_asserts > 0")


# Repetitive -------------------------------------------------------------------


@register("duplicate_structures", over("code", "SELECT path, CAST(pos AS BIGINT) AS pos, names FROM dup"))
def _(spark, sf_dir):
    groups = _parsed(spark, sf_dir, "code").selectExpr(
        "path", f"inline({repetitive.duplicate_structures('functions')})"
    )
    return groups.select("path", _long("pos").alias("pos"), F.array_join("values", ", ").alias("names"))


@register("same_body_patterns", over("code", "SELECT path, CAST(pos AS BIGINT) AS pos, names FROM same"))
def _(spark, sf_dir):
    groups = _parsed(spark, sf_dir, "code").selectExpr(
        "path", f"inline({repetitive.same_body_patterns('functions')})"
    )
    return groups.select("path", _long("pos").alias("pos"), F.array_join("values", ", ").alias("names"))


def _blocks(name: str):
    @register(f"repeated_blocks_{name}", over(name, "SELECT path, block, positions FROM blocks"))
    def _(spark, sf_dir):
        rows = lines.line_table(corpus.admit(cp.files(spark, sf_dir, name)), "path")
        found = repetitive.repeated_block_table(rows, "path")
        return found.select("path", "block", F.array_join(F.col("positions").cast("array<string>"), ", ").alias("positions"))

    @register(f"repeated_blocks_in_row_{name}", over(name, "SELECT path, CAST(pos AS BIGINT) AS pos, positions FROM blocks"))
    def _(spark, sf_dir):
        groups = _lined(spark, sf_dir, name).selectExpr("path", f"inline({repetitive.repeated_blocks('lines')})")
        return groups.select(
            "path", _long("pos").alias("pos"), F.array_join(F.col("values").cast("array<string>"), ", ").alias("positions")
        )


for _name in ("documents", "code", "pages"):
    _blocks(_name)


# Detector measures and scores -------------------------------------------------


@register(
    "generic_variables",
    over("code", "SELECT path, string_agg(name, ', ' ORDER BY pos) AS names FROM gen_vars WHERE path IN (SELECT path FROM nam_m WHERE by_names) GROUP BY path"),
)
def _(spark, sf_dir):
    found = _analyzed(spark, sf_dir, "code", "nam").where(F.size("nam_generic_variables") > 0)
    return found.select("path", F.array_join("nam_generic_variables", ", ").alias("names"))


@register(
    "generic_functions",
    over("code", "SELECT path, string_agg(name, ', ' ORDER BY pos) AS names FROM gen_funs WHERE path IN (SELECT path FROM nam_m WHERE by_names) GROUP BY path"),
)
def _(spark, sf_dir):
    found = _analyzed(spark, sf_dir, "code", "nam").where(F.size("nam_generic_functions") > 0)
    return found.select("path", F.array_join("nam_generic_functions", ", ").alias("names"))


@register(
    "single_letters",
    over("code", "SELECT path, string_agg(name, ', ' ORDER BY name) AS names FROM letters WHERE path IN (SELECT path FROM nam_m WHERE by_names) GROUP BY path"),
)
def _(spark, sf_dir):
    found = _analyzed(spark, sf_dir, "code", "nam").where(F.size("nam_single_letters") > 0)
    return found.select("path", F.array_join(F.sort_array("nam_single_letters"), ", ").alias("names"))


@register(
    "text_naming",
    over("annotated", "SELECT path, CAST(pos AS BIGINT) AS family, array_to_string(found, ', ') AS words FROM families WHERE len(found) > 0"),
)
def _(spark, sf_dir):
    words = F.array(*(F.col(f"nam_words_{k}") for k in range(len(fixed.TEXT_NAMING_PATTERNS))))
    rows = _analyzed(spark, sf_dir, "annotated", "nam").select("path", F.posexplode(words).alias("family", "found"))
    return rows.where(F.size("found") > 0).select("path", _long("family").alias("family"), F.array_join("found", ", ").alias("words"))


def _comment_queries(name: str):
    @register(f"comment_lines_{name}", over(name, "SELECT path, line_no, md5(text) AS digest FROM com"))
    def _(spark, sf_dir):
        rows = _lined(spark, sf_dir, name).selectExpr("path", f"inline({comments.comment_lines('hash_lines')})")
        return rows.select("path", "line_no", F.md5("text").alias("digest"))

    @register(
        f"comment_labels_{name}",
        over(name, "SELECT path, line_no, coalesce(label, '') AS label, narrative FROM com_l WHERE label IS NOT NULL OR narrative"),
    )
    def _(spark, sf_dir):
        rows = _lined(spark, sf_dir, name).selectExpr("path", f"inline({comments.comment_lines('hash_lines')})")
        labelled = rows.select(
            "path", "line_no",
            F.coalesce(F.expr(comments.obvious_label("text")), F.lit("")).alias("label"),
            F.expr(comments.is_narrative("text")).alias("narrative"),
        )
        return labelled.where("label <> '' OR narrative")

    @register(
        f"comment_measures_{name}",
        over(
            name,
            """SELECT path, CAST(n AS BIGINT) AS n_comments, CAST(n_obvious AS BIGINT) AS n_obvious,
            CAST(n_narrative AS BIGINT) AS n_narrative, CAST(run AS BIGINT) AS longest_run, score
            FROM com_m JOIN com_s USING (path)""",
        ),
    )
    def _(spark, sf_dir):
        detector = builtin_detectors(only=["comments"])
        measured = plan.with_measures(_lined(spark, sf_dir, name), detector).where("text IS NOT NULL")
        return measured.select(
            "path",
            _long("com_count").alias("n_comments"),
            F.size("com_obvious").cast("long").alias("n_obvious"),
            _long("com_narrative").alias("n_narrative"),
            _long("com_run").alias("longest_run"),
            F.expr(comments.SCORE).alias("score"),
        )


for _name in ("documents", "turns", "annotated", "code"):
    _comment_queries(_name)


@register("unknown_imports", over("code", "SELECT path, module FROM unknown"))
def _(spark, sf_dir):
    rows = syntax.import_table(_parsed(spark, sf_dir, "code").where("is_py"), "path")
    known = spark.createDataFrame([(m,) for m in imports.known_modules()], "module string")
    return imports.unknown_imports(rows, known).select("path", "module")


@register("suspicious_imports", over("code", "SELECT path, module, invented FROM unknown"))
def _(spark, sf_dir):
    rows = _analyzed(spark, sf_dir, "code", "imp").select("path", F.explode("imp_unknown").alias("module"))
    return rows.withColumn("invented", F.expr(imports.looks_invented("module")))


@register(
    "installed_imports",
    over("code", "SELECT path, CAST(count(*) FILTER (NOT invented AND module <> 'zzlocal') AS BIGINT) AS unresolvable FROM unknown GROUP BY path"),
)
def _(spark, sf_dir):
    detector = builtin_detectors(installed=["zzlocal"], only=["imports"])
    found = plan.with_measures(_parsed(spark, sf_dir, "code"), detector).where(F.size("imp_unknown") > 0)
    return found.select("path", F.size("imp_unresolvable").cast("long").alias("unresolvable"))


def _marker_queries(name: str):
    @register(f"marker_lines_{name}", over(name, "SELECT path, line_no, label, md5(left(line, 80)) AS digest FROM marks"))
    def _(spark, sf_dir):
        rows = _lined(spark, sf_dir, name).selectExpr("path", f"inline({placeholders.marker_lines('hash_lines')})")
        return rows.select(
            "path", "line_no", F.expr(placeholders.marker_label("text")).alias("label"),
            F.md5(F.left("text", F.lit(80))).alias("digest"),
        )


for _name in ("annotated", "code"):
    _marker_queries(_name)


@register("marker_summary", over("code", "SELECT path, label, CAST(n AS BIGINT) AS n FROM mark_l"))
def _(spark, sf_dir):
    rows = _lined(spark, sf_dir, "code").selectExpr(
        "path", f"inline({placeholders.label_counts(placeholders.marker_lines('hash_lines'))})"
    )
    return rows.select("path", "label", _long("n").alias("n"))


@register(
    "stub_functions",
    over("code", "SELECT path, docstring_only, pass_only, not_implemented FROM pla_m WHERE docstring_only + pass_only + not_implemented > 0"),
)
def _(spark, sf_dir):
    size = lambda c: F.size(f"pla_{c}").cast("long").alias(c)
    counts = _analyzed(spark, sf_dir, "code", "pla").select(
        "path", size("docstring_only"), size("pass_only"), size("not_implemented")
    )
    return counts.where("docstring_only + pass_only + not_implemented > 0")


@register(
    "documentation_measures",
    over(
        "code",
        """SELECT path, coalesce(mode, '') AS mode, CAST(n_hash AS BIGINT) AS n_comments,
        CASE WHEN mode = 'docs' THEN CAST(doc_lines AS BIGINT) ELSE -1 END AS doc_lines,
        CASE WHEN mode = 'docs' THEN CAST(n_boiler AS BIGINT) ELSE -1 END AS boilerplate,
        CASE WHEN mode = 'docs' THEN CAST(n_long AS BIGINT) ELSE -1 END AS long_docs FROM rat_m""",
    ),
)
def _(spark, sf_dir):
    count = lambda c, name: F.coalesce(_long(c), F.lit(-1)).alias(name)
    return _analyzed(spark, sf_dir, "code", "rat").select(
        "path",
        F.coalesce("rat_mode", F.lit("")).alias("mode"),
        _long("rat_comments").alias("n_comments"),
        count("rat_doc_lines", "doc_lines"),
        count("rat_boilerplate", "boilerplate"),
        count("rat_long_docs", "long_docs"),
    )


@register("code_line_counts", over("code", "SELECT path, CAST(n_code AS BIGINT) AS n_code FROM rat_m WHERE mode = 'docs'"))
def _(spark, sf_dir):
    rows = _prepared(spark, sf_dir, "code").where(F.col("is_py") & (F.col("parse_status") == "ok"))
    return rows.select("path", F.expr(ratio.code_line_count("lines")).cast("long").alias("n_code"))


def _pattern_queries(kind: str, name: str, rules, counts):
    @register(
        f"{kind}_scan_{name}",
        over(name, f"SELECT path, label, CAST(n AS BIGINT) AS n FROM hits WHERE kind = {q(kind)} AND n > 0"),
    )
    def _(spark, sf_dir):
        text = tx.derive(corpus.admit(cp.files(spark, sf_dir, name)), {"folded": tx.fold_case("text")})
        pairs = [
            tx.row({"label": literal(label), "n": f"CAST({n} AS BIGINT)"})
            for (_, label), n in zip(rules, counts("text", "folded"))
        ]
        return text.selectExpr("path", f"inline(array({', '.join(pairs)}))").where("n > 0")


for _name in ("documents", "pages", "turns", "annotated"):
    _pattern_queries("secret", _name, fixed.SECRET_PATTERNS, security.secret_counts)
_pattern_queries("sql", "code", fixed.SQL_INJECTION_PATTERNS, security.sql_counts)


@register(
    "dangerous_calls",
    over("code", "SELECT path, evals, shells, loads, CAST(n_asserts AS BIGINT) AS n_asserts FROM sec_m WHERE evals + shells + loads + n_asserts > 0"),
)
def _(spark, sf_dir):
    size = lambda c: F.size(f"sec_{c}").cast("long").alias(c)
    counts = _analyzed(spark, sf_dir, "code", "sec").select(
        "path", *(size(kind) for kind, _ in CALL_KINDS), _long("sec_asserts").alias("n_asserts")
    )
    return counts.where("evals + shells + loads + n_asserts > 0")


def _detector_queries(name: str, detector: str):
    short = SHORT[detector]

    @register(f"{detector}_score_{name}", over(name, f"SELECT path, score FROM {short}_s JOIN f USING (path) WHERE status = 'analyzed'"))
    def _(spark, sf_dir):
        only = builtin_detectors(only=[detector])
        found = plan.detect(cp.files(spark, sf_dir, name), only)
        return found.where("status = 'analyzed'").select("path", F.col(f"{detector}_score").alias("score"))

    @register(
        f"{detector}_findings_{name}",
        over(
            name,
            f"""SELECT path, string_agg(finding, chr(10) ORDER BY grp, pos) AS findings FROM {short}_f
            JOIN f USING (path) WHERE status = 'analyzed' GROUP BY path""",
        ),
    )
    def _(spark, sf_dir):
        only = builtin_detectors(only=[detector])
        found = plan.detect(cp.files(spark, sf_dir, name), only).where(F.size(f"{detector}_findings") > 0)
        return found.select("path", F.array_join(f"{detector}_findings", "\n").alias("findings"))


for _detector in fixed.DETECTORS:
    _detector_queries("code", _detector)
    _detector_queries("annotated", _detector)


# File and repository scores ---------------------------------------------------

_SCORED = f"SELECT repo_id, path, final_score, label, color, {', '.join(fixed.DETECTORS)} FROM results WHERE status = 'analyzed'"
_REPO_LABELS = " ".join(f"WHEN repo_score >= {b[0]} THEN {q(b[1])}" for b in fixed.SCORE_BANDS)
_SUMMARY = f"SELECT *, CASE {_REPO_LABELS} END AS repo_label FROM summary"


def _score_queries(name: str):
    @register(f"file_scores_{name}", over(name, _SCORED))
    def _(spark, sf_dir):
        results = _results(spark, sf_dir, name)
        return results.where("status = 'analyzed'").select("repo_id", "path", "final_score", "label", "color", "raw.*")

    @register(f"repo_summary_{name}", over(name, _SUMMARY))
    def _(spark, sf_dir):
        return rollup.repo_summary(_results(spark, sf_dir, name))


for _name in ("code", "annotated"):
    _score_queries(_name)


@register(
    "weighted_contributions",
    over(
        "code",
        "SELECT path, "
        + ", ".join(f"{n} * {w}::DOUBLE AS {n}" for n, w in fixed.DETECTOR_WEIGHTS.items())
        + " FROM results WHERE status = 'analyzed'",
    ),
)
def _(spark, sf_dir):
    return _results(spark, sf_dir).where("status = 'analyzed'").select("path", "weighted.*")


_LABELS = " ".join(f"WHEN final_score >= {b[0]} THEN {q(b[1])}" for b in fixed.SCORE_BANDS)


@register("label_counts", over("code", f"SELECT CASE {_LABELS} END AS label, count(*) AS n FROM results WHERE status = 'analyzed' GROUP BY 1"))
def _(spark, sf_dir):
    return _results(spark, sf_dir).where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register(
    "partial_detector_scores",
    over(
        "code",
        """SELECT path, CAST(round_even((0::DOUBLE + naming * 0.15::DOUBLE + comments * 0.1::DOUBLE)
        / (0.15::DOUBLE + 0.1::DOUBLE) * 100, 0) AS INT) AS final_score FROM results WHERE status = 'analyzed'""",
    ),
)
def _(spark, sf_dir):
    some = builtin_detectors(only=["naming", "comments"])
    return plan.score_files(cp.files(spark, sf_dir, "code"), some).where("status = 'analyzed'").select("path", "final_score")


@register(
    "threshold_filter",
    over("code", "SELECT path, status, coalesce(final_score, -1) AS final_score FROM results WHERE status <> 'analyzed' OR final_score >= 20"),
)
def _(spark, sf_dir):
    kept = plan.at_least(_results(spark, sf_dir), 20)
    return kept.select("path", "status", F.coalesce("final_score", F.lit(-1)).alias("final_score"))


@register(
    "summary_above_threshold",
    over(
        "code",
        """SELECT repo_id, count(*) AS total_files, count(final_score) AS analyzed_files FROM results
        WHERE status <> 'analyzed' OR final_score >= 20 GROUP BY repo_id""",
    ),
)
def _(spark, sf_dir):
    summary = rollup.repo_summary(plan.at_least(_results(spark, sf_dir), 20))
    return summary.select("repo_id", "total_files", "analyzed_files")


@register(
    "ranked_files",
    over(
        "code",
        """SELECT row_number() OVER (ORDER BY CASE WHEN status = 'analyzed' THEN 0 ELSE 1 END,
        coalesce(final_score, 0) DESC, repo_id, path) AS file_rank, repo_id, path FROM results""",
    ),
)
def _(spark, sf_dir):
    folder = scratch(spark)
    stored = reports.store(_results(spark, sf_dir), f"{folder}/results")
    return plan.numbered(stored, f"{folder}/ranked").select("file_rank", "repo_id", "path")


@register("quality_gate", over("code", f"SELECT repo_id, high_risk_files > 0 AS failed FROM summary"))
def _(spark, sf_dir):
    return rollup.quality_gate(_results(spark, sf_dir))


@register(
    "all_findings",
    over("code", "SELECT path, array_to_string(findings, chr(10)) AS findings FROM results WHERE len(findings) > 0"),
)
def _(spark, sf_dir):
    found = _results(spark, sf_dir).where(F.size("findings") > 0)
    return found.select("path", F.array_join("findings", "\n").alias("findings"))


# Reports ----------------------------------------------------------------------

# What the parser says of a file that is nested too deep for it.
TOO_DEEP = "analysis error: Parser stack overflowed - Python source too complex to parse"


@register(
    "file_table",
    over("annotated", "SELECT repo_id, path, final_score, label, coalesce(left(findings[1], 60), '') AS top_finding FROM results WHERE status = 'analyzed'"),
)
def _(spark, sf_dir):
    return reports.file_table(_results(spark, sf_dir, "annotated"))


@register(
    "detail_rows",
    over(
        "code",
        f"""SELECT repo_id, path, final_score, file_rank, finding_no, findings[finding_no] AS finding FROM (
        SELECT *, unnest(range(1, least(8, len(findings)) + 1)) AS finding_no FROM (SELECT *, row_number() OVER (
            PARTITION BY repo_id ORDER BY final_score DESC, path) AS file_rank FROM results
            WHERE final_score >= {fixed.MEDIUM_RISK} AND len(findings) > 0) WHERE file_rank <= 10)""",
    ),
)
def _(spark, sf_dir):
    rows = reports.detail_rows(_results(spark, sf_dir))
    return rows.withColumns({c: _long(c) for c in ("file_rank", "finding_no")})


@register(
    "error_rows",
    over(
        "code",
        f"""SELECT repo_id, path, file_rank, {q(TOO_DEEP)} AS error FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path)
        AS file_rank FROM results WHERE status = 'error') WHERE file_rank <= 5""",
    ),
)
def _(spark, sf_dir):
    rows = reports.error_rows(_results(spark, sf_dir))
    return rows.select("repo_id", "path", _long("file_rank").alias("file_rank"), "error")


_ROUNDED = ", ".join(f"CASE WHEN status = 'analyzed' THEN CAST(printf('%.3f', {n}) AS DOUBLE) END AS {n}" for n in fixed.DETECTORS)


@register(
    "json_rows",
    over(
        "code",
        f"""SELECT repo_id, path, coalesce(final_score, 0) AS vibe_score, status = 'skipped' AS skipped,
        coalesce(skip_reason, '') AS skip_reason, coalesce(label, '') AS score_label,
        array_to_string(findings, chr(10)) AS findings,
        CASE WHEN status = 'error' THEN '{TOO_DEEP}' ELSE '' END AS error,
        {_ROUNDED} FROM results""",
    ),
)
def _(spark, sf_dir):
    rows = reports.json_rows(_results(spark, sf_dir))
    return rows.select(
        "repo_id", "path", "vibe_score", "skipped", "skip_reason",
        F.coalesce("score_label", F.lit("")).alias("score_label"),
        F.coalesce(F.array_join("findings", "\n"), F.lit("")).alias("findings"),
        F.coalesce("error", F.lit("")).alias("error"),
        *(F.col(f"detector_scores.{n}").alias(n) for n in fixed.DETECTORS),
    )


_CARD_SCORES = " || ' ' || ".join(f"'{n}=' || CAST(CAST(trunc({n} * 100) AS INT) AS VARCHAR)" for n in sorted(fixed.DETECTORS))


@register(
    "detail_cards",
    over(
        "annotated",
        f"""SELECT repo_id, path, final_score, label, CAST(len(findings) AS BIGINT) AS n_findings,
        array_to_string(findings[1:6], chr(10)) || CASE WHEN len(findings) > 6
            THEN chr(10) || '...and ' || (len(findings) - 6) || ' more findings' ELSE '' END AS shown,
        {_CARD_SCORES} AS percents FROM results WHERE status = 'analyzed'""",
    ),
)
def _(spark, sf_dir):
    cards = reports.detail_cards(_results(spark, sf_dir, "annotated"))
    return cards.select(
        *corpus.KEYS, "final_score", "label", _long("n_findings").alias("n_findings"),
        F.array_join("shown", "\n").alias("shown"),
        F.array_join(F.transform("detectors", lambda d: F.concat_ws("=", d["detector"], d["percent"].cast("string"))), " ").alias("percents"),
    )


_TIME = "2026-01-02T03:04:05.678901Z"
_JSON_SCORES = " || ',' || ".join(f"""'"{n}":' || CAST({n} AS VARCHAR)""" for n in fixed.DETECTORS)
_JSON_ENTRY = f"""'{{"path":' || to_json(path) || ',"vibe_score":' || coalesce(final_score, 0) || ',"skipped":' || (status = 'skipped')
    || ',"skip_reason":' || to_json(coalesce(skip_reason, '')) || CASE WHEN status = 'error' THEN ',"error":' || to_json({q(TOO_DEEP)}) ELSE '' END
    || CASE WHEN status = 'analyzed' THEN ',"score_label":' || to_json(label) || ',"detector_scores":{{' || {_JSON_SCORES} || '}}' ELSE '' END
    || CASE WHEN len(findings) > 0 THEN ',"findings":' || to_json(findings) ELSE '' END || '}}'"""
_JSON_SUMMARY = " || ',' || ".join(
    f"""'"{shown}":' || {name}"""
    for shown, name in {
        **{n: n for n in ("total_files", "analyzed_files", "skipped_files", "error_files")},
        "repo_vibe_score": "repo_score",
        **{n: n for n in ("average_score", "high_risk_files", "medium_risk_files")},
    }.items()
)


def _digest(mark: Column) -> Column:
    """Sum of marks; where it passes a long, as marks of 48 bits may from 65,536 on, what is left of it modulo 2**63."""
    return (F.sum(mark.cast("decimal(20, 0)")) % F.lit(Decimal(1 << 63))).cast("long")


@register(
    "json_documents",
    over(
        "code",
        f"""SELECT repo_id, CAST(count(*) AS BIGINT) AS pieces, CAST(sum(('0x' || left(md5(n || ':' || piece), 12))::BIGINT) AS BIGINT) AS digest FROM (
        SELECT repo_id, 1 AS n, '{{"scan_path":' || to_json(repo_id) || ',"timestamp":"{_TIME}","summary":{{' || {_JSON_SUMMARY} || '}},"files":[' AS piece
        FROM summary
        UNION ALL SELECT repo_id, n + 1, CASE WHEN n > 1 THEN ',' ELSE '' END || {_JSON_ENTRY} FROM (
            SELECT repo_id, path, status, skip_reason, final_score, label, findings, {{rounded}}, row_number() OVER (
                PARTITION BY repo_id ORDER BY status <> 'analyzed', -coalesce(final_score, 0), path) AS n FROM results)
        UNION ALL SELECT repo_id, total_files + 2, ']}}' FROM summary) GROUP BY repo_id""".replace("{rounded}", _ROUNDED),
    ),
)
def _(spark, sf_dir):
    folder = scratch(spark)
    stored = reports.store(_results(spark, sf_dir), f"{folder}/results")
    pieces = reports.json_documents(stored, f"{folder}/pieces", F.lit(_TIME))
    mark = F.conv(F.left(F.md5(F.concat_ws(":", "piece_no", "piece")), F.lit(12)), 16, 10).cast("long")
    return pieces.groupBy("repo_id").agg(F.count(F.lit(1)).alias("pieces"), _digest(mark).alias("digest"))


@register(
    "report_files",
    over(
        "code",
        """SELECT s.repo_id, repo_score, high_risk_files, count(*) AS files, CAST(sum(coalesce(final_score, 0)) AS BIGINT) AS scores
        FROM summary s JOIN results r ON s.repo_id = r.repo_id GROUP BY ALL""",
    ),
)
def _(spark, sf_dir):
    folder = scratch(spark)
    stored = reports.store(_results(spark, sf_dir), f"{folder}/results")
    reports.write_reports(stored, f"{folder}/report")
    files = spark.read.json(f"{folder}/report/files").groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("vibe_score").alias("scores")
    )
    return spark.read.json(f"{folder}/report/summary").select("repo_id", "repo_score", "high_risk_files").join(files, "repo_id")


_REPLACED = "repo_id IN ('src1', 'src2', 'src3')"
_KEPT = f"NOT {_REPLACED} OR status <> 'analyzed' OR final_score >= 30"


def _replaced(spark, sf_dir) -> str:
    """Reports of all repositories, then three of them put in again from higher scores alone; the folder."""
    folder = scratch(spark)
    stored = reports.store(_results(spark, sf_dir), f"{folder}/results")
    reports.replace_repositories(stored, f"{folder}/report")
    reports.replace_repositories(plan.at_least(stored, 30).where(_REPLACED), f"{folder}/report")
    return f"{folder}/report"


@register(
    "replaced_report_files",
    over(
        "code",
        f"""SELECT repo_id, path, coalesce(final_score, 0) AS vibe_score, status = 'skipped' AS skipped, coalesce(skip_reason, '') AS skip_reason,
        label AS score_label, CASE WHEN len(findings) > 0 THEN array_to_string(findings, chr(10)) END AS findings,
        CASE WHEN status = 'error' THEN '{TOO_DEEP}' END AS error, {_ROUNDED} FROM results WHERE {_KEPT}""",
    ),
)
def _(spark, sf_dir):
    rows = reports.read_files(spark, _replaced(spark, sf_dir), list(fixed.DETECTORS))
    return rows.select(*rows.columns).withColumn("findings", F.array_join("findings", "\n")).select(
        *(c for c in rows.columns if c != "detector_scores"), "detector_scores.*"
    )


@register("replaced_report_summary", over("code", f"SELECT *, CASE {_REPO_LABELS} END AS repo_label FROM summary").replace("FROM results GROUP BY repo_id", f"FROM results WHERE {_KEPT} GROUP BY repo_id"))
def _(spark, sf_dir):
    return spark.read.parquet(f"{_replaced(spark, sf_dir)}/summary")


# Extension --------------------------------------------------------------------


@register(
    "detector_rows",
    over(
        "code",
        " UNION ALL ".join(f"SELECT path, {q(n)} AS detector, {n} AS score FROM scores" for n in fixed.DETECTORS),
    ),
)
def _(spark, sf_dir):
    return plan.detector_rows(plan.detect(cp.files(spark, sf_dir, "code"))).select("path", "detector", "score")


@register("long_form_scores", over("code", "SELECT repo_id, path, final_score, label FROM results WHERE status = 'analyzed'"))
def _(spark, sf_dir):
    rows = plan.detector_rows(plan.detect(cp.files(spark, sf_dir, "code")))
    return sc.score_long_form(rows, *corpus.KEYS)


_SIX = " + ".join(f"{n} * {w}::DOUBLE" for n, w in fixed.DETECTOR_WEIGHTS.items())


@register(
    "custom_detector",
    over(
        "code",
        f"""SELECT path, CAST(round_even((0::DOUBLE + {_SIX} + least(1::DOUBLE, nonblank / 100.0::DOUBLE) * 0.05::DOUBLE)
        / (1.0::DOUBLE + 0.05::DOUBLE) * 100, 0) AS INT) AS final_score
        FROM results JOIN line_m USING (path) WHERE status = 'analyzed'""",
    ),
)
def _(spark, sf_dir):
    length = Detector(
        "length",
        score="least(1.0D, len_nonblank / 100.0D)",
        measures=[{"len_nonblank": lines.nonblank_count("lines")}],
    )
    results = plan.score_files(cp.files(spark, sf_dir, "code"), [*builtin_detectors(), length])
    return results.where("status = 'analyzed'").select("path", "final_score")


_FRAME_SCORED = """SELECT repo_id, path, CAST(round_even((0::DOUBLE + {six} + coalesce(common, 0::DOUBLE) * 0.05::DOUBLE)
        / (1.0::DOUBLE + 0.05::DOUBLE) * 100, 0) AS INT) AS final_score, coalesce(common, 0::DOUBLE) AS common, said
        FROM results LEFT JOIN (SELECT path, count(*) FILTER (n >= 10)::DOUBLE / count(*)::DOUBLE AS common,
            CASE WHEN count(*) FILTER (n >= 10) > 0 THEN 'common imports: ' || string_agg(module, ', ' ORDER BY module) FILTER (n >= 10) END AS said
            FROM (SELECT path, module, count(*) OVER (PARTITION BY module) AS n FROM imp_d) GROUP BY path) USING (path)
        WHERE status = 'analyzed'"""


def _common_imports(files: DataFrame) -> DataFrame:
    """Share of a file's imports that ten or more files have: needs all files at once, so it is a frame detector."""
    rows = files.where("is_py").select(*corpus.KEYS, F.explode(F.array_distinct("imports")).alias("module"))
    often = rows.groupBy("module").agg(F.count("*").alias("n"))
    met = rows.join(often, "module").groupBy(*corpus.KEYS).agg(
        (F.count_if(F.col("n") >= 10) / F.count("*")).alias("score"),
        F.array_sort(F.collect_list(F.expr("CASE WHEN n >= 10 THEN module END"))).alias("common"),
    )
    said = F.when(F.size("common") > 0, F.array(F.concat(F.lit("common imports: "), F.array_join("common", ", "))))
    return met.select(*corpus.KEYS, "score", said.alias("findings"))


@register("frame_detector", over("code", _FRAME_SCORED.format(six=_SIX)))
def _(spark, sf_dir):
    shared = FrameDetector("common", _common_imports)
    results = plan.score_files(cp.files(spark, sf_dir, "code"), [*builtin_detectors(), shared])
    own = F.filter("findings", lambda f: F.startswith(f, F.lit("common imports: ")))
    return results.where("status = 'analyzed'").select(*corpus.KEYS, "final_score", F.col("raw.common").alias("common"), F.get(own, F.lit(0)).alias("said"))


_HAS_LOCAL = "repo_id IN ('src1', 'src3', 'src5', 'src7')"


@register(
    "imports_score_tables",
    over(
        "code",
        f"""SELECT repo_id, path, CASE WHEN n = 0 THEN 0::DOUBLE ELSE least(1::DOUBLE, suspicious::DOUBLE / n::DOUBLE * 0.8::DOUBLE
            + unresolvable::DOUBLE / n::DOUBLE * 0.3::DOUBLE) END AS score, coalesce(said, '') AS said
        FROM (SELECT repo_id, path, (SELECT count(*) FROM imp_d d WHERE d.path = f.path) AS n,
            (SELECT count(*) FROM unknown d WHERE d.path = f.path AND invented) AS suspicious,
            (SELECT count(*) FROM unknown d WHERE d.path = f.path AND NOT invented AND NOT (module = 'zzlocal' AND {_HAS_LOCAL})) AS unresolvable,
            (SELECT string_agg(module, ' ' ORDER BY invented DESC, module) FROM unknown d
                WHERE d.path = f.path AND (invented OR NOT (module = 'zzlocal' AND {_HAS_LOCAL}))) AS said
            FROM f WHERE status = 'analyzed')""",
    ),
)
def _(spark, sf_dir):
    known = imports.known_table(spark, "pinned").unionByName(spark.createDataFrame([("other", "zzlocal")], "version string, module string"))
    installed = _documents(spark, sf_dir).selectExpr("source AS repo_id", "'zzlocal' AS module").where(_HAS_LOCAL).distinct()
    found = plan.detect(cp.files(spark, sf_dir, "code"), [imports_from_tables(known, installed, "pinned")]).where("status = 'analyzed'")
    names = F.flatten(F.transform("imports_findings", lambda f: F.split(F.element_at(F.split(f, ": "), -1), ", ")))
    return found.select(*corpus.KEYS, F.col("imports_score").alias("score"), F.array_join(names, " ").alias("said"))
