"""Report tables and sinks over file results.

Reports sort and read the results more than once.  Score once, ``store`` the
results, and report from the stored table; sorting an unstored plan would run
the parse again for the range sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainscore import fixed_values as fixed
from grainscore.functions import text as tx
from grainscore.plans.rollup import repo_summary
from grainscore.plans.scoring import placed
from grainscore.sources.corpus import KEYS


def _analyzed() -> Column:
    return F.col("status") == "analyzed"


def _score() -> Column:
    return F.coalesce("final_score", F.lit(0))


def _order() -> list[Column]:
    """Order of files within a repository's report."""
    return [_analyzed().desc(), _score().desc(), F.col("path")]


def store(results: DataFrame, path: str) -> DataFrame:
    """Write results once as Parquet and return the stored table."""
    results.write.mode("overwrite").parquet(path)
    return results.sparkSession.read.parquet(path)


def file_table(results: DataFrame) -> DataFrame:
    """Analyzed files with score, label and the start of the first finding."""
    first = F.coalesce(F.left(F.get("findings", F.lit(0)), F.lit(60)), F.lit(""))
    return results.where(_analyzed()).select(*KEYS, "final_score", "label", first.alias("top_finding"))


def _first_per_repo(rows: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows of each repository; every task keeps only ``n`` per repository before the exchange."""
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(*_order()))
    return rows.withColumn("file_rank", rank).where(F.col("file_rank") <= n)


def detail_rows(results: DataFrame, files: int = 10, findings: int = 8) -> DataFrame:
    """First findings of the worst files of each repository, one row per finding."""
    risky = results.where((F.col("final_score") >= fixed.MEDIUM_RISK) & (F.size("findings") > 0))
    return (
        _first_per_repo(risky.select(*KEYS, "status", "final_score", F.slice("findings", 1, findings).alias("findings")), files)
        .select(*KEYS, "final_score", "file_rank", F.posexplode("findings").alias("_pos", "finding"))
        .select(*KEYS, "final_score", "file_rank", (F.col("_pos") + 1).alias("finding_no"), "finding")
    )


def error_rows(results: DataFrame, n: int = 5) -> DataFrame:
    """First error rows of each repository."""
    errors = results.where(F.col("status") == "error").select(*KEYS, "status", "final_score", "error")
    return _first_per_repo(errors, n).select(*KEYS, "file_rank", "error")


def json_rows(results: DataFrame, **extra: Column) -> DataFrame:
    """File entries of the JSON report; absent fields are NULL, which the JSON writer omits."""
    names = [f.name for f in results.schema["raw"].dataType.fields]
    rounded = F.expr(tx.row({n: tx.three_places(f"raw.{n}") for n in names}))
    return results.select(
        "repo_id",
        "path",
        _score().alias("vibe_score"),
        (F.col("status") == "skipped").alias("skipped"),
        F.coalesce("skip_reason", F.lit("")).alias("skip_reason"),
        "error",
        F.col("label").alias("score_label"),
        F.when(_analyzed(), rounded).alias("detector_scores"),
        F.when(F.size("findings") > 0, F.col("findings")).alias("findings"),
        *(c.alias(n) for n, c in extra.items()),
    )


def detail_cards(results: DataFrame, shown: int = 6) -> DataFrame:
    """Row data of the page report: findings shown, their number, percent per detector by name."""
    names = sorted(f.name for f in results.schema["raw"].dataType.fields)
    more = tx.listed(
        f"size(findings) > {shown}",
        tx.strings(f"concat('...and ', size(findings) - {shown}, ' more findings')"),
    )
    percents = ", ".join(tx.row({"detector": f"'{n}'", "percent": f"CAST(raw.{n} * 100 AS INT)"}) for n in names)
    return results.where(_analyzed()).selectExpr(
        *KEYS,
        "final_score",
        "label",
        "size(findings) AS n_findings",
        f"concat(slice(findings, 1, {shown}), {more}) AS shown",
        f"array({percents}) AS detectors",
    )


def _summary_json() -> Column:
    return F.struct(
        "total_files", "analyzed_files", "skipped_files", "error_files",
        F.col("repo_score").alias("repo_vibe_score"), "average_score", "high_risk_files", "medium_risk_files",
    )


def json_documents(stored: DataFrame, folder: str, timestamp: Column | None = None) -> DataFrame:
    """One JSON document per repository, as pieces ``(repo_id, piece_no, piece)``, by way of a table in ``folder``.

    Concatenating a repository's pieces by number (from 1) gives its document;
    ``timestamp`` is the time of the report, now by default.  All pieces are
    sorted once and get their places from the sort, and a file has a comma
    before it unless it stands right behind its document's opening.  So nothing
    depends on keys being unique or known: rows of one path, equal rows and
    files without a repository or path are entries of their own.  A document is
    never assembled in one row, and a large repository is spread over all tasks.
    """
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    entries = json_rows(stored, later=~_analyzed(), rank=-_score())
    shown = [c for c in entries.columns if c not in ("repo_id", "later", "rank")]
    files = entries.select("repo_id", F.lit(1).alias("section"), "later", "rank", "path", F.to_json(F.struct(*shown)).alias("piece"))
    summary = repo_summary(stored)
    time = F.coalesce(now if timestamp is None else timestamp, F.lit(""))
    head = F.to_json(F.struct(F.coalesce("repo_id", F.lit("")).alias("scan_path"), time.alias("timestamp"), _summary_json().alias("summary")))

    def frame(section: int, piece: Column) -> DataFrame:
        none = (F.lit(False).alias("later"), F.lit(0).alias("rank"), F.lit("").alias("path"))
        return summary.select("repo_id", F.lit(section).alias("section"), *none, piece.alias("piece"))

    opening = frame(0, F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"files":[')))
    pieces = opening.unionByName(files).unionByName(frame(2, F.lit("]}")))
    written = placed(pieces.orderBy("repo_id", "section", "later", "rank", "path", "piece"), folder, "place")
    # one row per repository
    starts = written.where("section = 0").select(F.col("repo_id").alias("of"), F.col("place").alias("start"))
    met = written.join(starts, F.col("repo_id").eqNullSafe(F.col("of")))
    follows = (F.col("section") == 1) & (F.col("place") > F.col("start") + 1)
    return met.select(
        "repo_id", (F.col("place") - F.col("start") + 1).alias("piece_no"), F.concat(F.when(follows, F.lit(",")).otherwise(F.lit("")), F.col("piece")).alias("piece")
    )


def write_json_documents(stored: DataFrame, path: str, timestamp: Column | None = None) -> None:
    """Write the documents below ``path/documents``, one folder per repository; parts in name order form the document."""
    pieces = json_documents(stored, f"{path}/pieces", timestamp).orderBy("repo_id", "piece_no")
    pieces.select("repo_id", "piece").write.mode("overwrite").partitionBy("repo_id").text(f"{path}/documents")


def _files_schema(detectors: list[str]) -> str:
    """Columns of the written ``files`` table; fixed, as a JSON reader can't tell the types of fields that are absent."""
    scores = ", ".join(f"{n}: double" for n in detectors)
    return (
        "path string, vibe_score int, skipped boolean, skip_reason string, error string, score_label string, "
        f"detector_scores struct<{scores}>, findings array<string>, repo_id string"
    )


def write_reports(stored: DataFrame, path: str, file_format: str = "json", by_repo: bool = False) -> None:
    """Write ``files`` and ``summary`` report tables below ``path``."""
    files = json_rows(stored).write.mode("overwrite").format(file_format)
    (files.partitionBy("repo_id") if by_repo else files).save(f"{path}/files")
    repo_summary(stored).write.mode("overwrite").format(file_format).save(f"{path}/summary")


def replace_repositories(stored: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Put the reports of the repositories in ``stored`` into the tables below ``path``; all others stay as they are.

    Both tables are partitioned by ``repo_id`` and overwritten partition by
    partition, so a re-score of one repository writes that repository alone.
    """
    for name, rows in (("files", json_rows(stored)), ("summary", repo_summary(stored))):
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.format(file_format).partitionBy("repo_id").save(f"{path}/{name}")


def read_files(spark: SparkSession, path: str, detectors: list[str], file_format: str = "parquet") -> DataFrame:
    """The written ``files`` table with all its columns, absent fields null."""
    return spark.read.format(file_format).schema(_files_schema(detectors)).load(f"{path}/files")
