"""A cleaning pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and
read again as the next stage's ``docs``.  All but the last return the columns
of ``documents``.  Null and empty texts go with the first stage, which rejects
texts without a letter; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainscore.llm import bpe, decontaminate, language, line_chunks, ngram_join
from grainscore.llm.shared import cut, temporary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognized, learned from those with a language."""
    return language.accepted(docs, language.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that stand in an earlier one.

    A document that loses lines and has no word left is dropped; one that loses
    none stays as it is, without words too.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = line_chunks.dedup(docs, carry=others).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long").alias("n_chars")}
    return kept.select(*(new.get(c, F.col("carried")[c].alias(c)) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the contract allows."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    return bpe.encode(docs, bpe.vocabulary(), digests=True)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: The language model is trained, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark) as keep:
        for _, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir))
        keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
