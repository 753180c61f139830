"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Lines and documents are told apart by doc_id: rows without an id, and rows that repeat one, are not compared with each
other and all stay, in every stage. Null and empty texts go in the first stage, as their language can't be told; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language_id, line_dedup, minhash, packing
from tidemark.llm.common import bounded_batches, crc_fold, materialize, restricted, table
from tidemark.llm.queries import tokenizer_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """A stage whose texts go to Python in small batches, as its workers go on to serve the next ones."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no text, or no letter in it."""
    model = language_id.train(docs, crc_fold("doc_id", 5) != 0)
    return language_id.identify(docs, model).where(F.col("lang_pred") != language_id.UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


@bounded
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; documents that lose every line go."""
    return line_dedup.dedup_lines(docs, least_tokens=1)


@bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, by 5-word shingles."""
    found = minhash.near_duplicates(docs, words=5)
    gone = materialize(found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("gone")).distinct(), "near-gone")
    return restricted(docs, gone, "doc_id", "left_anti")


@bounded
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.best_fit_pack(docs, tokenizer_path(), size=4096, end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack),
]

#: SQL can't express the learned and the tokenizing stages. tests/llm holds the near-duplicate and line stages against brute force, the others by their operators' tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
