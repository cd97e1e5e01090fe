"""A training corpus from ``documents``: one stage after the other, each on all that the one before kept.

Null and empty texts have no language and leave with the first stage. Repeated
rows are one document for near-dedup. Extra columns of ``documents`` are passed
on by every stage but the last, which returns pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from funnelspark.llm import language_id, line_dedup, near_dedup, packing, secret_scan
from funnelspark.llm.common import materialize, read_table

#: Not to be had in SQL: language identification, line dedup and near-dedup work on hashes and learned models.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language."""
    return language_id.keep_identified(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that occurred before, and without those that lose all their text."""
    return line_dedup.drop_emptied(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group."""
    return near_dedup.keep_one_of_each_group(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("minhash_near_dedup", remove_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
