"""A corpus pipeline: five stages from raw documents to a mixed training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontaminate, line_dedup, mixing, quality, simhash
from tidemill.llm._base import forget, stored, table


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that stand earlier in the corpus."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for, numbered by ``copy``."""
    return mixing.repeat_documents(docs)


STAGES = [
    ("quality classifier", drop_rejected),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: The classifier, the chunk hashes and the fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            forget(spark, before)
        before = path
    return docs
