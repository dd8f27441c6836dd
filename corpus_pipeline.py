"""A corpus pipeline of five operators: quality, exact and near duplicates, benchmark passages, packing.

Every stage takes the whole table its predecessor kept. The first four return rows of it with its columns; the last
returns packed pieces. Stages follow their operators for nulls, ties and empty tables. A stage's result is to be written
before the next one is called, which deletes the tables that the one before it staged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from tidewright.llm.common import discard, scratch, stage, table

_staged: list[str] = []


def tidy(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """step, which first deletes what the stage before it staged."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _staged)
        with scratch() as made:
            found = step(spark, docs, sf_dir)
        _staged.extend(made)
        return found

    return run


@tidy
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the rated ones among docs, takes for good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@tidy
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts, that of the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


@tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links, that of the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


@tidy
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of any benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their sequences and offsets."""
    return packing.named(packing.pack(docs))


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("pack", pack),
]

#: The classifier and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _staged.clear()  # an earlier run's last result may not be written yet
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
