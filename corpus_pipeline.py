"""Corpus preparation in five stages: language identification, exact deduplication, near-deduplication, personal
data, packing.  Each stage takes all that the one before kept; all but the last return the columns of documents.

1. language: documents whose text the language model rejects go; it learns from the labelled rows it is given.
2. exact: of equal texts the document with the largest doc_id stays.
3. near: of each SimHash component the document with the smallest doc_id stays.
4. personal: personal data in texts is replaced by its kind.
5. packing: the texts' pieces, each with its sequence and its place there.

An empty table goes through all stages; columns beyond those of documents pass the first four unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import exact_dedup, language_id, packing, personal_data, simhash
from helixframe.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.learn(docs, language_id.fold(4) != 2))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language", language), ("exact", exact), ("near", near), ("personal", personal), ("packing", pack)]

#: SQL cannot express a trained model, a random field or a tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
