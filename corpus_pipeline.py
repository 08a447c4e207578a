"""A training-data pipeline over ``documents``: language, quality, near duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crawlvis.llm import language, near_duplicates, packing, quality
from crawlvis.llm.store import dropped, written

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, by a model fit on this stage's own input."""
    return language.kept_documents(docs, language.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    return quality.kept_documents(docs)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least id."""
    return near_duplicates.kept_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences."""
    return packing.packed_documents(docs, public_tokenizers.path(VOCABULARY), CAPACITY)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicate_join", near_duplicate_join), ("best_fit_packing", best_fit_packing)]

#: The language model and the packing have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that all stages keep.

    Null and empty texts go with the first stage, of rows that repeat one stays, an empty table gives an empty result, and
    further columns, whatever their names, go along up to the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
