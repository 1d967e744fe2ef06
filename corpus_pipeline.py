"""A corpus through five stages: toxic documents go, one of near copies stays, repeated passages go, personal data is masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import packing, pii, simhash, suffix_dedup
from tessera.llm import toxicity as classifier
from tessera.llm.common import Scratch, collected, table
from tessera.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more are left out."""
    return classifier.clean(docs, table(spark, sf_dir, "labels"), cut=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word Jaccard of 0.8 or more) stays."""
    return simhash.representatives(docs, words=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what is covered by 400-byte strings that start elsewhere too."""
    return suffix_dedup.kept_texts(docs, width=400)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind."""
    return pii.redacted(docs, least=0.8)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequences and offsets."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def after_others(stage: Stage) -> Stage:
    """The stage, begun in executors that have handed back what the stages before have filled."""

    @functools.wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collected(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [
    ("toxicity", after_others(toxicity)),
    ("simhash_near_dedup", after_others(near_duplicates)),
    ("suffix_array_dedup", after_others(repeated_passages)),
    ("pii", after_others(personal_data)),
    ("best_fit_packing", after_others(best_fit_packing)),
]

#: SQL can't express the classifier's training.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
