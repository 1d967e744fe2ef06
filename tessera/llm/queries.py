"""One query for each training-data operator, over its whole table with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, compaction, graph_dedup, packing, pii, progressive_jpeg, simhash, suffix_dedup, toxicity
from . import token_counts as counts
from .common import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, the same on each machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"), least=0.8)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), seen="crc32(cast(doc_id as string)) % 3 <> 1", cut=0.7)


def op3_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compaction.compacted(table(spark, sf_dir, "documents"), Scratch(spark, "shards").root, rows_a_file=1_000)
    text = F.coalesce("text", F.lit(""))
    return made.read().select("doc_id", "lang", "source", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


OP3_SQL = "select doc_id, lang, source, cast(strlen(coalesce(text, '')) as bigint) as n_bytes, sha256(coalesce(text, '')) as text_sha256 from documents"


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.media_digests(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"), width=400)


def op10_graph_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


QUERIES: dict[str, Query] = {
    "op1_personal_data": op1_personal_data,
    "op2_toxicity": op2_toxicity,
    "op3_size_tiered_compaction": op3_size_tiered_compaction,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_progressive_jpeg": op6_progressive_jpeg,
    "op7_token_counts": op7_token_counts,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_graph_near_dedup": op10_graph_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_size_tiered_compaction": OP3_SQL,
}
