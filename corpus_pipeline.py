"""A training-data pipeline: quality, exact and near copies, benchmark leaks, tokens.  Part of graphloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, decontamination, exact_dedup, near_dedup, quality, shared
from graphloom.llm.queries import DIGESTS, token_digests


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on `labels`, scores 0.5 or more; null text counts as empty, without labels all stay."""
    return quality.quality_filter(docs, shared.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (null: empty), those with the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles, that with the smallest doc_id; texts without words all stay."""
    return near_dedup.near_dedup(docs, shingle_words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no item of `benchmark` was found; those without words hold none."""
    return decontamination.decontaminated(docs, shared.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the bytes that they decode to."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), then=token_digests, schema=DIGESTS)


STAGES = [
    ("quality", keep_quality),
    ("exact copies", drop_copies),
    ("near copies", drop_near_copies),
    ("benchmark leaks", drop_leaks),
    ("tokens", tokens),
]

#: The classifier, the edit distances and the merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
