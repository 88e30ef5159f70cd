"""Documents to packed training batches, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tractwise.llm import (
    compression,
    contextual_pii,
    length_buckets,
    simhash_bytes,
    stream_dedup,
)
from tractwise.llm.common import stored, table
from tractwise.llm.queries import WORD_TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the base rules or lie outside the compression bands."""
    return compression.kept_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of the documents with equal texts, the one with the largest doc_id."""
    return stream_dedup.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of the documents whose fingerprints are linked, with the least doc_id."""
    return simhash_bytes.kept_documents(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind and counts ``n_chars`` anew."""
    return contextual_pii.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of document pieces in length buckets; the bounds come from these documents."""
    lengths = stored(length_buckets.token_counts(docs, WORD_TOKENIZER), "lengths")
    return length_buckets.packed(lengths)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("packing", packing),
]

#: Fingerprints and patterns are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written to shared storage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
