"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractwise.llm import (
    byte_bpe,
    compression,
    contextual_pii,
    cross_parse,
    ftrl,
    hard_negatives,
    length_buckets,
    simhash_bytes,
    spelling,
    stream_dedup,
    token_files,
    toxicity,
    url_rules,
)
from tractwise.llm.common import shared_folder, stored, table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, WORD_TOKENIZER)
    return token_files.read_documents(spark, folder)


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.judged(table(spark, sf_dir, "documents"))


def op3_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    return ftrl.fitted_and_scored(docs, labels)


#: Rules that hold before any mined one.
URL_RULES = (
    url_rules.Rule("allow", "com", "/"),
    url_rules.Rule("block", "example.com", "/en/"),
    url_rules.Rule("allow", "www.example.com", "/en/"),
    url_rules.Rule("block", "net", "/es/"),
    url_rules.Rule("block", "net", "/fr/"),
)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of bad quality, or toxic ones, are what the mined rules look for."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"),
        ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"),
    )
    return url_rules.judged(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = contextual_pii.KINDS
    rows = contextual_pii.with_spans(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in kinds],
        F.sha2(contextual_pii.spans_text(*kinds), 256).alias("base_sha256"),
        contextual_pii.spans_text(*kinds, contextual_pii.FOUND).alias("spans"),
    )


def op6_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = stream_dedup.exact_groups(spark, f"{sf_dir}/documents.parquet")
    return groups.select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op7_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lengths = stored(length_buckets.token_counts(docs, WORD_TOKENIZER), "lengths")
    return length_buckets.packed(lengths)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, BYTE_RANKS, public_tokenizers.PATTERN)


def op9_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prints = stored(simhash_bytes.fingerprints(docs), "fingerprints")
    return simhash_bytes.near_groups(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_cross_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parse.learned_and_judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


def op11_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    return toxicity.fitted_and_scored(docs, labels)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_compression_bands,
        op3_ftrl_quality,
        op4_url_rules,
        op5_contextual_pii,
        op6_stream_dedup,
        op7_length_buckets,
        op8_byte_bpe,
        op9_simhash_bytes,
        op10_cross_parse,
        op11_nb_toxicity,
        op12_spelling_variants,
        op13_residue_negatives,
    )
}

ORACLE = {
    "op6_stream_dedup": """
        WITH texts AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
        FROM texts WINDOW same AS (PARTITION BY text)""",
    "op13_residue_negatives": """
        WITH vectors AS (
            SELECT vec_id,
                   CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS parts
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                   CAST(list_dot_product(a.parts, b.parts) AS BIGINT) AS score
            FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INT) AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scores USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
        QUALIFY row_number() OVER best <= 3""",
}
