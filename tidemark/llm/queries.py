"""The registered queries of this subpackage: thin wrappers that apply each operator with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, licenses, media, mixing, oracles, packing, pii, quality, resampling, simhash, sketches, token_counts, toxicity, vectors
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"), token_counts.token_count(public_tokenizers.path(VOCABULARY)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample_to_target(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_media(media.store_texts(table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_exact_dedup,
        op3_packing,
        op4_quality,
        op5_licenses,
        op6_simhash,
        op7_fingerprints,
        op8_mixing,
        op9_toxicity,
        op10_pii,
        op11_target_resampling,
        op12_media_columns,
        op13_vector_codes,
    )
}

ORACLE_SQL = {
    "op2_exact_dedup": oracles.EXACT_DEDUP,
    "op11_target_resampling": oracles.TARGET_RESAMPLING,
    "op12_media_columns": oracles.MEDIA_COLUMNS,
    "op13_vector_codes": oracles.VECTOR_CODES,
}
