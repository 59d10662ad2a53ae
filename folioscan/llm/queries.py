"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.llm import (
    bin_completion, byte_cnn, credentials, group_join, learned_partitions, license_rules, mask_ranking, merkle_rollup, mixture_lang, oracle,
    packed_output, simhash_vp, spaced_seeds, surrogates,
)
from folioscan.llm.common import crc_class, shipped, table

Query = Callable[[SparkSession, str], DataFrame]
# A caller's own key belongs here; this one only makes the registered query repeatable.
SURROGATE_KEY = b"folioscan registered query"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secret_scan(table(spark, sf_dir, "documents"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.with_surrogates(docs, SURROGATE_KEY, count=True)


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixture_lang.languages(docs, mixture_lang.learn(docs))


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.quality_scores(docs, byte_cnn.learn(docs, table(spark, sf_dir, "labels")))


def op7_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_output.packed_matrices(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.license_scan(table(spark, sf_dir, "documents"))


def op10_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.near_duplicates(table(spark, sf_dir, "documents"))


def op12_merkle_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_rollup.manifest(table(spark, sf_dir, "documents"), crc_class("doc_id", 7) == 0)


def op13_mask_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: shipped(f) for f in (
    op1_credentials, op2_surrogates, op3_language_mixture, op4_spaced_seeds, op5_learned_partitions, op6_quality_cnn,
    op7_simhash_vp, op8_packed_matrices, op9_license_rules, op10_bin_completion, op11_group_join, op12_merkle_rollup, op13_mask_ranking)}
ORACLE: dict[str, str] = oracle.STATEMENTS
