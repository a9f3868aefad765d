"""The registered queries of this subpackage: each applies one operator with its
production parameters to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimspark.llm import edit_counts, exact_topk, language_id, line_dedup, lm_mixing, packing, pfair_mixing, \
    quality_cnn, quality_rules, simhash_pigeonring, strassen_mining, token_alignment, \
    url_templates
from claimspark.llm.common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mixing.plan(read(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.score(read(spark, sf_dir, "documents"), modulus=5, remainder=1)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(read(spark, sf_dir, "documents"), min_docs=5, min_chars=40)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(read(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(read(spark, sf_dir, "pages"), url_templates.RULES)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), modulus=3, remainder=1)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.edited_counts(read(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(read(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pigeonring.near_duplicates(read(spark, sf_dir, "documents"),
                                              shingle_words=4, max_bits=4)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strassen_mining.mine(read(spark, sf_dir, "embeddings"), every=100, positives=5, negatives=10, low=30, high=90,
                                scale=256, relabel_every=7, labels=10)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(read(spark, sf_dir, "documents"), modulus=4, remainder=2, max_train_rows=4000)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filters": op6_url_filters,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_token_counts": op8_token_counts,
    "op9_exact_topk": op9_exact_topk,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_language_id": op12_language_id,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE: dict[str, str] = {
    "op1_mixing": pfair_mixing.oracle(),
    "op4_line_dedup": line_dedup.oracle(min_docs=5, min_chars=40),
    "op5_quality_rules": quality_rules.oracle(),
    "op6_url_filters": url_templates.oracle(),
    "op9_exact_topk": exact_topk.oracle(),
    "op11_hard_negatives": strassen_mining.oracle(),
}
