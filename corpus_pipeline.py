"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which the
runner writes as Parquet to the shared folder and reads again as the next
stage's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import line_dedup, packing, pfair_mixing, quality_rules, simhash_pigeonring
from claimspark.llm.common import read
from claimspark.session import delete_dir, scratch, stored  # noqa: F401


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the largest doc_id only; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, min_docs=5, min_chars=40)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(line_dedup.N_DROPPED) > 0, F.length("text"))
                             .otherwise(F.col("n_chars")).cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id."""
    return simhash_pigeonring.keep_one(docs, shingle_words=4, max_bits=4)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix, so that what is packed together is mixed."""
    return pfair_mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=100_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixing),
    ("packing", packed),
]

#: The fingerprints (XXH64) and the token ids have no counterpart in DuckDB's SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another.  What a stage stores on its way is deleted when
    its result is written, and that when the next stage's is; the last stays."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as own:
            docs = own.kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            delete_dir(spark, before)
        before = own.last
    return docs
