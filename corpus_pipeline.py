"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm.byte_bpe import byte_bpe
from cohortloom.llm.common import documents
from cohortloom.llm.exact_dedup import drop_exact_copies
from cohortloom.llm.quality_rules import drop_rejected
from cohortloom.llm.simhash import drop_near_copies
from cohortloom.llm.source_mix import take_mix
from cohortloom.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of three-word shingles that two bits link."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as their source's target takes them."""
    return take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, with the digests of ids and decoded bytes."""
    return byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=True)


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("source_mix", mixing), ("byte_bpe", tokens)]

#: SimHash and byte-pair encoding have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
