"""From documents to packed training sequences: each stage works on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from uqframe.llm import credentials, packing, quality, substrings, superminhash
from uqframe.llm.common import bound_batches, table
from uqframe.llm.queries import tokenizer_file
from uqframe.sources.session import cut_lineage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines above the limits."""
    bound_batches(spark)
    return quality.apply_rules(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, similarity of 0.8 or more."""
    bound_batches(spark)
    return superminhash.keep_first(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that an earlier document holds."""
    bound_batches(spark)
    return substrings.without_repeats(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets replaced by a mark."""
    bound_batches(spark)
    return credentials.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences of 2048 tokens."""
    bound_batches(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: Tokens and learned automata cannot be written in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
