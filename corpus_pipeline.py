"""Corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of their input, so that each stage works on
all that its predecessor kept. `run` writes every stage's result to the shared folder and
reads it again as the next one's documents; a lost executor costs a stage's tasks, not the
pipeline.

Defined cases: each stage keeps rows with null ids, repeated rows and other columns as its
operator says; a null text counts as empty and is rejected by the quality rules; an empty
table passes through all stages and gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from adpulse.llm import packing, pii, quality_rules, simhash, winnowing
from adpulse.llm.common import load, ship, stored
from adpulse.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    ship(spark)
    return quality_rules.accepted(docs, tokenizer_file("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest id."""
    ship(spark)
    return simhash.first_of_each(docs, shingle=3, bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no window with a benchmark item."""
    ship(spark)
    return winnowing.clean(docs, load(spark, sf_dir, "benchmark"), window=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data and terms that give it away are replaced."""
    return pii.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    ship(spark)
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("packing", pack),
]

#: The stages use tokenizers and XXH64, which SQL does not have.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
