"""Training-data pipeline over ``documents``: clean, deduplicate, mix, tokenise.

Every stage takes what its predecessor wrote. Quality rules and toxicity drop
rows in one pass each, near-dedup keeps one document of each group, mixing repeats
and leaves out documents so that sources meet their targets, and the last stage
returns the tokens of every document of the mix with a digest of their decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wartaframe.llm import bpe, mixing, near_dedup, quality_rules, toxicity
from wartaframe.llm.queries import table, vocabulary_path
from wartaframe.session import checkpointed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_clean(docs)


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by the grammar learned from the labelled ones among them."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that the sources' target weights ask for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and the digest of what they decode to."""
    return bpe.digests(docs, vocabulary_path(), with_ids=True)


STAGES = [
    ("quality", quality),
    ("toxicity", nontoxic),
    ("near_dedup", unique),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: Learned weights and tokenisation are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is cut off before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
