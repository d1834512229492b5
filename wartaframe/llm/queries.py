"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wartaframe.llm import (
    ann, bpe, hard_negatives, html_text, importance, licenses, lm_scoring, mixing, near_dedup, quality_rules,
    substring_dedup, token_counts, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, as the query's contract says."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


@query("op2_html_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query("op6_ann")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), ann.standard_queries())


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@query("op3_mixing", mixing.PLAN_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def vocabulary_path() -> str:
    """The byte-level BPE vocabulary that comes with the tokenizer files of the machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_licenses")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path)


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op11_importance_resampling", importance.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_hard_negatives", hard_negatives.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every seventh id is moved on first, as the query's contract says."""
    vectors = table(spark, sf_dir, "embeddings")
    return hard_negatives.hard_negatives(vectors, hard_negatives.standard_anchors(), hard_negatives.shifted_label())


@query("op13_substring_dedup", substring_dedup.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))
