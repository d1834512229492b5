"""Word and word-pair TF-IDF, exact stratified splits and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wartaframe.functions import fixed_values as fixed
from wartaframe.functions import text as tx
from wartaframe.operators.curate import sampling_key
from wartaframe.operators.joins import join_lookup, join_statistics

RANK_BUCKETS_HEX = 3


def with_terms(docs: DataFrame, text: str = "text_final", column: str = "terms") -> DataFrame:
    """Words of at least two characters followed by their neighbouring pairs."""
    both = tx.evaluated_once(
        tx.word_tokens(F.col(text)), lambda w: F.concat(w, tx.ngrams(w, 2))
    )
    return docs.withColumn(column, both)


def term_frequencies(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """(term, tf, df) over the corpus.

    Sorted terms tell the first of each kind in a document, so one aggregate by
    term counts both without grouping by document before.
    """
    ordered = docs.select(F.sort_array(terms).alias("_t"))
    marked = F.transform(
        "_t",
        lambda t, i: F.struct(
            t.alias("term"), (~F.equal_null(F.get("_t", i - 1), t)).alias("first")
        ),
    )
    return (
        ordered.select(F.inline(marked))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("tf"), F.count_if("first").alias("df"))
    )


def vocabulary(
    docs: DataFrame,
    max_features: int,
    min_df: int = 1,
    max_df: float = 0.9,
    terms: str = "terms",
) -> DataFrame:
    """(term, tf, df): the most frequent terms within the document-frequency bounds."""
    limit = docs.agg(F.count(F.lit(1)) * F.lit(max_df)).scalar()
    return (
        term_frequencies(docs, terms)
        .filter((F.col("df") >= min_df) & (F.col("df") <= limit))
        .orderBy(F.desc("tf"), "term")
        .limit(max_features)
    )


def chosen_counts(
    docs: DataFrame, chosen: DataFrame, terms: str = "terms", seq: str = "seq"
) -> DataFrame:
    """(seq, term, df, tf) for the terms of a vocabulary (term, tf, df).

    Terms outside the vocabulary are gone before rows are grouped.
    """
    occurrences = docs.select(F.col(seq).alias("seq"), F.explode(terms).alias("term"))
    return (
        join_statistics(occurrences, chosen.select("term", "tf", "df"), "term", "tf")
        .groupBy("seq", "term", "df")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def tfidf_weights(
    docs: DataFrame, chosen: DataFrame, terms: str = "terms", seq: str = "seq"
) -> DataFrame:
    """(seq, term, w): unit-length smoothed TF-IDF over the chosen vocabulary."""
    n = docs.agg(F.count(F.lit(1))).scalar()
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1
    raw = chosen_counts(docs, chosen, terms, seq).withColumn("raw", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("seq")))
    return raw.select("seq", "term", (F.col("raw") / norm).alias("w"))


def ranked_in_class(rows: DataFrame, label: str, key: str, seed: int = fixed.SEED) -> DataFrame:
    """Add ``class_rank``: 1-based place of a row in its class in seeded order.

    A class may hold most rows, so it is not sorted in one task: the leading
    digits of the hash cut it into even buckets, each bucket is ranked alone and
    starts after the counted rows of the buckets before it.
    """
    hashed = rows.withColumn("_h", sampling_key(F.col(key), seed)).withColumn(
        "_b", F.substring("_h", 1, RANK_BUCKETS_HEX)
    )
    buckets = hashed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        W.partitionBy(label).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    )
    starts = buckets.select(label, "_b", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", key))
    return (
        hashed.withColumn("_place", place)
        .join(starts, [label, "_b"])
        .withColumn("class_rank", F.col("_start") + F.col("_place"))
        .drop("_h", "_b", "_place", "_start")
    )


def stratified_split(
    rows: DataFrame,
    label: str,
    key: str,
    test_share: float = 0.2,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Add ``is_test``: exactly ceil(share * n) test rows, shared out by class.

    Class quotas follow the largest remainders. If a class has a single row the
    split is not stratified.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    n = F.sum("_c").over(W.partitionBy())
    share = F.ceil(n * F.lit(test_share)) * F.col("_c") / n
    quotas = (
        counts.withColumn("_share", share)
        .withColumn("_quota", F.floor("_share"))
        .withColumn(
            "_left",
            F.ceil(n * F.lit(test_share)) - F.sum("_quota").over(W.partitionBy()),
        )
        .withColumn(
            "_order",
            F.row_number().over(W.orderBy(F.desc(F.round(F.col("_share") - F.col("_quota"), 9)), label)),
        )
        .select(
            label,
            (F.col("_quota") + F.when(F.col("_order") <= F.col("_left"), 1).otherwise(0)).alias("_quota"),
            F.min("_c").over(W.partitionBy()).alias("_smallest"),
            F.ceil(n * F.lit(test_share)).alias("_test_rows"),
        )
    )
    if quotas.filter("_smallest < 2").isEmpty():
        ranked = join_lookup(ranked_in_class(rows, label, key, seed), quotas.select(label, "_quota"), label)
        return ranked.withColumn("is_test", F.col("class_rank") <= F.col("_quota")).drop(
            "class_rank", "_quota"
        )
    whole = ranked_in_class(rows.withColumn("_all", F.lit(1)), "_all", key, seed)
    test_rows = quotas.agg(F.max("_test_rows")).scalar()
    return whole.withColumn("is_test", F.col("class_rank") <= test_rows).drop("class_rank", "_all")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): balanced weights n / (classes * class size)."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = W.partitionBy()
    return counts.select(
        label,
        "n",
        (F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))).alias("weight"),
    )
