"""N-gram ranking and term weights for display."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wartaframe.functions import text as tx

# Arrays hold fewer elements than this, so (seq, position) is one wide number.
POSITIONS = Decimal(1 << 31)
#: Numbers below this leave room for a position in a bigint.
SHORT_SEQ = 1 << 32


def ngram_counts(docs: DataFrame, n: int, text: str = "text_final") -> DataFrame:
    """(kata, frekuensi, first): occurrences and the place of the first one.

    ``first`` keeps the document order and then the position. It is one number,
    so the counting stays a hash aggregate that combines before its shuffle: a bigint
    where the documents' numbers, which are read first, leave room for it, else a decimal.
    """
    words = tx.word_tokens(F.col(text), min_length=1)
    seq = F.col("seq").cast("bigint")
    least, most = docs.agg(F.min(seq), F.max(seq)).first()
    if least is not None and -SHORT_SEQ < least and most < SHORT_SEQ:
        place = F.shiftleft(seq, 31) + F.col("pos")
    else:
        place = (F.col("seq").cast("decimal(20,0)") * F.lit(POSITIONS) + F.col("pos")).cast("decimal(38,0)")
    return (
        docs.filter(F.col(text).isNotNull())
        .select("seq", F.posexplode(tx.ngrams(words, n)).alias("pos", "kata"))
        .groupBy("kata")
        .agg(
            F.count(F.lit(1)).alias("frekuensi"),
            F.min(place).alias("first"),
        )
    )


def top_ngrams(docs: DataFrame, n: int = 2, k: int = 15, text: str = "text_final") -> DataFrame:
    """The k most frequent n-grams; ties keep the order of first appearance."""
    counts = ngram_counts(docs, n, text)
    return counts.orderBy(F.desc("frekuensi"), "first").limit(k).select("kata", "frekuensi")


def top_keywords(docs: DataFrame, k: int = 100, text: str = "text_final") -> DataFrame:
    return top_ngrams(docs, 1, k, text)


def display_weights(terms: DataFrame) -> DataFrame:
    """Relative weight, size, boldness and opacity of each (kata, frekuensi)."""
    # Ranked terms only: a list that is shown is short.
    low = terms.agg(F.min("frekuensi")).scalar()
    high = terms.agg(F.max("frekuensi")).scalar()
    relative = F.coalesce((F.col("frekuensi") - low) / F.nullif(high - low, F.lit(0)), F.lit(0.5))
    return terms.withColumn("t", relative).select(
        "kata",
        "frekuensi",
        "t",
        (14 + F.col("t") * 34).alias("size"),
        (400 + F.round(F.col("t") * 4) * 100).cast("int").alias("weight"),
        (0.55 + F.col("t") * 0.45).alias("opacity"),
    )


def sentiment_terms(docs: DataFrame, k: int = 80, text: str = "text_final") -> DataFrame:
    """The k most frequent words of each sentiment, ties in word order."""
    counts = (
        docs.select(
            F.lower("sentiment").alias("sentiment"),
            F.explode(tx.word_tokens(F.col(text), min_length=1)).alias("kata"),
        )
        .groupBy("sentiment", "kata")
        .agg(F.count(F.lit(1)).alias("frekuensi"))
    )
    place = F.row_number().over(W.partitionBy("sentiment").orderBy(F.desc("frekuensi"), "kata"))
    # The rank filter lets each task keep k rows per sentiment before the shuffle.
    return counts.withColumn("rank", place).filter(F.col("rank") <= k)
