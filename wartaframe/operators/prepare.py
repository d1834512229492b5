"""Clean text and final tokens of articles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wartaframe.functions import fixed_values as fixed
from wartaframe.functions import text as tx
from wartaframe.functions.stem import INDONESIAN_AFFIXES, affix_stem, stem_token
from wartaframe.operators.joins import join_frequent_first, join_lookup
from wartaframe.session import checkpointed


def clean_articles(
    articles: DataFrame,
    stopwords: Iterable[str] = (),
    keyword: str = "",
    extra_stopwords: str = "",
) -> DataFrame:
    """Add ``text`` and ``clean_text``."""
    stop = [*stopwords, *tx.dynamic_stopwords(keyword, extra_stopwords)]
    text = tx.assemble_text(F.col("judul"), F.col("content"))
    return articles.withColumn("text", text).withColumn(
        "clean_text",
        tx.join_tokens(tx.drop_stopwords(tx.tokens(tx.clean_text(F.col("text"))), stop)),
    )


def drop_listed_words(articles: DataFrame, stopwords: DataFrame, text: str = "clean_text") -> DataFrame:
    """``text`` without the words of a table (word), which may be of any length."""
    listed = stopwords.select("word", F.lit(True).alias("_listed")).distinct()
    tokens = articles.select("seq", F.posexplode(tx.tokens(F.col(text))).alias("pos", "word"))
    kept = (
        join_lookup(tokens, listed, "word", "left")
        .filter(F.col("_listed").isNull())
        .groupBy("seq")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("_kept"))
    )
    left = F.coalesce(tx.join_tokens(F.col("_kept.word")), F.lit(""))
    return articles.join(kept, "seq", "left").withColumn(text, left).drop("_kept")


def vocabulary_stems(
    tokens: DataFrame,
    stems: DataFrame | None = None,
    rules: Iterable[tuple[str, str]] = INDONESIAN_AFFIXES,
) -> DataFrame:
    """(word, stem, n) for each distinct token: table first, affix rules else.

    A token may hold two words (an expanded abbreviation): each is stemmed.
    """
    vocabulary = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    by_rule = stem_token(F.col("word"), tuple(rules))
    if stems is None:
        return vocabulary.select("word", by_rule.alias("stem"), "n")
    # Several rows of a word count as its first stem in their order.
    known = stems.groupBy("word").agg(F.min("stem").alias("_known"))
    parts = vocabulary.select(
        F.col("word").alias("_token"), "n", F.posexplode(F.split("word", " ")).alias("_at", "word")
    )
    looked_up = parts.join(known, "word", "left").select(
        "_token", "n", "_at", F.coalesce("_known", affix_stem(F.col("word"), tuple(rules))).alias("_stem")
    )
    # A token holds one or two words, so these groups are tiny.
    whole = looked_up.groupBy("_token", "n").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_stem"))).alias("_parts")
    )
    return whole.select(
        F.col("_token").alias("word"), F.array_join("_parts._stem", " ").alias("stem"), "n"
    )


def stem_articles(
    articles: DataFrame,
    stems: DataFrame | None = None,
    rules: Iterable[tuple[str, str]] = INDONESIAN_AFFIXES,
    slang: Mapping[str, str] = fixed.SLANG,
    generic: Iterable[str] = tuple(fixed.POST_STEM_STOPWORDS),
    source: str = "clean_text",
) -> DataFrame:
    """Add ``tokens_stemmed`` and ``text_final``.

    Rules alone are expressions and need no shuffle. With a stem table each
    distinct word is looked up once and the result is joined back by word; the texts
    are stored for that, as they are read for the vocabulary and for each kind of word.
    """
    normalised = tx.normalise_slang(tx.tokens(F.col(source)), slang)
    if stems is None:
        rules = tuple(rules)
        stemmed = F.transform(normalised, lambda w: stem_token(w, rules))
        return _finish(articles, stemmed, generic)
    texts = checkpointed(articles.select("seq", source))
    tokens = texts.select("seq", F.posexplode(normalised).alias("pos", "word"))
    vocabulary = checkpointed(vocabulary_stems(tokens, stems, rules))
    stemmed = (
        join_frequent_first(tokens, vocabulary, "word", "n")
        .groupBy("seq")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "stem"))).alias("_stems"))
    )
    empty = F.array().cast("array<string>")
    joined = articles.join(stemmed, "seq", "left")
    return _finish(joined, F.coalesce(F.col("_stems.stem"), empty), generic).drop("_stems")


def _finish(articles: DataFrame, stemmed: Column, generic: Iterable[str]) -> DataFrame:
    return articles.withColumn("tokens_stemmed", tx.post_stem_filter(stemmed, generic)).withColumn(
        "text_final", tx.join_tokens(F.col("tokens_stemmed"))
    )
