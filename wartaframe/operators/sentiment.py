"""Weighted lexicon, phrase and direction scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wartaframe.functions import fixed_values as fixed
from wartaframe.functions import text as tx
from wartaframe.functions.direction import DirectionRules, direction_score
from wartaframe.operators.joins import NARROW, dealt_by, fits_broadcast, join_lookup, numbered
from wartaframe.operators.prepare import vocabulary_stems
from wartaframe.session import checkpointed

#: Text that a task takes apart at once, and beginnings of phrases that it looks up at once.
PIECE_BYTES = 4 << 20
PIECE_STARTS = 2_000_000


def stemmed_lexicon(entries: DataFrame, stems: DataFrame | None = None, **rules) -> DataFrame:
    """(entry_id, stem, weight, words): lexicon entries with each word stemmed."""
    numbered = checkpointed(entries.withColumn("entry_id", F.monotonically_increasing_id()))
    words = numbered.select(
        "entry_id", "weight", F.posexplode(tx.tokens(F.col("word"))).alias("pos", "word")
    )
    table = vocabulary_stems(words, stems, **rules).drop("n")
    return (
        words.join(table, "word")
        .groupBy("entry_id", "weight")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "stem"))).alias("parts"))
        .select("entry_id", F.array_join("parts.stem", " ").alias("stem"), "weight",
                F.size("parts").alias("words"))
    )


def lexicon_words(stemmed: DataFrame) -> DataFrame:
    """(word, weight): single words, weights of equal stems averaged."""
    return (
        stemmed.filter("words = 1")
        .groupBy(F.col("stem").alias("word"))
        .agg(F.avg("weight").alias("weight"))
    )


def lexicon_phrases(stemmed: DataFrame) -> DataFrame:
    """(entry_id, phrase, weight): every entry of several words counts by itself."""
    return stemmed.filter("words > 1").select("entry_id", F.col("stem").alias("phrase"), "weight")


def word_scores(articles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(seq, word_score, word_matches) over all token occurrences in the lexicon."""
    tokens = articles.select("seq", F.explode("tokens_stemmed").alias("word"))
    return (
        join_lookup(tokens, lexicon, "word", times=NARROW)
        .groupBy("seq")
        .agg(F.sum("weight").alias("word_score"), F.count(F.lit(1)).alias("word_matches"))
    )


def _pieces(rows: DataFrame, word: str, lengths: list[int], cut: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """A row for each beginning or ending of a word that has one of the given lengths."""
    sizes = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    cuts = rows.select("*", F.length(word).alias("_size")).select("*", F.explode(sizes).alias("_n"))
    return cuts.filter("_n <= _size").withColumn(name, cut(F.col(word), F.col("_n"))).drop("_n", "_size")


def _lengths(values: DataFrame, column: str) -> list[int]:
    """The different lengths, no more than the longest value has characters."""
    return sorted(r[0] for r in values.select(F.length(column)).distinct().collect())


def _start(whole: bool | Column) -> Column:
    """One number for the beginning of a phrase: both words, and whether the second is whole."""
    flag = whole.cast("bigint") if isinstance(whole, Column) else F.lit(int(whole)).cast("bigint")
    return (F.shiftleft("head_no", 32) + F.shiftleft("tail_no", 1) + flag).alias("start")


def _starts(pairs: DataFrame, parted: DataFrame) -> DataFrame:
    """(seq, start): where two neighbouring tokens (seq, word, next) may begin a phrase.

    A phrase begins at the end of a word. One of two words may stop inside the
    second; a longer one goes on with a whole word. The first and the second words of
    the phrases are dictionaries: found small, they leave nothing to shuffle.
    """
    heads = parted.select("head", "head_no").distinct()
    tails = parted.groupBy(F.col("second").alias("tail"), "tail_no").agg(
        F.bool_or(F.col("n_words") == 2).alias("_stops"), F.bool_or(F.col("n_words") > 2).alias("_goes_on")
    )
    begun = join_lookup(_pieces(pairs, "word", _lengths(heads, "head"), F.right, "head"), heads, "head", times=NARROW)
    ends = _pieces(begun.select("seq", "head_no", "next"), "next", _lengths(tails, "tail"), F.left, "tail")
    ends = ends.select("seq", "head_no", "tail", (F.col("tail") == F.col("next")).alias("_whole"))
    met = join_lookup(ends, tails, "tail", times=NARROW)
    if tails.filter("_goes_on").isEmpty():
        return met.select("seq", _start(False))
    both = F.array(
        F.when(F.col("_stops"), _start(False)), F.when(F.col("_goes_on") & F.col("_whole"), _start(True))
    )
    return met.select("seq", F.explode(F.array_compact(both)).alias("start"))


def pieces_of(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about PIECE_BYTES of a text column."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield batch.slice(a, b - a)


def neighbours(texts: pa.Array, blank: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words of some texts, and of each two neighbouring ones the row and both numbers.

    Words are what lies between blanks; with ``blank`` that may be nothing.
    """
    lists = pc.split_pattern(texts, " ")
    row, words = np.asarray(pc.list_parent_indices(lists)), lists.flatten()
    if not blank:
        full = np.asarray(pc.not_equal(words, ""))
        row, words = row[full], words.filter(pa.array(full))
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy()
    at = np.flatnonzero(row[1:] == row[:-1])
    return coded.dictionary, row[at], code[at], code[at + 1]


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in ascending order, by a sort, which takes a twentieth of the time of a hash table."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def counted_pairs(texts: pa.Array, known: pa.Array, numbers: np.ndarray) -> pa.RecordBatch:
    """(pair, n): in how many of the texts two known words are neighbours, as one number for both."""
    words, row, a, b = neighbours(texts, blank=False)
    at = pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False)
    both = (at[a] >= 0) & (at[b] >= 0)
    pair = (numbers[at[a[both]]].astype(np.int64) << 32) + numbers[at[b[both]]]
    names, place = np.unique(pair, return_inverse=True)
    cells = distinct(row[both] * len(names) + place)
    n = np.bincount(cells % max(len(names), 1), minlength=len(names))
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(n, pa.int64())], ["pair", "n"])


def _cut_numbers(
    words: pa.Array, values: pa.Array, numbers: np.ndarray, lengths: list[int], first: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the values that each word begins (``first``) or ends with: where those of a word
    begin, how many there are, the numbers, and whether they stand for the whole word."""
    size = pc.utf8_length(words)
    of, found, whole = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for n in lengths:
        long = np.flatnonzero(np.asarray(pc.greater_equal(size, n)))
        if not n or not len(long):
            continue
        taken = words.take(pa.array(long))
        cut = pc.utf8_slice_codeunits(taken, 0, n) if first else pc.utf8_slice_codeunits(taken, -n)
        at = pc.fill_null(pc.index_in(cut, values), -1).to_numpy(zero_copy_only=False)
        of.append(long[at >= 0])
        found.append(numbers[at[at >= 0]])
        whole.append(np.asarray(pc.equal(size.take(pa.array(long)), n))[at >= 0])
    of, found, whole = (np.concatenate(x) for x in (of, found, whole))
    order = np.argsort(of, kind="stable")
    count = np.bincount(of, minlength=len(words))
    return np.cumsum(count) - count, count, found[order], whole[order]


def _starts_within(texts: pa.Array, heads: tuple, tails: tuple, known: np.ndarray) -> pa.ListArray:
    """The known beginnings of phrases in each text, as their numbers in ascending order."""
    words, row, a, b = neighbours(texts)
    starts_a, count_a, head, _ = _cut_numbers(words, *heads, False)
    starts_b, count_b, tail, whole = _cut_numbers(words, *tails, True)
    may = (count_a[a] > 0) & (count_b[b] > 0)
    row, a, b = row[may], a[may], b[may]
    met = count_a[a] * count_b[b]
    upto = np.cumsum(met)
    cells, at, longer = [np.zeros(0, np.int64)], 0, bool(np.any(known & 1))
    while at < len(row):
        to = max(at + 1, np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE_STARTS, "right"))
        n = met[at:to]
        pair = np.repeat(np.arange(at, to), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        h, t = k // count_b[b[pair]], k % count_b[b[pair]]
        t += starts_b[b[pair]]
        start = (head[h + starts_a[a[pair]]] << 32) + (tail[t] << 1)
        looked_up = [(start, row[pair])]
        if longer:
            looked_up.append((start[whole[t]] + 1, row[pair][whole[t]]))
        for value, of in looked_up:
            place = np.minimum(np.searchsorted(known, value), len(known) - 1)
            hit = known[place] == value
            cells.append(distinct(of[hit] * len(known) + place[hit]))
        at = to
    cells = distinct(np.concatenate(cells))
    ends = np.searchsorted(cells, np.arange(len(texts) + 1) * len(known))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(known[cells % len(known)]))


def _starts_beside(texts: DataFrame, parted: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (seq, start) of the known beginnings of phrases: their words are copied to every task.

    A text is taken apart once for all its neighbouring words, and what leaves it is a
    list of numbers, without any of its words.
    """

    def dictionary(word: str, number: str) -> tuple:
        table = parted.select(word, number).distinct().toArrow()
        values = table.column(word).combine_chunks()
        return values, table.column(number).to_numpy().astype(np.int64), sorted(set(pc.utf8_length(values).to_pylist()))

    spark = texts.sparkSession
    starts = np.sort(known.toArrow().column("start").to_numpy())
    copied = spark.sparkContext.broadcast((dictionary("head", "head_no"), dictionary("second", "tail_no"), starts))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches, "text_final"):
            starts = _starts_within(piece.column("text_final"), *copied.value)
            yield pa.RecordBatch.from_arrays([piece.column("seq"), starts], ["seq", "starts"])

    kind = texts.schema["seq"].dataType.simpleString()
    lists = texts.mapInArrow(look, f"seq {kind}, starts array<bigint>").filter(F.size("starts") > 0)
    lists = lists.groupBy("seq").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    return lists.select("seq", F.explode("starts").alias("start"))


def phrase_matches(articles: DataFrame, phrases: DataFrame) -> DataFrame:
    """(seq, entry_id, weight) once per phrase that is a substring of ``text_final``.

    A phrase may start inside a word, where the end of the word equals its first
    word, and stop inside one. Two neighbouring tokens name the phrases by equality of
    their first two words. Only longer phrases are looked for in the text, and only in
    the articles that hold their beginning. What is found in a text, many times its words, is told
    apart and added up where it is.
    """
    words = F.split("phrase", " ")
    parted = checkpointed(phrases.select(
        "entry_id", "weight", "phrase", F.get(words, F.lit(0)).alias("head"),
        F.get(words, F.lit(1)).alias("second"), F.size(words).alias("n_words"),
    ))
    # Words are numbered, so a beginning is a number too: the phrases outgrow their words, and
    # a table of numbers can be copied to every executor long after one of texts cannot.
    heads = numbered(parted.select("head").distinct(), "head_no")
    seconds = numbered(parted.select("second").distinct(), "tail_no")
    parted = parted.join(heads, "head").join(seconds, "second")
    parted = checkpointed(parted.withColumn("start", _start(F.col("n_words") > 2)))
    known = parted.select("start").distinct()

    texts = articles.select("seq", "text_final")
    if all(fits_broadcast(table, NARROW) for table in (heads, seconds, known)):
        found = _starts_beside(texts, parted, known)
    else:
        found = _starts_shuffled(texts, parted, known)

    long = parted.filter("n_words > 2")
    short = parted.filter("n_words = 2").select("start", "entry_id", "weight")
    if long.isEmpty():
        return _named(found, short)
    found = checkpointed(found)
    longer = _named(found, long.select("start", "entry_id", "weight", "phrase"))
    longer = articles.select("seq", "text_final").join(longer, "seq").filter(F.contains("text_final", "phrase"))
    return _named(found, short).union(longer.select("seq", "entry_id", "weight"))


def _starts_shuffled(articles: DataFrame, parted: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of :func:`_starts_beside` where a dictionary is too large to be copied."""
    texts = dealt_by(articles, "seq", "text_final")
    tokens = texts.select("seq", F.split("text_final", " ").alias("w"))
    pairs = tokens.select(
        "seq",
        F.inline(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))),
                            F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))),
                            lambda a, b: F.struct(a.alias("word"), b.alias("next")))),
    )
    found = _starts(pairs, parted)
    # Too many to be copied, they are met below, by all their entries at once.
    if fits_broadcast(known, NARROW):
        found = found.join(F.broadcast(known), "start").select("seq", "start")
    return found.distinct()


def _named(found: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries of each beginning found in an article."""
    named = found.join(F.broadcast(entries) if fits_broadcast(entries, NARROW) else entries, "start")
    return named.select("seq", *entries.columns[1:])


def phrase_scores(articles: DataFrame, phrases: DataFrame) -> DataFrame:
    """(seq, phrase_score, phrase_matches)."""
    return (
        phrase_matches(articles, phrases)
        .groupBy("seq")
        .agg(F.sum("weight").alias("phrase_score"), F.count(F.lit(1)).alias("phrase_matches"))
    )


def label_of(score: Column, matches: Column, band: float = fixed.NEUTRAL_BAND) -> Column:
    """Label of the mean weight per match; no match is neutral."""
    mean = score / F.nullif(matches, F.lit(0))
    return (
        F.when(mean > band, fixed.LABELS["positif"])
        .when(mean < -band, fixed.LABELS["negatif"])
        .otherwise(fixed.LABELS["netral"])
    )


def score_articles(
    articles: DataFrame,
    lexicon: DataFrame,
    phrases: DataFrame | None = None,
    rules: DirectionRules = DirectionRules(),
) -> DataFrame:
    """Add ``sentiment_score_lexicon``, ``jumlah_match_lexicon``, ``sentiment_lexicon``.

    Direction points move the score but are not counted as matches.
    """
    zero, none = F.lit(0.0), F.lit(0)
    found = word_scores(articles, lexicon)
    total = F.coalesce("word_score", zero)
    matches = F.coalesce("word_matches", none)
    if phrases is not None:
        found = found.join(phrase_scores(articles, phrases), "seq", "full")
        total = total + F.coalesce("phrase_score", zero)
        matches = matches + F.coalesce("phrase_matches", none)
    # A line of numbers for each article: cut here, as whoever reads the scores twice would match
    # twice, and found small it goes to the articles, whose texts then stay where they are.
    found = checkpointed(found)
    # Before the join: only its number goes through it, not the tokens.
    points = direction_score(F.col("tokens_stemmed"), rules).alias("_points")
    scored = articles.select("*", points).join(
        F.broadcast(found) if fits_broadcast(found, NARROW) else found, "seq", "left"
    )
    total = total + F.col("_points")
    return scored.select(
        *articles.columns,
        total.alias("sentiment_score_lexicon"),
        matches.cast("bigint").alias("jumlah_match_lexicon"),
    ).withColumn(
        "sentiment_lexicon",
        label_of(F.col("sentiment_score_lexicon"), F.col("jumlah_match_lexicon")),
    )


def lexicon_confidence(scored: DataFrame) -> DataFrame:
    """``sentiment`` and ``sentiment_score`` from the lexicon alone.

    The confidence is the absolute score relative to the largest of the corpus.
    """
    size = F.abs("sentiment_score_lexicon")
    largest = scored.agg(F.max(size)).scalar()
    share = size / F.coalesce(F.nullif(largest, F.lit(0.0)), F.lit(1.0))
    return scored.withColumn("sentiment", F.col("sentiment_lexicon")).withColumn(
        "sentiment_score", F.least(share, F.lit(1.0))
    )
