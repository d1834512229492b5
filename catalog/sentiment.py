"""Lexicon, phrases, direction rules and labels (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import params as P
from catalog.adapter import RAW_TOKENS, STEMMED, q_in, r6, raw_tokens, sql_stem, stemmed, with_ctes
from catalog.registry import query
from wartaframe.functions import direction as dr
from wartaframe.functions import text as tx
from wartaframe.operators import sentiment
from wartaframe.operators.joins import NARROW, fits_broadcast, numbered
from wartaframe.session import checkpointed

WORD_WEIGHT = "((length(word) * 7) % 11 - 5)::DOUBLE"
PHRASE_WEIGHT = "(length(word) % 7 - 3)::DOUBLE"
# Frequent words and word pairs of the corpus as (word, weight) lexicon entries.
ENTRIES = f"""entries AS (
  SELECT word, {WORD_WEIGHT} AS weight FROM (SELECT unnest(list_distinct(tokens_stemmed)) AS word FROM stemmed)
  GROUP BY word HAVING count(*) >= {P.LEXICON_DOCS}
  UNION ALL
  SELECT word, {PHRASE_WEIGHT} FROM (SELECT unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS word
    FROM (SELECT string_split(text_final, ' ') AS w FROM stemmed)) GROUP BY word HAVING count(*) >= {P.PHRASE_DOCS})"""
STEM_WORDS = f"array_to_string(list_transform(string_split(word, ' '), lambda x: {sql_stem('x')}), ' ')"
LEXICON = f"""{ENTRIES},
stemmed_entries AS (SELECT {STEM_WORDS} AS stem, weight FROM entries),
lex_word AS (SELECT stem AS word, avg(weight) AS weight FROM stemmed_entries WHERE NOT contains(stem, ' ') GROUP BY stem),
lex_phrase AS (SELECT stem AS phrase, weight FROM stemmed_entries WHERE contains(stem, ' '))"""
WORD_SCORES = """word_scores AS (SELECT seq, sum(weight) AS word_score, count(*) AS word_matches
  FROM (SELECT seq, unnest(tokens_stemmed) AS word FROM stemmed) JOIN lex_word USING (word) GROUP BY seq)"""
PHRASE_SCORES = """phrase_scores AS (SELECT seq, sum(weight) AS phrase_score, count(*) AS phrase_matches
  FROM stemmed JOIN lex_phrase ON contains(text_final, phrase) GROUP BY seq)"""


def direction_matches_sql(tokens: str) -> str:
    """List of {entity, word, score} by index arithmetic over the token list."""
    rules = P.RULES
    words = q_in(rules.up + rules.down)
    negative, positive = "|".join(rules.negative_if_up), "|".join(rules.positive_if_up)
    near = (
        f"list_filter(list_concat({tokens}[greatest(i - {rules.window}, 1):i - 1], {tokens}[i + 1:i + {rules.window}]), "
        f"lambda w: regexp_matches(w, '{negative}|{positive}'))[1]"
    )
    each = (
        f"list_transform(list_filter(range(1, len({tokens}) + 1), lambda i: {tokens}[i] IN {words}), "
        f"lambda i: {{'word': {tokens}[i], 'entity': {near}}})"
    )
    found = f"list_filter({each}, lambda m: m.entity IS NOT NULL)"
    sign = (
        f"(CASE WHEN regexp_matches(m.entity, '{negative}') THEN -1 ELSE 1 END * "
        f"CASE WHEN m.word IN {q_in(rules.up)} THEN 1 ELSE -1 END * {rules.weight})::INTEGER"
    )
    return f"list_transform({found}, lambda m: {{'word': m.word, 'entity': m.entity, 'score': {sign}}})"


def direction_score_sql(tokens: str) -> str:
    return f"coalesce(list_sum(list_transform({direction_matches_sql(tokens)}, lambda m: m.score)), 0)::INTEGER"


LABEL = """CASE WHEN {n} = 0 THEN 'Netral' WHEN {s} / {n} > 0.15 THEN 'Positif' WHEN {s} / {n} < -0.15 THEN 'Negatif' ELSE 'Netral' END"""
SCORED = f"""{LEXICON},
{WORD_SCORES},
{PHRASE_SCORES},
totals AS (SELECT s.*, coalesce(word_score, 0) + coalesce(phrase_score, 0) + {direction_score_sql('tokens_stemmed')} AS score,
    (coalesce(word_matches, 0) + coalesce(phrase_matches, 0))::BIGINT AS matches
  FROM stemmed s LEFT JOIN word_scores USING (seq) LEFT JOIN phrase_scores USING (seq)),
scored AS (SELECT *, {LABEL.format(s='score', n='matches')} AS sentiment FROM totals)"""


def entries(docs):
    """Frequent words and pairs of neighbouring words as (word, weight)."""
    least = min(P.LEXICON_DOCS, P.PHRASE_DOCS)
    counted = docs.select(F.explode(F.array_distinct("tokens_stemmed")).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )
    # a token of two words is kept however rare: its parts are words of the text
    counted = checkpointed(counted.filter((F.col("n") >= least) | F.contains("word", F.lit(" "))))

    def weighted(frequent, weight):
        return frequent.select("word", weight.cast("double").alias("weight"))

    words = weighted(counted.filter(F.col("n") >= P.LEXICON_DOCS), F.length("word") * 7 % 11 - 5)
    pairs = frequent_pairs(docs, counted, P.PHRASE_DOCS)
    return words.union(weighted(pairs, F.length("word") % 7 - 3))


def frequent_pairs(docs, counted, least):
    """(word): pairs of neighbouring words that at least so many texts hold.

    A pair is in no more texts than each of its words, so only pairs of the words counted are
    counted; they go through the shuffle as one number, not as a text.
    """
    pairs = docs.select(F.explode(F.array_distinct(tx.ngrams(tx.tokens(F.col("text_final")), 2))).alias("word"))

    def often(rows, key):
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)

    parts = numbered(counted.select(F.explode(F.split("word", " ")).alias("part")).distinct(), "no")
    if not fits_broadcast(parts, NARROW):
        return often(pairs, "word").select("word")

    table = parts.toArrow()
    words, numbers = table.column("part").combine_chunks(), table.column("no").to_numpy()
    copied = docs.sparkSession.sparkContext.broadcast((words, numbers))

    def count(batches):
        for piece in sentiment.pieces_of(batches, "text_final"):
            yield sentiment.counted_pairs(piece.column("text_final"), *copied.value)

    # A text that comes twice counts twice, a pair once in each.
    found = docs.select("text_final").mapInArrow(count, "pair long, n long")
    found = found.groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)

    def named(rows, on, name, part):
        return rows.join(F.broadcast(parts.select(F.col("part").alias(part), F.col("no").alias(name))), on)

    found = found.select(F.shiftright("pair", 32).alias("a_no"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_no"))
    return named(named(found, "a_no", "a_no", "a"), "b_no", "b_no", "b").select(F.concat_ws(" ", "a", "b").alias("word"))


def lexicon(docs):
    """Single words and phrases, each computed once."""
    stems = checkpointed(sentiment.stemmed_lexicon(entries(docs), rules=P.AFFIXES))
    return checkpointed(sentiment.lexicon_words(stems)), sentiment.lexicon_phrases(stems)


#: Between the tokens of a text as it is stored: a token may hold a blank, but no line end.
TOKEN_END = "\n"


def corpus(spark, sf_dir, *more):
    """Stemmed articles with the columns ``more``, stored with their tokens as one text."""
    joined = F.array_join("tokens_stemmed", TOKEN_END).alias("_tokens")
    docs = checkpointed(stemmed(spark, sf_dir).select("seq", *more, joined))
    tokens = F.when(F.col("_tokens") == "", F.array().cast("array<string>")).otherwise(F.split("_tokens", TOKEN_END))
    return docs.select(
        "seq", *more, tokens.alias("tokens_stemmed"), F.translate("_tokens", TOKEN_END, " ").alias("text_final")
    )


def scored(spark, sf_dir, *more):
    docs = corpus(spark, sf_dir, *more)
    words, phrases = lexicon(docs)
    return sentiment.score_articles(docs, words, phrases, P.RULES)


@query(
    "s1_lexicon_words",
    with_ctes(STEMMED, LEXICON) + "SELECT word, round(weight, 6) AS weight FROM lex_word",
)
def lexicon_words(spark, sf_dir):
    return lexicon(corpus(spark, sf_dir))[0].select("word", r6("weight").alias("weight"))


@query(
    "s1_lexicon_phrases",
    with_ctes(STEMMED, LEXICON)
    + "SELECT phrase, round(weight, 6) AS weight, count(*) AS entries FROM lex_phrase GROUP BY ALL",
)
def lexicon_phrases(spark, sf_dir):
    phrases = lexicon(corpus(spark, sf_dir))[1]
    return phrases.groupBy("phrase", r6("weight").alias("weight")).agg(
        F.count(F.lit(1)).alias("entries")
    )


@query(
    "s2_word_match",
    with_ctes(STEMMED, LEXICON, WORD_SCORES)
    + "SELECT seq, round(word_score, 6) AS word_score, word_matches FROM word_scores",
)
def word_match(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return sentiment.word_scores(docs, lexicon(docs)[0]).select(
        "seq", r6("word_score").alias("word_score"), "word_matches"
    )


@query(
    "s3_phrase_match",
    with_ctes(STEMMED, LEXICON, PHRASE_SCORES)
    + "SELECT seq, round(phrase_score, 6) AS phrase_score, phrase_matches FROM phrase_scores",
)
def phrase_match(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return sentiment.phrase_scores(docs, lexicon(docs)[1]).select(
        "seq", r6("phrase_score").alias("phrase_score"), "phrase_matches"
    )


@query(
    "s4_direction_score",
    with_ctes(RAW_TOKENS) + f"SELECT seq, {direction_score_sql('tokens')} AS score FROM raw_tokens",
)
def direction_score(spark, sf_dir):
    return raw_tokens(spark, sf_dir).select(
        "seq", dr.direction_score(F.col("tokens"), P.RULES).alias("score")
    )


@query(
    "s5_direction_trace",
    with_ctes(RAW_TOKENS)
    + f"""SELECT seq, array_to_string(list_transform({direction_matches_sql('tokens')},
  lambda m: m.entity || '+' || m.word || '(' || CASE WHEN m.score >= 0 THEN '+' ELSE '' END || m.score || ')'), '|') AS trace FROM raw_tokens""",
)
def direction_trace(spark, sf_dir):
    trace = dr.direction_trace(F.col("tokens"), P.RULES)
    return raw_tokens(spark, sf_dir).select("seq", F.array_join(trace, "|").alias("trace"))


@query(
    "s6_direction_words",
    with_ctes(RAW_TOKENS)
    + f"""SELECT word, CASE WHEN word IN {q_in(P.RULES.up)} THEN 'up' ELSE 'down' END AS direction, count(*) AS n
FROM (SELECT unnest(tokens) AS word FROM raw_tokens) WHERE word IN {q_in(P.RULES.up + P.RULES.down)} GROUP BY word""",
)
def direction_words(spark, sf_dir):
    word = F.col("word")
    return (
        raw_tokens(spark, sf_dir)
        .select(F.explode("tokens").alias("word"))
        .filter(word.isin(*P.RULES.up, *P.RULES.down))
        .groupBy("word", F.when(word.isin(*P.RULES.up), "up").otherwise("down").alias("direction"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "s7_score_and_matches",
    with_ctes(STEMMED, SCORED) + "SELECT seq, round(score, 6) AS score, matches FROM scored",
)
def score_and_matches(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "seq", r6("sentiment_score_lexicon").alias("score"),
        F.col("jumlah_match_lexicon").alias("matches"),
    )


@query(
    "s8_label",
    with_ctes(STEMMED, SCORED) + "SELECT seq, sentiment FROM scored",
)
def label(spark, sf_dir):
    return scored(spark, sf_dir).select("seq", F.col("sentiment_lexicon").alias("sentiment"))


@query(
    "s9_lexicon_confidence",
    with_ctes(STEMMED, SCORED)
    + """SELECT seq, sentiment, round(least(abs(score) / coalesce(nullif((SELECT max(abs(score)) FROM scored), 0), 1), 1), 6) AS sentiment_score FROM scored""",
)
def lexicon_confidence(spark, sf_dir):
    return sentiment.lexicon_confidence(checkpointed(scored(spark, sf_dir))).select(
        "seq", "sentiment", r6("sentiment_score").alias("sentiment_score")
    )
