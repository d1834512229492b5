"""Topic modelling (T)."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catalog.adapter import STEMMED, r6, stemmed, with_ctes
from catalog.registry import query
from wartaframe.operators import topics
from wartaframe.session import checkpointed

VOCABULARY = """tokens AS (SELECT seq, unnest(tokens_stemmed) AS term FROM stemmed),
vocabulary AS (SELECT term, count(*) AS tf, count(DISTINCT seq) AS df FROM tokens WHERE length(term) > 2 GROUP BY term
  HAVING count(DISTINCT seq) >= 2 AND count(DISTINCT seq) <= 0.6 * (SELECT count(*) FROM stemmed) ORDER BY df DESC, term LIMIT 100000)"""
# Given topics of 20 words: the most widespread terms dealt out in turn.
GIVEN = """dealt AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS place FROM vocabulary),
words AS (SELECT (place % {k})::INTEGER AS topic, (place // {k} + 1)::INTEGER AS rank, term FROM dealt WHERE place < 20 * {k})"""
LABEL = """list_transform({words}[1:3], lambda w: upper(left(w, 1)) || lower(w[2:]))"""
DEFINITIONS = f"""definitions AS (SELECT topic AS id, array_to_string({LABEL.format(words='w')}, ' & ') AS label, w[1:8] AS terms
  FROM (SELECT topic, list(term ORDER BY rank) AS w FROM words WHERE rank <= 10 GROUP BY topic)),
assigned AS (SELECT *, (seq % 5 - 1)::INTEGER AS topik_dominan FROM stemmed)"""
ALL = with_ctes(STEMMED, VOCABULARY, GIVEN.format(k=5), DEFINITIONS)


def corpus(spark, sf_dir):
    return checkpointed(stemmed(spark, sf_dir).select("seq", "tokens_stemmed"))


def widespread(docs, n):
    """(place, term): the n most widespread terms from place 0 on."""
    chosen = topics.topic_vocabulary(docs).limit(n).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("df")).alias("df"), "term"))
        ).alias("w")
    )
    return chosen.select(F.posexplode("w.term").alias("place", "term"))


def dealt(places, k):
    """(topic, rank, term): the first 20 terms a topic, dealt out in turn to k topics."""
    return places.filter(F.col("place") < 20 * k).select(
        (F.col("place") % k).alias("topic"),
        (F.floor(F.col("place") / k) + 1).cast("int").alias("rank"),
        "term",
    )


def given_words(docs, k):
    return checkpointed(dealt(widespread(docs, 20 * k), k))


def assigned(docs):
    """Given topics: -1 and 0 to 3; topic 4 stays empty."""
    return docs.withColumn("topik_dominan", (F.col("seq") % 5 - 1).cast("int"))


@query("t1_topic_vocabulary", with_ctes(STEMMED, VOCABULARY) + "SELECT term, tf, df FROM vocabulary")
def topic_vocabulary(spark, sf_dir):
    return topics.topic_vocabulary(stemmed(spark, sf_dir))


@query(
    "t2_bag_of_words",
    with_ctes(STEMMED, VOCABULARY)
    + "SELECT seq, term, count(*) AS n FROM tokens WHERE term IN (SELECT term FROM vocabulary) GROUP BY ALL",
)
def bag_of_words(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return topics.bag_of_words(docs, checkpointed(topics.topic_vocabulary(docs)))


@query(
    "t3_topic_guard",
    with_ctes(STEMMED, VOCABULARY)
    + """SELECT (SELECT count(*) FROM vocabulary) AS n_terms, count(*) AS n_docs,
  (SELECT count(*) FROM vocabulary) >= 5 AND count(*) >= 10 AS usable FROM stemmed""",
)
def topic_guard(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return topics.topic_guard(docs, topics.topic_vocabulary(docs))


@query(
    "t4_candidate_counts",
    "SELECT unnest(generate_series(3, 7))::INTEGER AS k, count(*) AS n_docs FROM documents HAVING count(*) > 7",
)
def candidate_counts(spark, sf_dir):
    n = stemmed(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_docs"))
    ks = topics.candidate_topic_counts(n.first().n_docs)
    return n.select(F.explode(F.lit(ks)).alias("k"), "n_docs")


def fitted(spark, sf_dir, k):
    docs = corpus(spark, sf_dir)
    terms = topics.topic_vocabulary(docs).collect()
    words = [r.term for r in sorted(terms, key=lambda r: (-r.df, r.term))]
    counter = CountVectorizerModel.from_vocabulary(words, inputCol="tokens_stemmed", outputCol="bow")
    vectors = checkpointed(counter.transform(topics.topic_tokens(docs)).select("seq", "bow"))
    return topics.fit_lda(vectors, k), vectors, words


@query("t5_lda_assignments", "SELECT doc_id AS seq, true AS in_range FROM documents")
def lda_assignments(spark, sf_dir):
    """Every document has a dominant topic of the fitted model; blank ones take the prior's."""
    from pyspark.ml.functions import vector_to_array

    model, vectors, _ = fitted(spark, sf_dir, 4)
    prior = model.estimatedDocConcentration().toArray()
    dominant = topics.dominant_topic(vector_to_array("topicDistribution"), F.lit(int(prior.argmax())))
    topic = model.transform(vectors).select("seq", dominant.alias("topik_dominan"))
    return topic.select("seq", F.col("topik_dominan").between(0, 3).alias("in_range"))


# An occurrence at position p lies in the windows that start at p - 109 to p.
COHERENCE = """lengths AS (SELECT seq, greatest(len(tokens_stemmed) - 109, 1) AS starts FROM stemmed),
total AS (SELECT sum(starts) AS n FROM lengths),
occurrences AS (SELECT seq, unnest(tokens_stemmed) AS term, unnest(range(1, len(tokens_stemmed) + 1)) AS p FROM stemmed),
inside AS (SELECT DISTINCT seq, term, unnest(generate_series(greatest(p - 109, 1), least(p, starts))) AS start
  FROM occurrences JOIN lengths USING (seq) WHERE term IN (SELECT term FROM words)),
sets AS (SELECT found, count(*) AS n FROM (SELECT list(term ORDER BY term) AS found FROM inside GROUP BY seq, start) GROUP BY found),
single AS (SELECT term, sum(n) / (SELECT n FROM total) AS p FROM (SELECT unnest(found) AS term, n FROM sets) GROUP BY term),
pair AS (SELECT a, b, sum(n) / (SELECT n FROM total) AS p FROM
  (SELECT a, unnest(found) AS b, n FROM (SELECT unnest(found) AS a, found, n FROM sets)) GROUP BY a, b),
cells AS (SELECT x.topic, x.term AS a, y.term AS b,
    coalesce(ln((coalesce(pair.p, 0) + 1e-12::DOUBLE) / (sa.p * sb.p)) / -ln(coalesce(pair.p, 0) + 1e-12::DOUBLE), 0) AS v
  FROM words x JOIN words y ON x.topic = y.topic LEFT JOIN single sa ON sa.term = x.term LEFT JOIN single sb ON sb.term = y.term
  LEFT JOIN pair ON pair.a = x.term AND pair.b = y.term),
sums AS (SELECT topic, b, sum(v) AS s FROM cells GROUP BY topic, b),
cosines AS (SELECT cells.topic, a, coalesce(sum(v * s) / nullif(sqrt(sum(v * v)) * sqrt(sum(s * s)), 0), 0) AS c
  FROM cells JOIN sums ON cells.topic = sums.topic AND cells.b = sums.b GROUP BY cells.topic, a)"""


@query(
    "t6_coherence",
    with_ctes(STEMMED, VOCABULARY, GIVEN.format(k=3), COHERENCE)
    + "SELECT topic, round(avg(c), 6) AS coherence FROM cosines GROUP BY topic",
)
def coherence(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return topics.coherence(docs, given_words(docs, 3)).select("topic", r6("coherence").alias("coherence"))


BOTH_COUNTS = """dealt AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS place FROM vocabulary),
words AS (SELECT k * 100 + place % k AS topic, term FROM dealt, (VALUES (3), (4), (5), (6), (7)) AS ks(k) WHERE place < 20 * k)"""


@query(
    "t7_model_selection",
    with_ctes(STEMMED, VOCABULARY, BOTH_COUNTS, COHERENCE)
    + """SELECT (topic // 100)::INTEGER AS k, round(avg(score), 6) AS coherence
FROM (SELECT topic, avg(c) AS score FROM cosines GROUP BY topic) GROUP BY k ORDER BY coherence DESC, k LIMIT 1""",
)
def model_selection(spark, sf_dir):
    """The topic count with the highest coherence among given partitions of the words.

    The topics of all counts are measured in one pass over the texts: topic t of k is k * 100 + t.
    """
    docs = corpus(spark, sf_dir)
    places = checkpointed(widespread(docs, 20 * max(topics.CANDIDATE_TOPICS)))
    words = None
    for k in topics.CANDIDATE_TOPICS:
        part = dealt(places, k).select((F.col("topic") + k * 100).alias("topic"), "term")
        words = part if words is None else words.union(part)
    means = (
        topics.coherence(docs, checkpointed(words))
        .groupBy(F.floor(F.col("topic") / 100).cast("int").alias("k"))
        .agg(r6(F.avg("coherence")).alias("coherence"))
    )
    counts = spark.range(1).select(F.explode(F.lit(list(topics.CANDIDATE_TOPICS))).alias("k"))
    return topics.best_topic_count(counts.join(F.broadcast(means), "k", "left"))


@query(
    "t8_dominant_topic",
    with_ctes(STEMMED, """dist AS (SELECT seq, len(tokens_stemmed) AS n, list_transform(['t', 'e', 'a', 'o'], lambda c:
    len(list_filter(tokens_stemmed, lambda w: starts_with(w, c))) / greatest(len(tokens_stemmed), 1)) AS d FROM stemmed)""")
    + """SELECT seq, CASE WHEN list_max(d) >= 0.01 THEN list_position(d, list_max(d)) - 1 ELSE -1 END::INTEGER AS topik_dominan FROM dist""",
)
def dominant_topic(spark, sf_dir):
    """Given vectors: the shares of four initial letters."""
    words = F.col("tokens_stemmed")

    def share(letter):
        starting = F.filter(words, lambda w: F.startswith(w, F.lit(letter)))
        return F.size(starting) / F.greatest(F.size(words), F.lit(1))

    shares = F.array(*[share(letter) for letter in "teao"])
    return stemmed(spark, sf_dir).select("seq", topics.dominant_topic(shares).alias("topik_dominan"))


@query(
    "t9_topic_terms",
    "SELECT unnest(range(4))::INTEGER AS id, 8 AS n_terms, true AS labelled, true AS known, true AS falling",
)
def topic_terms(spark, sf_dir):
    """Each topic has 8 different terms of the vocabulary, heaviest first, and its label is made of them."""
    model, _, words = fitted(spark, sf_dir, 4)
    ranked = topics.topic_words(model, words, 10)
    lag = F.lag("weight").over(W.partitionBy("topic").orderBy("rank"))
    falling = ranked.withColumn("falls", F.coalesce(F.col("weight") <= lag, F.lit(True))).groupBy("topic").agg(
        F.min("falls").alias("falling"), F.collect_set("term").alias("ten")
    )
    first = F.lower(F.substring_index("label", " & ", 1))
    return topics.topic_definitions(ranked).join(falling, F.col("id") == F.col("topic")).select(
        "id",
        F.size(F.array_distinct("terms")).alias("n_terms"),
        (first == F.get("terms", F.lit(0))).alias("labelled"),
        (F.size(F.array_except("terms", "ten")) == 0).alias("known"),
        "falling",
    )


@query("t10_topic_labels", ALL + "SELECT id, label, array_to_string(terms, ', ') AS terms FROM definitions")
def topic_labels(spark, sf_dir):
    return topics.topic_definitions(given_words(corpus(spark, sf_dir), 5)).select(
        "id", "label", F.array_join("terms", ", ").alias("terms")
    )


@query(
    "t11_sample_titles",
    ALL
    + """SELECT topik_dominan, string_agg(judul, '|' ORDER BY seq) AS titles FROM
(SELECT *, row_number() OVER (PARTITION BY topik_dominan ORDER BY seq) AS rn FROM assigned) WHERE rn <= 5 GROUP BY topik_dominan""",
)
def sample_titles(spark, sf_dir):
    return topics.sample_titles(assigned(stemmed(spark, sf_dir))).select(
        "topik_dominan", F.array_join("titles", "|").alias("titles")
    )


SUMMARY = """SELECT id, label, array_to_string(terms, ', ') AS terms, count(seq) AS jumlah_berita,
  round_even(count(seq) * 100.0::DOUBLE / (SELECT count(*) FROM assigned), 1) AS share
FROM definitions LEFT JOIN assigned ON topik_dominan = id GROUP BY ALL"""


@query("t12_topic_summary", ALL + SUMMARY)
def topic_summary(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    rows = topics.topic_summary(assigned(docs), topics.topic_definitions(given_words(docs, 5)))
    return rows.withColumn("terms", F.array_join("terms", ", "))


LABELLED_TOPICS = "SELECT seq, coalesce(label, 'Lainnya') AS label_topik FROM assigned LEFT JOIN definitions ON id = topik_dominan"


@query("t13_label_back_map", ALL + LABELLED_TOPICS)
def label_back_map(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    definitions = topics.topic_definitions(given_words(docs, 5))
    return topics.with_topic_label(assigned(docs), definitions).select("seq", "label_topik")


CATEGORIES = f"SELECT label_topik AS name, count(*) AS value FROM ({LABELLED_TOPICS}) GROUP BY label_topik"


def categories_of(docs):
    definitions = topics.topic_definitions(given_words(docs, 5))
    return topics.category_counts(topics.with_topic_label(assigned(docs), definitions))


@query("t14_category_counts", ALL + CATEGORIES)
def category_counts(spark, sf_dir):
    return categories_of(corpus(spark, sf_dir))
