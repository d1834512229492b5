"""LDA topics: fitting, coherence, model choice and topic tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wartaframe.functions import fixed_values as fixed
from wartaframe.operators.features import chosen_counts, term_frequencies
from wartaframe.operators.joins import fits_broadcast, join_lookup
from wartaframe.session import checkpointed

NO_BELOW = 2
NO_ABOVE = 0.6
KEEP_TERMS = 100_000
MIN_VOCABULARY = 5
MIN_DOCUMENTS = 10
CANDIDATE_TOPICS = (3, 4, 5, 6, 7)
PASSES = 5
BATCH_SHARE = 0.25
COHERENCE_WORDS = 20
COHERENCE_WINDOW = 110
RUN_CELL = 1_024
EPSILON = 1e-12
MIN_PROBABILITY = 0.01


def topic_tokens(docs: DataFrame, tokens: str = "tokens_stemmed") -> DataFrame:
    return docs.withColumn(tokens, F.filter(tokens, lambda t: F.length(t) > 2))


def topic_vocabulary(
    docs: DataFrame, tokens: str = "tokens_stemmed", keep_terms: int = KEEP_TERMS
) -> DataFrame:
    """(term, tf, df): terms in at least 2 and at most 60 % of the documents.

    Of more than ``keep_terms`` the most widespread ones stay: an LDA model holds
    its whole vocabulary, so that number bounds the model.
    """
    limit = docs.agg(F.count(F.lit(1)) * F.lit(NO_ABOVE)).scalar()
    return (
        term_frequencies(topic_tokens(docs, tokens), tokens)
        .filter((F.col("df") >= NO_BELOW) & (F.col("df") <= limit))
        .orderBy(F.desc("df"), "term")
        .limit(keep_terms)
    )


def bag_of_words(docs: DataFrame, vocabulary: DataFrame, tokens: str = "tokens_stemmed") -> DataFrame:
    """(seq, term, n) over the vocabulary."""
    counts = chosen_counts(topic_tokens(docs, tokens), vocabulary, tokens)
    return counts.select("seq", "term", F.col("tf").alias("n"))


def topic_guard(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row: vocabulary size, documents, and whether topics can be found."""
    size = vocabulary.agg(F.count(F.lit(1))).scalar()
    return docs.agg(F.count(F.lit(1)).alias("n_docs")).select(
        size.alias("n_terms"),
        "n_docs",
        ((size >= MIN_VOCABULARY) & (F.col("n_docs") >= MIN_DOCUMENTS)).alias("usable"),
    )


def candidate_topic_counts(n_docs: int, candidates: Iterable[int] = CANDIDATE_TOPICS) -> list[int]:
    return [k for k in candidates if k < n_docs] or [2]


def fit_lda(vectors: DataFrame, k: int, seed: int = fixed.SEED, passes: int = PASSES) -> LDAModel:
    """Online variational LDA with a learned document prior."""
    lda = LDA(
        k=k,
        featuresCol="bow",
        optimizer="online",
        optimizeDocConcentration=True,
        subsamplingRate=BATCH_SHARE,
        maxIter=round(passes / BATCH_SHARE),
        seed=seed,
    )
    return lda.fit(vectors)


def topic_words(model: LDAModel, words: list[str], n: int = COHERENCE_WORDS) -> DataFrame:
    """(topic, rank, term, weight): the n heaviest terms of each topic, rank from 1."""
    # k topics of n terms each: a tiny table whose indices the driver resolves.
    rows = [
        (r.topic, i + 1, words[t], float(w))
        for r in model.describeTopics(n).collect()
        for i, (t, w) in enumerate(zip(r.termIndices, r.termWeights))
    ]
    return SparkSession.active().createDataFrame(
        rows, "topic int, rank int, term string, weight double"
    )


def window_runs(
    docs: DataFrame,
    words: DataFrame,
    tokens: str = "tokens_stemmed",
    window: int = COHERENCE_WINDOW,
) -> DataFrame:
    """(seq, term, a, b): runs of sliding windows that hold a topic word.

    Windows are numbered by their first token. A word at position p is in the
    windows p - window + 1 to p; overlapping runs of a word are joined. ``words``
    (term) is the short list of topic words.
    """
    occurrences = docs.select(
        "seq", _window_count(tokens, window).alias("last"), F.posexplode(tokens).alias("at", "term")
    )
    runs = join_lookup(occurrences, words.select("term").distinct(), "term").select(
        "seq",
        "term",
        F.greatest(F.col("at") + 2 - window, F.lit(1)).alias("a"),
        F.least(F.col("at") + 1, F.col("last")).alias("b"),
    )
    ordered = W.partitionBy("seq", "term").orderBy("b", "a")
    gap = F.when(F.col("a") > F.lag("b").over(ordered) + 1, 1).otherwise(0)
    return (
        runs.withColumn("gap", gap)
        .withColumn("run", F.sum("gap").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("seq", "term", "run")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"))
        .drop("run")
    )


def _window_count(tokens: str, window: int) -> Column:
    """A text shorter than the window is one window."""
    return F.greatest(F.size(tokens) - (window - 1), F.lit(1))


def shared_windows(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(topic, a, b, n): windows that hold two different words of a topic, a < b.

    Runs are cut at fixed places, so words meet only near each other and the
    work grows with the length of a text, not with its square.
    """
    listed = words.select("topic", "term")
    listed = F.broadcast(listed) if fits_broadcast(listed) else listed
    first, last = F.floor(F.col("a") / RUN_CELL), F.floor(F.col("b") / RUN_CELL)
    cut = (
        runs.join(listed, "term")
        .withColumn("cell", F.explode(F.sequence(first, last)))
        .select(
            "seq", "topic", "cell", "term",
            F.greatest(F.col("a"), F.col("cell") * RUN_CELL).alias("a"),
            F.least(F.col("b"), (F.col("cell") + 1) * RUN_CELL - 1).alias("b"),
        )
    )
    left, right = cut.alias("l"), cut.alias("r")
    meets = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("seq", "topic", "cell")]
    overlap = F.least("l.b", "r.b") - F.greatest("l.a", "r.a") + 1
    return (
        left.join(right, [*meets, F.col("l.term") < F.col("r.term"), overlap > 0])
        .groupBy("l.topic", F.col("l.term").alias("a"), F.col("r.term").alias("b"))
        .agg(F.sum(overlap).alias("n"))
    )


def coherence(
    docs: DataFrame,
    words: DataFrame,
    tokens: str = "tokens_stemmed",
    window: int = COHERENCE_WINDOW,
) -> DataFrame:
    """(topic, coherence): the c_v measure (Roeder, Both, Hinneburg, WSDM 2015).

    ``words`` holds (topic, term), a few topics of about 20 words. Each word's
    vector of NPMI values with all words of its topic is compared by cosine with
    the sum of those vectors.
    """
    words = words.select("topic", "term").distinct()
    runs = checkpointed(window_runs(docs, words, tokens, window))
    total = docs.agg(F.sum(_window_count(tokens, window))).scalar()
    length = F.col("b") - F.col("a") + 1
    singles = runs.groupBy("term").agg(F.sum(length).alias("n"))
    singles = checkpointed(singles.select("term", (F.col("n") / total).alias("p")))
    met = checkpointed(
        shared_windows(runs, words).select("topic", "a", "b", (F.col("n") / total).alias("p_ab"))
    )
    own = words.join(singles, "term").select(
        "topic", F.col("term").alias("a"), F.col("term").alias("b"), F.col("p").alias("p_ab")
    )
    mirrored = met.select("topic", F.col("b").alias("a"), F.col("a").alias("b"), "p_ab")
    pairs = met.union(mirrored).union(own)
    # At most (topics x words) squared rows from here on.
    left = words.select("topic", F.col("term").alias("a"))
    right = words.select("topic", F.col("term").alias("b"))
    both = F.coalesce("p_ab", F.lit(0.0))
    npmi = F.log((both + EPSILON) / (F.col("p_a") * F.col("p_b"))) / -F.log(both + EPSILON)
    cells = (
        left.join(right, "topic")
        .join(singles.select(F.col("term").alias("a"), F.col("p").alias("p_a")), "a", "left")
        .join(singles.select(F.col("term").alias("b"), F.col("p").alias("p_b")), "b", "left")
        .join(pairs, ["topic", "a", "b"], "left")
        .select("topic", "a", "b", F.coalesce(npmi, F.lit(0.0)).alias("v"))
    )
    summed = cells.groupBy("topic", "b").agg(F.sum("v").alias("s"))
    norms = summed.groupBy("topic").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    cosines = (
        cells.join(summed, ["topic", "b"])
        .groupBy("topic", "a")
        .agg(F.sum(F.col("v") * F.col("s")).alias("dot"),
             F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("own"))
        .join(norms, "topic")
        .select("topic", F.coalesce(
            F.col("dot") / F.nullif(F.col("own") * F.col("norm"), F.lit(0.0)), F.lit(0.0)
        ).alias("cosine"))
    )
    return cosines.groupBy("topic").agg(F.avg("cosine").alias("coherence"))


def best_topic_count(scores: DataFrame) -> DataFrame:
    """The (k, coherence) row with the highest coherence, the smallest k on ties."""
    return scores.orderBy(F.desc("coherence"), "k").limit(1)


def dominant_topic(distribution: Column, fallback: int | Column = -1) -> Column:
    """0-based index of the largest probability; tiny ones do not count."""
    largest = F.array_max(distribution)
    position = (F.array_position(distribution, largest) - 1).cast("int")
    return F.when(largest >= MIN_PROBABILITY, position).otherwise(fallback)


def statistical_label(words: Column, n: int = 3) -> Column:
    """The first words capitalised and joined, or 'Lainnya'."""
    named = F.transform(
        F.filter(F.slice(words, 1, n), lambda w: w != ""),
        lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.right(w, F.length(w) - 1))),
    )
    return F.coalesce(F.nullif(F.array_join(named, " & "), F.lit("")), F.lit(fixed.OTHER_TOPIC))


def topic_definitions(words: DataFrame, published: int = 8, listed: int = 10) -> DataFrame:
    """(id, label, terms) from (topic, rank, term)."""
    lists = (
        words.filter(F.col("rank") <= listed)
        .groupBy(F.col("topic").alias("id"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("w"))
    )
    return lists.select(
        "id",
        statistical_label(F.col("w.term")).alias("label"),
        F.slice("w.term", 1, published).alias("terms"),
    )


def sample_titles(docs: DataFrame, n: int = 5) -> DataFrame:
    """(topik_dominan, titles): first titles of each topic in row order."""
    place = F.row_number().over(W.partitionBy("topik_dominan").orderBy("seq"))
    # The rank filter lets each task keep n rows per topic before the shuffle.
    firsts = docs.select("topik_dominan", "seq", "judul").withColumn("rank", place)
    return (
        firsts.filter(F.col("rank") <= n)
        .groupBy("topik_dominan")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "judul"))).alias("t"))
        .select("topik_dominan", F.col("t.judul").alias("titles"))
    )


def topic_summary(docs: DataFrame, definitions: DataFrame) -> DataFrame:
    """(id, label, terms, jumlah_berita, share), largest first, then by id."""
    total = docs.agg(F.count(F.lit(1))).scalar()
    counts = docs.groupBy(F.col("topik_dominan").alias("id")).agg(
        F.count(F.lit(1)).alias("jumlah_berita")
    )
    n = F.coalesce("jumlah_berita", F.lit(0)).cast("bigint")
    share = F.coalesce(F.bround(n / F.nullif(total, F.lit(0)) * 100, 1), F.lit(0.0))
    return (
        definitions.join(counts, "id", "left")
        .select("id", "label", "terms", n.alias("jumlah_berita"), share.alias("share"))
        .orderBy(F.desc("jumlah_berita"), "id")
    )


def with_topic_label(docs: DataFrame, definitions: DataFrame) -> DataFrame:
    """Add ``label_topik``; rows without a known topic get 'Lainnya'."""
    labels = definitions.select(F.col("id").alias("topik_dominan"), F.col("label").alias("_label"))
    return join_lookup(docs, labels, "topik_dominan", "left").select(
        *docs.columns, F.coalesce("_label", F.lit(fixed.OTHER_TOPIC)).alias("label_topik")
    )


def category_counts(docs: DataFrame) -> DataFrame:
    """(name, value): articles per topic label, equal labels together."""
    return (
        docs.groupBy(F.col("label_topik").alias("name"))
        .agg(F.count(F.lit(1)).alias("value"))
        .orderBy(F.desc("value"), "name")
    )


def model_topics(
    docs: DataFrame,
    tokens: str = "tokens_stemmed",
    candidates: Iterable[int] = CANDIDATE_TOPICS,
    passes: int = PASSES,
    seed: int = fixed.SEED,
    keep_terms: int = KEEP_TERMS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles with ``topik_dominan`` and ``label_topik``, topic rows, category rows.

    Topics are learnt from the ``keep_terms`` most widespread terms at most.
    """
    spark = docs.sparkSession
    terms = checkpointed(topic_vocabulary(docs, tokens, keep_terms))
    guard = topic_guard(docs, terms).first()
    if not guard.usable:
        plain = docs.withColumn("topik_dominan", F.lit(-1)).withColumn(
            "label_topik", F.lit(fixed.OTHER_TOPIC)
        )
        topics = spark.createDataFrame(
            [], "id int, label string, terms array<string>, jumlah_berita bigint, share double"
        )
        return plain, topics, spark.createDataFrame([], "name string, value bigint")
    # The vocabulary is bounded by keep_terms, and the LDA model holds it anyway.
    words = [r.term for r in terms.orderBy(F.desc("df"), "term").collect()]
    counter = CountVectorizerModel.from_vocabulary(words, inputCol=tokens, outputCol="bow")
    vectors = checkpointed(counter.transform(topic_tokens(docs, tokens)).select("seq", tokens, "bow"))
    fitted = {}
    scores = {}
    for k in candidate_topic_counts(guard.n_docs, candidates):
        fitted[k] = fit_lda(vectors, k, seed, passes)
        per_topic = coherence(vectors, topic_words(fitted[k], words), tokens)
        scores[k] = per_topic.agg(F.avg("coherence")).first()[0]
    best = max(scores, key=lambda k: (scores[k] if scores[k] is not None else -1.0, -k))
    model = fitted[best]
    prior = model.estimatedDocConcentration().toArray()
    dominant = dominant_topic(vector_to_array("topicDistribution"), F.lit(int(prior.argmax())))
    assigned = model.transform(vectors).select("seq", dominant.alias("topik_dominan"))
    definitions = checkpointed(topic_definitions(topic_words(model, words, 10)))
    labelled = checkpointed(with_topic_label(docs.join(assigned, "seq"), definitions))
    return labelled, topic_summary(labelled, definitions), category_counts(labelled)
