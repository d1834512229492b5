"""Features, splits, classifier and metrics (M)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog import params as P
from catalog.adapter import (
    HUMAN, LABELLED, STEMMED, human_labels, labelled_articles, r6, stemmed, with_ctes,
)
from catalog.registry import query
from catalog.sentiment import SCORED, direction_score_sql, scored
from wartaframe.operators import classify, curate, evaluate, features
from wartaframe.session import checkpointed
from wartaframe.sources import tables

# Words and neighbouring pairs of each document of {source}.
TERMS = """terms AS (SELECT seq, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM (SELECT seq, list_filter(string_split(text_final, ' '), lambda t: length(t) >= 2) AS w FROM {source})),
counts AS (SELECT seq, term, count(*) AS tf FROM terms GROUP BY ALL),
chosen AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM counts GROUP BY term
  HAVING count(*) >= {min_df} AND count(*) <= 0.9 * (SELECT count(*) FROM {source})
  ORDER BY sum(tf) DESC, term LIMIT {max_features}),
raw AS (SELECT seq, term, counts.tf * (ln((1 + (SELECT count(*) FROM {source})) / (1 + df)) + 1) AS raw FROM counts JOIN chosen USING (term)),
weights AS (SELECT seq, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY seq)) AS w FROM raw)"""
GOLDEN = f"""{LABELLED},
golden AS (SELECT * FROM (SELECT seq, text_final, tokens_stemmed, label_manual, row_number() OVER (PARTITION BY text_final ORDER BY seq) AS rn
  FROM labelled) WHERE rn = 1)"""
SPLIT = f"""sizes AS (SELECT label_manual, count(*) AS c, ceil(sum(count(*)) OVER () * 0.2) * count(*) / sum(count(*)) OVER () AS share,
    ceil(sum(count(*)) OVER () * 0.2) AS test_rows FROM golden GROUP BY label_manual),
quotas AS (SELECT label_manual, floor(share) + CASE WHEN row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, label_manual)
    <= test_rows - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM sizes),
split AS (SELECT golden.*, row_number() OVER (PARTITION BY label_manual ORDER BY md5('{P.SEED}:' || seq), seq) <= quota AS is_test
  FROM golden JOIN quotas USING (label_manual))"""


def golden(spark, sf_dir):
    # Stored first: a filter on a text that is still to be made has it made once more.
    texts = checkpointed(labelled_articles(spark, sf_dir).select("seq", "text_final", "label_manual"))
    return checkpointed(tables.labelled_rows(texts))


def golden_split(spark, sf_dir):
    return features.stratified_split(golden(spark, sf_dir), "label_manual", "seq", seed=P.SEED)


@query(
    "m1_corpus_tfidf",
    with_ctes(STEMMED, TERMS.format(source="stemmed", min_df=2, max_features=3000))
    + "SELECT seq, term, round(w, 6) AS w FROM weights",
)
def corpus_tfidf(spark, sf_dir):
    return corpus_weights(stemmed(spark, sf_dir), 3000, min_df=2)


def corpus_weights(docs, max_features, min_df):
    docs = checkpointed(features.with_terms(docs).select("seq", "terms"))
    chosen = checkpointed(features.vocabulary(docs, max_features, min_df))
    return features.tfidf_weights(docs, chosen).select("seq", "term", r6("w").alias("w"))


@query(
    "m2_golden_tfidf",
    with_ctes(GOLDEN, SPLIT, "train AS (SELECT * FROM split WHERE NOT is_test)",
              TERMS.format(source="train", min_df=1, max_features=5000))
    + "SELECT seq, term, round(w, 6) AS w FROM weights",
)
def golden_tfidf(spark, sf_dir):
    train = golden_split(spark, sf_dir).filter("NOT is_test")
    return corpus_weights(train, 5000, min_df=1)


@query(
    "m3_feature_assembly",
    with_ctes(GOLDEN, TERMS.format(source="golden", min_df=1, max_features=5000))
    + f"""SELECT seq, coalesce(n_terms, 0) AS n_terms, round(coalesce(length, 0), 6) AS length,
  {direction_score_sql('tokens_stemmed')}::DOUBLE AS dir_score
FROM golden LEFT JOIN (SELECT seq, count(*) AS n_terms, sqrt(sum(w * w)) AS length FROM weights GROUP BY seq) USING (seq)""",
)
def feature_assembly(spark, sf_dir):
    docs = checkpointed(classify.with_model_input(golden(spark, sf_dir), rules=P.RULES))
    stages = classify.feature_stages(docs, classify.SvmSettings(max_features=5000))
    vectors = docs
    for stage in stages:
        vectors = stage.transform(vectors)
    whole = vector_to_array("features")
    text = F.slice(whole, 1, F.size(whole) - 1)
    squares = F.aggregate(text, F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select(
        "seq",
        F.size(F.filter(text, lambda x: x != 0)).cast("bigint").alias("n_terms"),
        r6(F.sqrt(squares)).alias("length"),
        F.element_at(whole, -1).alias("dir_score"),
    )


@query("m4_stratified_split", with_ctes(GOLDEN, SPLIT) + "SELECT seq, label_manual, is_test FROM split")
def stratified_split(spark, sf_dir):
    return golden_split(spark, sf_dir).select("seq", "label_manual", "is_test")


@query(
    "m5_class_weights",
    with_ctes(HUMAN)
    + """SELECT label_manual, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM human GROUP BY label_manual""",
)
def class_weights(spark, sf_dir):
    return features.class_weights(human_labels(spark, sf_dir), "label_manual").select(
        "label_manual", "n", r6("weight").alias("weight")
    )


@query(
    "m6_linear_svm",
    with_ctes(GOLDEN, SPLIT, """tested AS (SELECT label_manual, count(*) FILTER (is_test) AS n FROM split GROUP BY label_manual)""")
    + """SELECT true AS trained, 'human labels' AS evaluated_against,
  (SELECT count(*) FROM split WHERE NOT is_test) AS train_size, (SELECT count(*) FROM split WHERE is_test) AS test_size,
  (SELECT string_agg(label_manual, ',' ORDER BY label_manual) FROM tested) AS labels,
  (SELECT string_agg(n::VARCHAR, ',' ORDER BY label_manual) FROM tested) AS supports, true AS metrics_in_range""",
)
def linear_svm(spark, sf_dir):
    """The validation row of the model trained on the human labels: sizes, labels, class supports, ranges."""
    row = classify.train_golden(golden(spark, sf_dir), rules=P.RULES)[1]
    supports = F.transform("confusion_matrix", lambda r: F.aggregate(r, F.lit(0).cast("bigint"), lambda s, x: s + x))
    in_range = [F.col(c).between(0.0, 1.0) for c in ("accuracy", "precision", "recall", "f1")]
    return row.select(
        "trained", "evaluated_against", "train_size", "test_size",
        F.array_join("labels", ",").alias("labels"),
        F.array_join(supports.cast("array<string>"), ",").alias("supports"),
        (in_range[0] & in_range[1] & in_range[2] & in_range[3]).alias("metrics_in_range"),
    )


@query(
    "m7_prediction_confidence",
    with_ctes(GOLDEN, SPLIT) + "SELECT seq, is_test, true AS known, true AS in_range FROM split",
)
def prediction_confidence(spark, sf_dir):
    """Each row of the split gets one of the labels and a confidence above 0 and up to 1."""
    split = checkpointed(
        classify.with_model_input(golden_split(spark, sf_dir), rules=P.RULES)
    )
    model = classify.fit_svm(split.filter("NOT is_test"), "label_manual")
    score = F.col("sentiment_score")
    return model.predict(split).select(
        "seq", "is_test", F.col("sentiment").isin(list(model.labels)).alias("known"),
        ((score > 0) & (score <= 1)).alias("in_range"),
    )


@query(
    "m8_training_gates",
    with_ctes(STEMMED, SCORED, HUMAN)
    + """SELECT 'human' AS source, sum(c)::BIGINT AS n, count(*) AS n_label, min(c) AS n_min, sum(c) >= 30 AND count(*) >= 2 AS trainable
  FROM (SELECT count(*) AS c FROM human GROUP BY label_manual)
UNION ALL SELECT 'lexicon', sum(c)::BIGINT, count(*), min(c), sum(c) >= 10 AND count(*) >= 2
  FROM (SELECT count(*) AS c FROM scored GROUP BY sentiment)""",
)
def training_gates(spark, sf_dir):
    human = curate.training_gate(human_labels(spark, sf_dir), "label_manual", 30)
    lexicon = curate.training_gate(scored(spark, sf_dir), "sentiment_lexicon", 10)
    return human.select(F.lit("human").alias("source"), "*").union(
        lexicon.select(F.lit("lexicon").alias("source"), "*")
    )


@query(
    "m9_model_precedence",
    with_ctes(STEMMED, SCORED)
    + """SELECT branch, seq, evaluated_against, true AS known, true AS in_range
FROM scored, (VALUES ('corpus', 'lexicon'), ('saved', 'human labels')) AS b(branch, evaluated_against)""",
)
def model_precedence(spark, sf_dir):
    """Without a saved model the corpus model predicts, with one that model; the row says what it learnt from."""
    docs = checkpointed(scored(spark, sf_dir))
    trained, metrics = classify.train_golden(golden(spark, sf_dir), rules=P.RULES)
    saved = classify.SvmModel.from_tables(*[checkpointed(table) for table in trained.tables(spark)])
    branches = {"corpus": classify.classify(docs, rules=P.RULES), "saved": classify.classify(docs, saved, metrics, rules=P.RULES)}
    score = F.col("sentiment_score")
    rows = [
        predicted.select(
            F.lit(name).alias("branch"), "seq", F.lit(validation.first().evaluated_against).alias("evaluated_against"),
            F.col("sentiment").isin("Negatif", "Netral", "Positif").alias("known"),
            ((score > 0) & (score <= 1)).alias("in_range"),
        )
        for name, (predicted, validation) in branches.items()
    ]
    return rows[0].union(rows[1])


@query(
    "w8_model_terms",
    with_ctes(GOLDEN, SPLIT, "train AS (SELECT * FROM split WHERE NOT is_test)",
              TERMS.format(source="train", min_df=1, max_features=5000))
    + """SELECT term, round(ln((1 + (SELECT count(*) FROM train)) / (1 + df)) + 1, 6) AS idf,
  (SELECT count(DISTINCT label_manual) FROM train)::INTEGER AS n_weights FROM chosen""",
)
def model_terms(spark, sf_dir):
    """Vocabulary of the model trained on the human labels, as its table holds it."""
    terms, _ = classify.train_golden(golden(spark, sf_dir), rules=P.RULES)[0].tables(spark)
    return terms.select("term", r6("idf").alias("idf"), F.size("weights").alias("n_weights"))


@query("w8_model_classes")
def model_classes(spark, sf_dir):
    """Weights beside the vocabulary and the sigmoid of each class: learned, so without SQL."""
    return classify.train_golden(golden(spark, sf_dir), rules=P.RULES)[0].tables(spark)[1]


EVALUATED = f"""{SCORED},
{HUMAN},
pairs AS (SELECT label_manual AS actual, sentiment AS predicted FROM scored JOIN human USING (seq)),
names AS (SELECT actual AS label FROM pairs UNION SELECT predicted FROM pairs),
cm AS (SELECT a.label AS actual, p.label AS predicted, count(pairs.actual) AS n FROM names a JOIN names p ON true
  LEFT JOIN pairs ON pairs.actual = a.label AND pairs.predicted = p.label GROUP BY ALL),
per_class AS (SELECT label, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, hits, support FROM (
  SELECT label, (SELECT sum(n) FROM cm WHERE actual = label AND predicted = label) AS hits,
    (SELECT sum(n) FROM cm WHERE predicted = label) AS predicted, (SELECT sum(n) FROM cm WHERE actual = label)::BIGINT AS support FROM names)),
report AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM per_class)"""
OVERALL = """overall AS (SELECT sum(hits) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision,
  sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1, sum(support)::BIGINT AS rows FROM report)"""


def evaluated(spark, sf_dir):
    pairs = scored(spark, sf_dir).join(human_labels(spark, sf_dir), "seq")
    return checkpointed(evaluate.confusion_counts(pairs, "label_manual", "sentiment_lexicon"))


@query("m10_confusion_matrix", with_ctes(STEMMED, EVALUATED) + "SELECT actual, predicted, n FROM cm")
def confusion_matrix(spark, sf_dir):
    return evaluated(spark, sf_dir)


@query(
    "m10_confusion_wide",
    with_ctes(STEMMED, EVALUATED)
    + """SELECT (SELECT string_agg(label, ',' ORDER BY label) FROM names) AS labels,
  (SELECT string_agg(n::VARCHAR, ',' ORDER BY actual, predicted) FROM cm) AS cells""",
)
def confusion_wide(spark, sf_dir):
    return evaluate.confusion_matrix(evaluated(spark, sf_dir)).select(
        F.array_join("labels", ",").alias("labels"),
        F.array_join(F.flatten("confusion_matrix").cast("array<string>"), ",").alias("cells"),
    )


@query(
    "m11_overall_metrics",
    with_ctes(STEMMED, EVALUATED, OVERALL)
    + "SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, rows FROM overall",
)
def overall_metrics(spark, sf_dir):
    metrics = evaluate.overall_metrics(evaluated(spark, sf_dir))
    return metrics.select(*[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "rows")


FULL_REPORT = """full_report AS (SELECT label, precision, recall, f1, support FROM report
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM report
UNION ALL SELECT 'weighted avg', precision, recall, f1, rows FROM overall)"""


@query(
    "m12_class_report",
    with_ctes(STEMMED, EVALUATED, OVERALL, FULL_REPORT)
    + "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM full_report",
)
def class_report(spark, sf_dir):
    report = evaluate.full_report(evaluated(spark, sf_dir))
    return report.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "m13_top_confusions",
    with_ctes(STEMMED, EVALUATED)
    + "SELECT actual, predicted, n FROM cm WHERE actual <> predicted AND n > 0 ORDER BY n DESC, actual, predicted LIMIT 2",
)
def top_confusions(spark, sf_dir):
    return evaluate.top_confusions(evaluated(spark, sf_dir))


def _band_sql(low: int, high: int) -> str:
    return f"CASE WHEN f1 IS NULL THEN 'none' WHEN f1 * 100 < {low} THEN 'low' WHEN f1 * 100 < {high} THEN 'middle' ELSE 'high' END"


@query(
    "m14_metric_bands",
    with_ctes(STEMMED, EVALUATED)
    + f"SELECT label, {_band_sql(60, 80)} AS strict_band, {_band_sql(50, 70)} AS wide_band FROM report",
)
def metric_bands(spark, sf_dir):
    report = evaluate.class_report(evaluated(spark, sf_dir))
    return report.select(
        "label",
        evaluate.metric_band(F.col("f1")).alias("strict_band"),
        evaluate.metric_band(F.col("f1"), 50, 70).alias("wide_band"),
    )
