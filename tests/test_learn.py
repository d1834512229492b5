import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wartaframe.functions.direction import DirectionRules
from wartaframe.operators import classify, curate, evaluate, features, sentiment
from wartaframe.plans import outputs
from wartaframe.schemas import require_columns
from wartaframe.sources import tables

LABELS = ["Negatif", "Netral", "Positif"]
SAVED_MODEL = [[69, 18, 8], [16, 62, 20], [12, 30, 135]]
FIRST_RUN = [[13, 7, 2], [38, 18, 7], [9, 2, 4]]


def counts_of(spark, matrix):
    rows = [(a, p, n) for a, row in zip(LABELS, matrix) for p, n in zip(LABELS, row)]
    return spark.createDataFrame(rows, "actual string, predicted string, n bigint")


def pairs_of(spark, matrix):
    return counts_of(spark, matrix).filter("n > 0").select(
        "actual", "predicted", F.explode(F.sequence(F.lit(1), F.col("n")))
    )


def test_published_metrics(spark):
    got = evaluate.overall_metrics(counts_of(spark, SAVED_MODEL)).first()
    assert [round(x, 5) for x in got[:4]] == [0.71892, 0.72813, 0.71892, 0.72233]
    got = evaluate.overall_metrics(counts_of(spark, FIRST_RUN)).first()
    assert [round(x, 4) for x in got[:4]] == [0.35, 0.5138, 0.35, 0.3646]
    report = {r.label: r for r in evaluate.full_report(counts_of(spark, FIRST_RUN)).collect()}
    rounded = {k: tuple(round(x, 2) for x in (r.precision, r.recall, r.f1)) + (r.support,) for k, r in report.items()}
    assert rounded == {
        "Negatif": (0.22, 0.59, 0.32, 22),
        "Netral": (0.67, 0.29, 0.40, 63),
        "Positif": (0.31, 0.27, 0.29, 15),
        "macro avg": (0.40, 0.38, 0.33, 100),
        "weighted avg": (0.51, 0.35, 0.36, 100),
    }


def test_confusion_counts_are_complete(spark):
    matrix = [[2, 0, 0], [1, 0, 0], [0, 0, 3]]
    counts = evaluate.confusion_counts(pairs_of(spark, matrix))
    row = evaluate.confusion_matrix(counts).first()
    assert row.labels == LABELS and row.confusion_matrix == matrix
    top = evaluate.top_confusions(counts_of(spark, FIRST_RUN)).collect()
    assert [(r.actual, r.predicted, r.n) for r in top] == [("Netral", "Negatif", 38), ("Positif", "Negatif", 9)]
    never = evaluate.overall_metrics(evaluate.confusion_counts(pairs_of(spark, [[0, 2, 0], [0, 0, 0], [0, 0, 0]]))).first()
    assert (never.accuracy, never.precision, never.f1) == (0.0, 0.0, 0.0)


def test_bands(spark):
    df = spark.createDataFrame([(None,), (0.59,), (0.6,), (0.8,)], "v double")
    bands = [r[0] for r in df.select(evaluate.metric_band(F.col("v"))).collect()]
    assert bands == ["none", "low", "middle", "high"]


@pytest.mark.parametrize("sizes", [(30, 51, 9), (7, 2, 2), (40, 1, 10)])
def test_split_is_exact(spark, sizes):
    rows = [(i, label) for i, label in enumerate(
        label for label, size in zip(LABELS, sizes) for _ in range(size)
    )]
    df = spark.createDataFrame(rows, "seq bigint, label string")
    split = features.stratified_split(df, "label", "seq").collect()
    n = sum(sizes)
    assert len(split) == n and sum(r.is_test for r in split) == math.ceil(0.2 * n)
    if min(sizes) >= 2:
        for label, size in zip(LABELS, sizes):
            share = math.ceil(0.2 * n) * size / n
            assert abs(sum(r.is_test for r in split if r.label == label) - share) < 1


def test_class_rank_is_a_permutation(spark):
    df = spark.range(500).select(F.col("id").alias("seq"), F.lit("x").alias("label"))
    ranks = sorted(r.class_rank for r in features.ranked_in_class(df, "label", "seq").collect())
    assert ranks == list(range(1, 501))


def test_labels_of_scores(spark):
    rows = [(0.15, 1), (0.16, 1), (-0.16, 1), (5.0, 0), (0.4, 2)]
    df = spark.createDataFrame(rows, "s double, n bigint")
    got = [r[0] for r in df.select(sentiment.label_of(F.col("s"), F.col("n"))).collect()]
    assert got == ["Netral", "Positif", "Negatif", "Netral", "Positif"]


def test_lexicon_scores(spark):
    entries = spark.createDataFrame(
        [("baik", 3.0), ("baikan", -1.0), ("sangat baik", 2.0), ("sangat baik", 1.0), ("k naik", 4.0)],
        "word string, weight double",
    )
    stems = sentiment.stemmed_lexicon(entries, rules=((r"^(.{3,})an$", "$1"),))
    words, phrases = sentiment.lexicon_words(stems), sentiment.lexicon_phrases(stems)
    assert {(r.word, r.weight) for r in words.collect()} == {("baik", 1.0)}
    docs = spark.createDataFrame(
        [(1, ["sangat", "baik", "baik"]), (2, ["bak", "naik"]), (3, []), (4, ["sang", "baik"])],
        "seq bigint, tokens_stemmed array<string>",
    ).withColumn("text_final", F.array_join("tokens_stemmed", " "))
    scored = {r.seq: r for r in sentiment.score_articles(docs, words, phrases, DirectionRules()).collect()}
    assert (scored[1].sentiment_score_lexicon, scored[1].jumlah_match_lexicon) == (5.0, 4)
    assert (scored[2].sentiment_score_lexicon, scored[2].jumlah_match_lexicon) == (4.0, 1)
    assert (scored[3].sentiment_score_lexicon, scored[3].sentiment_lexicon) == (0.0, "Netral")
    assert (scored[4].sentiment_score_lexicon, scored[4].jumlah_match_lexicon) == (1.0, 1)
    confidence = sentiment.lexicon_confidence(spark.createDataFrame(list(scored.values()))).collect()
    assert {r.seq: r.sentiment_score for r in confidence} == {1: 1.0, 2: 0.8, 3: 0.0, 4: 0.2}


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_phrases_are_substrings(spark, monkeypatch, broadcast_rows):
    from wartaframe.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(7)
    words = ["ab", "b", "abab", "ba", "aab"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(25)]
    wanted = [" ".join(rng.choice(words) for _ in range(k)) for k in (2, 2, 2, 3, 3, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "seq bigint, text_final string")
    phrases = spark.createDataFrame(
        [(i, p, 1.0) for i, p in enumerate(wanted)], "entry_id bigint, phrase string, weight double"
    )
    got = {(r.seq, r.entry_id) for r in sentiment.phrase_matches(docs, phrases).collect()}
    assert got == {(s, e) for s, t in enumerate(texts) for e, p in enumerate(wanted) if p in t}


def test_label_cleanup_and_upsert(spark):
    df = spark.createDataFrame([(" POSITIF ",), ("pos",), (None,), ("netral\n",)], "x string")
    assert [r[0] for r in df.select(curate.normalise_label(F.col("x"))).collect()] == ["Positif", None, None, "Netral"]
    schema = "text_final string, label_manual string, seq bigint"
    old = spark.createDataFrame([("a", "Positif", 9), ("b", "Netral", 2), ("b", "Negatif", 3)], schema)
    new = spark.createDataFrame([("a", "Negatif", 1), ("c", "Netral", 1)], schema)
    got = {r.text_final: (r.label_manual, r.change) for r in curate.upsert_golden(old, new).collect()}
    assert got == {"a": ("Negatif", "updated"), "b": ("Negatif", "kept"), "c": ("Netral", "inserted")}
    assert curate.upsert_golden(None, new).count() == 2
    first = {r.text_final: r.label_manual for r in tables.labelled_rows(old).collect()}
    assert first == {"a": "Positif", "b": "Netral"}
    assert tuple(curate.remaining_to_train(old).first()) == (3, 27)


def test_annotation_round_trip(spark, tmp_path):
    articles = spark.range(40).select(
        "id", *[F.lit(c).alias(c) for c in ("tanggal", "judul", "source", "url")],
        F.repeat(F.lit("x"), 2000).alias("content"), F.lit("Netral").alias("sentiment"),
        F.lit(0.5).alias("sentiment_score"), F.concat(F.lit("teks "), "id").alias("text_final"),
    )
    outputs.write_annotation(articles, 12, str(tmp_path / "sample"))
    blind = spark.read.parquet(str(tmp_path / "sample/anotasi"))
    hidden = spark.read.parquet(str(tmp_path / "sample/internal"))
    assert blind.count() == hidden.count() == 12 and "sentiment" not in blind.columns
    assert blind.select(F.max(F.length("content"))).first()[0] == 1200
    assert [r.id for r in blind.orderBy("id").collect()] == [r.id for r in hidden.orderBy("id").collect()]
    with pytest.raises(ValueError):
        outputs.evaluate_annotation(blind, hidden)
    label = F.when(F.col("id") % 2 == 0, "positif").otherwise(" Netral ")
    result = outputs.evaluate_annotation(blind.withColumn("label_manual", label), hidden)
    assert result["metrics"].first().rows == 12
    golden = curate.upsert_golden(None, result["labelled"])
    outputs.write_golden(golden, str(tmp_path / "golden"))
    assert spark.read.parquet(str(tmp_path / "golden")).count() == 12
    with pytest.raises(ValueError, match="sentiment"):
        require_columns(blind, ["sentiment"])


def test_train_save_and_precedence(spark, tmp_path):
    rng = random.Random(3)
    marks = {"Positif": ["untung", "tumbuh"], "Negatif": ["rugi", "anjlok"], "Netral": ["rapat", "acara"]}
    rows = []
    for i in range(90):
        label = LABELS[i % 3]
        words = rng.choices(marks[label], k=3) + rng.choices(["satu", "dua", "tiga", "empat"], k=4)
        rows.append((i, " ".join(words), label))
    golden = spark.createDataFrame(rows, "seq bigint, text_final string, label_manual string")
    small, why = classify.train_golden(golden.limit(9))
    assert small is None and not why.first().trained
    settings = classify.SvmSettings(iterations=8)
    model, validation = classify.train_golden(golden, settings)
    metrics = validation.first()
    assert metrics.trained and metrics.f1 > 0.9 and (metrics.train_size, metrics.test_size) == (72, 18)
    outputs.write_model(model, validation, str(tmp_path / "m"))
    loaded, stored = outputs.read_model(spark, str(tmp_path / "m"))
    docs, against = classify.classify(golden.select("seq", "text_final"), loaded, stored)
    assert against.first().evaluated_against == "human labels"
    predicted = docs.collect()
    assert all(0 < r.sentiment_score <= 1 for r in predicted)
    truth = {r[0]: r[2] for r in rows}
    assert sum(r.sentiment == truth[r.seq] for r in predicted) >= 85
    # The model as rows gives the same predictions, bit for bit.
    assert loaded == model == classify.SvmModel.from_tables(*model.tables(spark))
    before = model.predict(classify.with_model_input(golden.select("seq", "text_final")))
    assert {tuple(r) for r in before.select("seq", "sentiment", "sentiment_score").collect()} == {
        (r.seq, r.sentiment, r.sentiment_score) for r in predicted
    }


def test_svms_of_all_blocks_equal_svms_fitted_one_by_one(spark):
    """Each class of the common fit has the objective that a fit of its own reaches."""
    rng = random.Random(8)
    rows = []
    for i in range(120):
        label = LABELS[i * i % 3]
        words = rng.choices(["a" + label, "b" + label, "bb", "cc", "dd", "ee"], k=6)
        rows.append((i, " ".join(words).lower(), label))
    golden = classify.with_model_input(
        spark.createDataFrame(rows, "seq bigint, text_final string, label_manual string")
    )
    settings = classify.SvmSettings(tolerance=1e-7, iterations=400)
    model = classify.fit_svm(golden, "label_manual", settings)
    weighted = golden.join(classify.class_weights(golden, "label_manual").select("label_manual", "weight"), "label_manual")
    x = model.pipeline.transform(weighted).select("features", "weight", "label_manual").collect()
    features = np.array([[*r.features.toArray(), 1.0] for r in x])
    weight = np.array([r.weight for r in x])
    for c in model.classes:
        sign = np.array([1.0 if r.label_manual == c.label else -1.0 for r in x])

        def objective(w):
            return 0.5 * w @ w + settings.penalty * weight @ np.maximum(0, 1 - sign * (features @ w))

        fitted = np.array([*c.terms, c.direction, c.intercept])
        # Plain subgradient descent with falling steps, the best point it sees.
        w, best = np.zeros(len(fitted)), np.inf
        for step in range(1, 6001):
            active = sign * (features @ w) < 1
            w = w - (w - settings.penalty * (weight * sign * active) @ features) / (step + 10)
            best = min(best, objective(w))
        assert objective(fitted) <= best * 1.02
        assert c.slope > 0
