import math
import random
from collections import Counter

from pyspark.sql import functions as F

from wartaframe.operators import keywords, report, topics


def brute_coherence(docs, topic, window):
    sets = []
    for d in docs:
        for s in range(max(1, len(d) - window + 1)):
            sets.append(set(d[s : s + window]) & set(topic))
    n = len(sets)
    p = {w: sum(w in s for s in sets) / n for w in topic}

    def npmi(a, b):
        if not p[a] or not p[b]:
            return 0.0
        both = sum(a in s and b in s for s in sets) / n
        return math.log((both + 1e-12) / (p[a] * p[b])) / -math.log(both + 1e-12)

    rows = {a: [npmi(a, b) for b in topic] for a in topic}
    total = [sum(col) for col in zip(*rows.values())]

    def cosine(x, y):
        norm = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
        return sum(a * b for a, b in zip(x, y)) / norm if norm else 0.0

    return sum(cosine(v, total) for v in rows.values()) / len(topic)


def test_coherence_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topics, "RUN_CELL", 16)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    docs = [[rng.choice(words) for _ in range(rng.choice([0, 3, 9, 40, 90]))] for _ in range(25)]
    chosen = {0: words[:6], 1: words[4:10], 2: words[10:14]}
    df = spark.createDataFrame(list(enumerate(docs)), "seq bigint, tokens_stemmed array<string>")
    given = spark.createDataFrame([(k, w) for k, ws in chosen.items() for w in ws], "topic int, term string")
    got = {r.topic: r.coherence for r in topics.coherence(df, given, window=10).collect()}
    for k, ws in chosen.items():
        assert abs(got[k] - brute_coherence(docs, ws, 10)) < 1e-9


def test_vocabulary_and_bag(spark):
    docs = [["aaa", "aaa", "bbb", "xx"], ["aaa", "ccc"], ["ddd", "ccc", "bbb"], ["eee"], ["fff"]]
    df = spark.createDataFrame(list(enumerate(docs)), "seq bigint, tokens_stemmed array<string>")
    terms = topics.topic_vocabulary(df)
    assert {(r.term, r.tf, r.df) for r in terms.collect()} == {("aaa", 3, 2), ("bbb", 2, 2), ("ccc", 2, 2)}
    bag = {(r.seq, r.term, r.n) for r in topics.bag_of_words(df, terms).collect()}
    assert bag == {(0, "aaa", 2), (0, "bbb", 1), (1, "aaa", 1), (1, "ccc", 1), (2, "ccc", 1), (2, "bbb", 1)}
    assert not topics.topic_guard(df, terms).first().usable
    plain, none, categories = topics.model_topics(df)
    assert {r.label_topik for r in plain.collect()} == {"Lainnya"}
    assert none.count() == categories.count() == 0
    assert topics.candidate_topic_counts(5) == [3, 4] and topics.candidate_topic_counts(2) == [2]


def test_dominant_topic_and_labels(spark):
    df = spark.createDataFrame([([0.2, 0.8],), ([0.0, 0.0],), ([0.5, 0.5],)], "d array<double>")
    assert [r[0] for r in df.select(topics.dominant_topic(F.col("d"))).collect()] == [1, -1, 0]
    words = spark.createDataFrame([(["inflasi", "HARGA", "pangan", "x"],), ([],)], "w array<string>")
    labels = [r[0] for r in words.select(topics.statistical_label(F.col("w"))).collect()]
    assert labels == ["Inflasi & Harga & Pangan", "Lainnya"]


def test_model_topics(spark):
    rng = random.Random(1)
    themes = [["beras", "cabai", "harga", "pasar"], ["saham", "bursa", "modal", "indeks"], ["banjir", "hujan", "sungai", "warga"]]
    rows = [(i, f"judul {i}", [rng.choice(themes[i % 3]) for _ in range(12)]) for i in range(30)]
    df = spark.createDataFrame(rows, "seq bigint, judul string, tokens_stemmed array<string>")
    labelled, found, categories = topics.model_topics(df, candidates=(2, 3), passes=1)
    assert labelled.count() == 30 and labelled.filter("topik_dominan < 0").count() == 0
    found = found.collect()
    assert len(found) in (2, 3) and sum(r.jumlah_berita for r in found) == 30
    assert [r.jumlah_berita for r in found] == sorted((r.jumlah_berita for r in found), reverse=True)
    assert sum(r.value for r in categories.collect()) == 30
    titles = {r.topik_dominan: r.titles for r in topics.sample_titles(labelled, 2).collect()}
    assert all(len(t) <= 2 for t in titles.values())


def test_top_ngrams_keep_first_appearance_on_ties(spark):
    texts = {3: "a b a b", 1: "c d", 2: None, 4: "", 5: "d c d"}
    df = spark.createDataFrame(list(texts.items()), "seq bigint, text_final string")
    got = [(r.kata, r.frekuensi) for r in keywords.top_ngrams(df, 2, 10).collect()]
    assert got == [("c d", 2), ("a b", 2), ("b a", 1), ("d c", 1)]
    grams = Counter()
    for text in texts.values():
        words = (text or "").split()
        grams.update(" ".join(words[i : i + 2]) for i in range(len(words) - 1))
    assert dict(got) == grams
    assert keywords.top_ngrams(df.filter("seq = 4"), 2).count() == 0
    flat = spark.createDataFrame([("x", 4), ("y", 4)], "kata string, frekuensi bigint")
    assert {(r.t, r.size, r.weight) for r in keywords.display_weights(flat).collect()} == {(0.5, 31.0, 600)}


def test_trend_and_counts(spark):
    rows = [
        ("Mon, 01 Jan 2024 08:00:00 GMT", "a", "Positif"), ("Mon, 01 Jan 2024 09:00:00 GMT", "b", "NETRAL"),
        ("Mon, 01 Jan 2024 09:00:00 GMT", None, "Netral"), ("Tue, 02 Jan 2024 08:00:00 GMT", "c", "Lain"),
        ("rusak", "d", "Positif"), ("Tue, 02 Jan 2024 08:00:00 GMT", "e", None),
    ]
    df = spark.createDataFrame(rows, "tanggal string, judul string, sentiment string")
    got = [tuple(r)[1:] for r in report.daily_trend(df).collect()]
    assert got == [("01", 2, 1, 0, 1), ("02", 1, 0, 0, 0)]
    assert tuple(report.sentiment_counts(df).first()) == (2, 0, 2, 6)
    empty = df.filter("false").withColumn("seq", F.lit(1))
    assert tuple(report.page_count(empty).first()) == (0, 1)
    sources = spark.createDataFrame([("",), (None,), ("b",), ("a",)], "source string")
    assert [r[0] for r in report.distinct_sources(sources).collect()] == ["Tidak diketahui", "a", "b"]
    assert report.of_sources(sources, []).count() == 4
    assert report.of_sources(sources, ["Tidak diketahui"]).count() == 2


def test_first_places_are_numbers_of_one_word_and_of_any_size(spark):
    big = 1 << 62
    for shift, kind in ((0, "bigint"), (-5, "bigint"), (big, "decimal(38,0)")):
        rows = [(shift + 2, "b c a"), (shift + 1, "x a c a b"), (shift + 3, None)]
        df = spark.createDataFrame(rows, "seq bigint, text_final string")
        counts = keywords.ngram_counts(df, 1)
        assert dict(counts.dtypes)["first"] == kind
        got = {r.kata: (r.frekuensi, int(r.first)) for r in counts.collect()}
        at = (shift + 1) * 2**31
        assert got == {"x": (1, at), "a": (3, at + 1), "c": (2, at + 2), "b": (2, at + 4)}
        assert [r.kata for r in keywords.top_ngrams(df, 1, 3).collect()] == ["a", "c", "b"]


def test_topic_counts_are_compared_in_one_pass(spark, tmp_path, monkeypatch):
    from catalog import topics as queries

    texts = [" ".join(f"word{(i * j) % 90}x" for j in range(1, 30)) for i in range(40)]
    docs = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    passes, whole = [], topics.window_runs
    monkeypatch.setattr(topics, "window_runs", lambda *a, **k: passes.append(1) or whole(*a, **k))
    best = tuple(queries.model_selection(spark, str(tmp_path)).first())
    assert len(passes) == 1
    corpus = queries.corpus(spark, str(tmp_path))
    alone = {
        k: topics.coherence(corpus, queries.given_words(corpus, k)).agg(F.round(F.avg("coherence"), 6)).first()[0]
        for k in (3, 7)
    }
    assert best[1] >= max(alone.values()) and alone.get(best[0], best[1]) == best[1]
