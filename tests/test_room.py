"""What scoring and near-duplicate removal shuffle and store, against the rows they find."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wartaframe.operators import joins, sentiment, similarity
from wartaframe.session import checkpointed


def test_few_pairs_that_share_a_term_are_candidates(spark):
    rng = random.Random(5)
    # Texts of words that many share; one of them, a rarer one, is shared by ten texts.
    docs = [(i, [f"r{i % 20}", *(f"w{rng.randrange(300)}" for _ in range(60))]) for i in range(200)]
    docs += [(200 + i, [*words[:-1], "changed"]) for i, words in docs[:20]]
    df = spark.createDataFrame(docs, "seq bigint, tokens array<string>")
    postings = similarity.prefix_postings(similarity.bag_vectors(df), 0.85)
    candidates = {tuple(r) for r in similarity.candidate_pairs(postings, 0.85).collect()}
    found = {(r.i, r.j) for r in similarity.cosine_pairs(df, 0.85).collect()}
    assert found == {(i, 200 + i) for i in range(20)}, found
    # the vectors of both go to each candidate: far fewer than the pairs that share a prefix term
    assert found <= candidates
    assert len(candidates) < len(docs) ** 2 / 2 / 10


def test_phrases_leave_a_row_for_each_beginning_found(spark, monkeypatch):
    # the dictionary of phrases is small, the vocabulary of the texts is not
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 50)
    rng = random.Random(6)
    words = [f"a{i}b" for i in range(500)] + ["aab", "acb", "adb", "aeb"] * 40
    texts = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(20)]
    docs = spark.createDataFrame(texts, "seq bigint, text_final string")
    phrases = ["aab acb", "ab acb", "b ad", "aab acb aeb", "zzz acb", "b zz"]
    lexicon = spark.createDataFrame([(i, p, 1.0) for i, p in enumerate(phrases)], "entry_id bigint, phrase string, weight double")
    matches = sentiment.phrase_matches(docs, lexicon)
    got = {(r.seq, r.entry_id) for r in matches.collect()}
    assert got == {(i, e) for i, t in texts for e, p in enumerate(phrases) if p in t}


def test_scoring_stores_little_more_than_the_words(spark, tmp_path):
    from catalog.sentiment import scored

    rng = random.Random(7)
    texts = [" ".join(f"word{rng.randrange(400)}x" for _ in range(400)) for _ in range(200)]
    rows = [(i, t, "en", f"src{i % 5}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    checkpointed(spark.range(1))
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))

    def stored():
        return sum(f.stat().st_size for f in folder.rglob("part-*") if f.is_file())

    before = stored()
    assert scored(spark, str(tmp_path)).count() == 200
    # several columns with the whole text took more than that
    assert stored() - before < sum(map(len, texts))


def test_a_stored_corpus_has_one_text_for_its_tokens(spark, tmp_path):
    from catalog.sentiment import corpus

    rows = [(1, "ing of wins", "en", "src1", 11), (2, "", "en", "src1", 0), (3, None, "de", "src2", None), (3, "nations und eux", "de", "src2", 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    from catalog.adapter import stemmed

    want = stemmed(spark, str(tmp_path)).select("seq", "judul", "tokens_stemmed", "text_final")
    stored = corpus(spark, str(tmp_path), "judul")
    assert sorted(map(str, want.collect())) == sorted(map(str, stored.select(*want.columns).collect()))
    assert "tokens_stemmed" not in stored._jdf.queryExecution().logical().toString().split("LogicalRDD")[-1]




def test_more_phrases_than_rows_to_broadcast_stay_beside_the_text(spark, monkeypatch):
    # phrases outgrow their words: as numbers they are copied although a table of so many texts would not be
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 50)
    words = [f"w{i}x" for i in range(12)]
    phrases = [f"{a} {b}" for a in words[:10] for b in words]
    lexicon = spark.createDataFrame([(i, p, 1.0) for i, p in enumerate(phrases)], "entry_id bigint, phrase string, weight double")
    texts = [(i, " ".join(words[(i + j * j) % 12] for j in range(8))) for i in range(30)]
    docs = spark.createDataFrame(texts, "seq bigint, text_final string")
    matches = sentiment.phrase_matches(docs, lexicon)
    assert "_lane" not in matches._jdf.queryExecution().toString()
    got = sorted((r.seq, r.entry_id) for r in matches.collect())
    assert got == sorted((i, e) for i, t in texts for e, p in enumerate(phrases) if p in t)


@pytest.mark.parametrize("piece, starts", [(40, 3), (4 << 20, 2_000_000)])
def test_phrases_are_looked_up_without_a_row_for_each_beginning(spark, monkeypatch, piece, starts):
    monkeypatch.setattr(sentiment, "PIECE_BYTES", piece)
    monkeypatch.setattr(sentiment, "PIECE_STARTS", starts)
    rng = random.Random(11)
    words = ["aab", "ab", "b", "béb", "bé", "c", "cc", ""]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(40)] + [(40, None)]
    docs = spark.createDataFrame(texts, "seq bigint, text_final string")
    wanted = ["b ab", "b béb", "é c", "ab c", "b bé c", "b b", "c aab", "nowhere b"]
    lexicon = spark.createDataFrame([(i, p, 1.0) for i, p in enumerate(wanted)], "entry_id bigint, phrase string, weight double")
    matches = sentiment.phrase_matches(docs, lexicon)
    # a row for each length of a word's ending, and again for each of the next word's beginning, went through two joins
    assert "Generate explode([" not in matches._jdf.queryExecution().toString()
    got = sorted((r.seq, r.entry_id) for r in matches.collect())
    assert got == sorted((i, e) for i, t in texts if t for e, p in enumerate(wanted) if p in t)
    assert sentiment.phrase_matches(docs, lexicon.filter("weight > 1")).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_pairs_are_counted_by_number(spark, monkeypatch, broadcast_rows):
    from catalog import params as P
    from catalog.sentiment import entries

    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(8)
    # a word that only tokens of two words hold, words of too few texts, texts without a pair or a word
    tokens = [["gold", "eau pour"] + [f"v{rng.randrange(9)}" for _ in range(rng.randrange(5))] for _ in range(19)]
    tokens += [[f"only{i}", "gold", "gold"] for i in range(10)] + [["gold"], []]
    docs = spark.createDataFrame(list(enumerate(tokens)), "seq bigint, tokens_stemmed array<string>")
    docs = docs.withColumn("text_final", F.array_join("tokens_stemmed", " "))
    singles, pairs = Counter(), Counter()
    for row in tokens:
        flat = " ".join(row).split()
        singles.update(set(row))
        pairs.update({f"{a} {b}" for a, b in zip(flat, flat[1:])})
    want = [(w, len(w) * 7 % 11 - 5) for w, n in singles.items() if n >= P.LEXICON_DOCS]
    want += [(w, len(w) % 7 - 3) for w, n in pairs.items() if n >= P.PHRASE_DOCS]
    got = entries(docs)
    if broadcast_rows:
        # a shuffled pair is a number
        plan = got._jdf.queryExecution().toString()
        assert "hashpartitioning(pair#" in plan
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {"gold eau", "eau pour"} <= {w for w, _ in want}


def test_frequent_words_are_stemmed_beside_their_texts(spark, monkeypatch):
    from wartaframe.operators import prepare

    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(joins, "FREQUENT_KEYS", 30)
    rng = random.Random(9)
    words = [f"word{i}" for i in range(30) for _ in range(20)] + [f"rare{i}" for i in range(100)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(50))) for i in range(40)] + [(40, ""), (41, None), (1, "word1 rare2")]
    docs = spark.createDataFrame(texts, "seq bigint, clean_text string")
    stems = spark.createDataFrame([(w, w.upper()) for w in sorted(set(words)) if w[-1] in "02468"], "word string, stem string")
    got = prepare.stem_articles(docs, stems, (), {}, ())
    plan = got._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "_lane" not in plan

    def stemmed(text):
        return " ".join(w.upper() if w[-1] in "02468" else w for w in (text or "").split())

    # rows of one number share their words
    alone = {r.seq: r.text_final for r in got.collect() if r.seq != 1}
    assert alone == {i: stemmed(t) for i, t in texts if i != 1}


def test_beginnings_found_in_a_text_are_not_shuffled(spark, monkeypatch):
    # they are many times the words, and grow with the phrases; parts of little text, so there are many
    monkeypatch.setattr(joins, "PART_BYTES", 1_000)
    rng = random.Random(9)
    words = [f"v{i}" for i in range(40)]
    texts = [(i // 2, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame([*texts, (None, "v1 v2"), (90, None)], "seq bigint, text_final string")
    assert joins.dealt_by(docs, "seq", "text_final").rdd.getNumPartitions() > 8
    phrases = [f"{a} {b}" for a in words[:15] for b in words[:15]]
    for more in ([], ["v1 v2 v3", "1 v2 v", "v3 v4 v5 v6"]):
        wanted = phrases + more
        lexicon = spark.createDataFrame([(i, p, i + 1.0) for i, p in enumerate(wanted)], "entry_id bigint, phrase string, weight double")
        scores = sentiment.phrase_scores(docs, lexicon)
        # rows of one number count a phrase once
        hits = {(seq, e) for seq, t in texts for e, p in enumerate(wanted) if p in t}
        if not more:
            plan = scores._jdf.queryExecution().executedPlan().toString()
            # only the texts are
            assert len(re.findall(r"hashpartitioning\(seq#", plan)) == 1, plan
            expected = {s: (sum(e + 1.0 for q, e in hits if q == s), sum(q == s for q, _ in hits)) for s, _ in hits}
            got = {r.seq: (r.phrase_score, r.phrase_matches) for r in scores.filter("seq IS NOT NULL").collect()}
            assert got == expected
        else:
            # a longer phrase may stand in both rows of a number
            found = {(r.seq, r.entry_id) for r in sentiment.phrase_matches(docs, lexicon).filter("seq IS NOT NULL").collect()}
            assert found == hits


@pytest.mark.parametrize("broadcast_rows", [10, 500_000])
def test_word_counts_stay_beside_their_texts(spark, monkeypatch, broadcast_rows):
    import math

    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(joins, "FREQUENT_KEYS", 30)
    rng = random.Random(10)
    words = [f"word{i}" for i in range(30) for _ in range(20)] + [f"rare{i}" for i in range(100)]
    # rows of one number are one document, as are those without a number; blank ones count
    rows = [(i, [rng.choice(words) for _ in range(50)]) for i in range(40)]
    rows += [(1, ["word1", "rare2"]), (None, ["word3"]), (None, ["rare4", "word3"]), (90, []), (91, None)]
    docs = checkpointed(spark.createDataFrame(rows, "seq bigint, tokens array<string>"))
    weights = similarity.tfidf(similarity.term_counts(docs.repartition(7, "seq")), docs, 7)
    plan = weights._jdf.queryExecution().executedPlan().toString()
    # a row is sorted by its document where it is; only rare terms come back to it
    assert not re.findall(r"hashpartitioning\(seq#\d+L?(?:, term#\d+)?, (?!7\))", plan), plan
    assert ("LeftAnti" in plan) == (broadcast_rows == 10)
    bags = {}
    for seq, tokens in rows:
        bags.setdefault(seq, Counter()).update(tokens or [])
    df = Counter(t for bag in bags.values() for t in bag)
    raw = {(s, t): tf * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for s, bag in bags.items() for t, tf in bag.items()}
    norm = {s: math.sqrt(sum(x * x for (q, _), x in raw.items() if q == s)) for s in bags}
    want = {(s, t, bags[s][t], df[t], round(x / norm[s], 9)) for (s, t), x in raw.items()}
    got = [(r.seq, r.term, r.tf, r.df, round(r.w, 9)) for r in weights.collect()]
    assert len(got) == len(want) and set(got) == want


def test_scored_texts_stay_where_they_are(spark, monkeypatch):
    rows = [(i % 30, f"good bad w{i} thing", ["good", "bad", f"w{i}", "thing"]) for i in range(40)] + [(None, "good", ["good"])]
    docs = checkpointed(spark.createDataFrame(rows, "seq bigint, text_final string, tokens_stemmed array<string>"))
    words = spark.createDataFrame([("good", 2.0), ("w3", -1.5)], "word string, weight double")
    phrases = spark.createDataFrame([(1, "bad w3", 4.0)], "entry_id bigint, phrase string, weight double")
    plain = []
    for bound in (0, 500_000):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
        scored = sentiment.score_articles(docs, words, phrases)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        # the line of numbers is copied to the texts, which are not shuffled by their number
        assert ("hashpartitioning" in plan) == (bound == 0), plan
        plain.append(sorted(map(str, scored.collect())))
    assert plain[0] == plain[1] and len(plain[0]) == 41
    # rows of one number share what was found in them, rows without a number have nothing
    by_text = {r.text_final: (r.sentiment_score_lexicon, r.jumlah_match_lexicon) for r in scored.collect()}
    assert by_text["good bad w3 thing"] == (2.0 + 2.0 - 1.5 + 4.0, 4)
    assert by_text["good"] == (0.0, 0)
