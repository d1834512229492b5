"""Keywords, trend, counts and report tables (K, R, W)."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import params as P
from catalog.adapter import ARTICLES, CLEANED, STEMMED, articles, cleaned, r6, stemmed, stemmed_from, with_ctes
from catalog.collect import FETCHED, TRIED, filled
from catalog.dedup import EXACT, GREEDY, PAIRS, VECTORS
from catalog.learn import EVALUATED, FULL_REPORT, GOLDEN, OVERALL, SPLIT, evaluated, golden
from catalog.registry import query
from catalog.sentiment import SCORED, lexicon, scored
from catalog.topics import (
    ALL, CATEGORIES, DEFINITIONS, GIVEN, SUMMARY, VOCABULARY, assigned, categories_of, given_words,
)
from wartaframe.functions import dates
from wartaframe.operators import classify, collect, dedup, evaluate, keywords, prepare, report, sentiment, topics
from wartaframe.plans.analyze import run_counts
from wartaframe.plans.outputs import report_tables
from wartaframe.session import checkpointed

NGRAMS = """grams AS (SELECT seq, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS kata,
    unnest(range(1, len(w) - {n} + 2)) AS pos
  FROM (SELECT seq, string_split(text_final, ' ') AS w FROM stemmed WHERE text_final <> '')),
ranked AS (SELECT kata, count(*) AS frekuensi, min(struct_pack(s := seq, p := pos)) AS first FROM grams GROUP BY kata
  ORDER BY frekuensi DESC, first LIMIT {k})"""


def ngram_query(name, n, k):
    @query(name, with_ctes(STEMMED, NGRAMS.format(n=n, k=k)) + "SELECT kata, frekuensi FROM ranked")
    def run(spark, sf_dir):
        return keywords.top_ngrams(stemmed(spark, sf_dir), n, k)

    return run


ngram_query("k1_top_ngrams", 2, 200)
ngram_query("k2_top_keywords", 1, 100)
ngram_query("k3_top_bigrams", 2, 15)
ngram_query("k3_top_trigrams", 3, 15)


@query(
    "k4_display_weights",
    with_ctes(STEMMED, NGRAMS.format(n=1, k=100), """relative AS (SELECT kata, frekuensi,
    coalesce((frekuensi - min(frekuensi) OVER ()) / nullif(max(frekuensi) OVER () - min(frekuensi) OVER (), 0), 0.5) AS t FROM ranked)""")
    + """SELECT kata, frekuensi, round(t, 6) AS t, round(14 + t * 34, 6) AS size,
  (400 + round(t * 4) * 100)::INTEGER AS weight, round(0.55 + t * 0.45, 6) AS opacity FROM relative""",
)
def display_weights(spark, sf_dir):
    terms = checkpointed(keywords.top_keywords(stemmed(spark, sf_dir), 100))
    shown = keywords.display_weights(terms)
    return shown.select(
        "kata", "frekuensi", r6("t").alias("t"), r6("size").alias("size"), "weight",
        r6("opacity").alias("opacity"),
    )


@query(
    "k5_sentiment_terms",
    with_ctes(STEMMED, SCORED)
    + """SELECT sentiment, kata, frekuensi, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY frekuensi DESC, kata) AS rank FROM (
    SELECT lower(sentiment) AS sentiment, kata, count(*) AS frekuensi
    FROM (SELECT sentiment, unnest(string_split(text_final, ' ')) AS kata FROM scored WHERE text_final <> '') GROUP BY ALL)) WHERE rank <= 80""",
)
def sentiment_terms(spark, sf_dir):
    # Counted in one pass, so the texts are not stored once more with their sentiment.
    docs = scored(spark, sf_dir).select("text_final", F.col("sentiment_lexicon").alias("sentiment"))
    return keywords.sentiment_terms(docs)


def labelled(spark, sf_dir, *columns):
    """The given columns of the articles with their sentiment."""
    own = ("text_final", "tokens_stemmed", "sentiment_score_lexicon")
    docs = scored(spark, sf_dir, *[c for c in columns if c not in own])
    return checkpointed(docs.select("seq", *columns, F.col("sentiment_lexicon").alias("sentiment")))


TREND = """SELECT CAST(day AS VARCHAR) AS date, strftime(day, '%d') AS day, count(judul) AS berita,
  count(*) FILTER (sentiment = 'Positif') AS positif, count(*) FILTER (sentiment = 'Negatif') AS negatif,
  count(*) FILTER (sentiment = 'Netral') AS netral FROM scored WHERE day IS NOT NULL GROUP BY scored.day"""


def with_date_text(trend):
    return trend.withColumn("date", F.col("date").cast("string"))


@query("r1_daily_trend", with_ctes(STEMMED, SCORED) + TREND)
def daily_trend(spark, sf_dir):
    return with_date_text(report.daily_trend(labelled(spark, sf_dir, "tanggal", "judul")))


#: What exact and near duplicates are told by.
UNIQUE_BY = ("judul", "source", "clean_text")


def flagship(spark, sf_dir):
    """Daily sentiment of the cleaned corpus without exact and near duplicates."""
    docs = cleaned(spark, sf_dir).select("seq", "tanggal", *UNIQUE_BY)
    exact = checkpointed(dedup.exact_dedup(docs))
    unique = dedup.near_dedup(exact, threshold=P.THRESHOLD)
    docs = checkpointed(prepare.stem_articles(unique, None, P.AFFIXES, P.SLANG, P.GENERIC).drop("source", "clean_text"))
    words, phrases = lexicon(docs)
    result = sentiment.score_articles(docs, words, phrases, P.RULES)
    return report.daily_trend(result.withColumn("sentiment", F.col("sentiment_lexicon")))


@query(
    "r1_unique_daily_trend",
    with_ctes(
        CLEANED, EXACT.replace("{source}", "cleaned"), VECTORS.format(source="exact"), PAIRS,
        GREEDY.format(source="exact"), stemmed_from("near"), SCORED, recursive=True,
    )
    + TREND,
)
def unique_daily_trend(spark, sf_dir):
    return with_date_text(flagship(spark, sf_dir))


COUNTS = """count(*) FILTER (sentiment = 'Positif') AS positif, count(*) FILTER (sentiment = 'Negatif') AS negatif,
  count(*) FILTER (sentiment = 'Netral') AS netral, count(*) AS total_berita"""


@query("r2_sentiment_counts", with_ctes(STEMMED, SCORED) + f"SELECT {COUNTS} FROM scored")
def sentiment_counts(spark, sf_dir):
    return report.sentiment_counts(labelled(spark, sf_dir))


@query(
    "r3_status_counts",
    with_ctes(ARTICLES, FETCHED) + "SELECT scrape_status_label, count(*) AS n FROM filled GROUP BY ALL",
)
def status_counts(spark, sf_dir):
    return report.status_counts(filled(spark, sf_dir))


@query(
    "r4_kpi_ratios",
    with_ctes(
        STEMMED, SCORED, EXACT.replace("{source}", "scored"), VECTORS.format(source="exact").replace("tokens AS", "near_tokens AS").replace("FROM tokens GROUP", "FROM near_tokens GROUP"),
        PAIRS, GREEDY.format(source="exact"), f"class_counts AS (SELECT {COUNTS} FROM near)", recursive=True,
    )
    + """SELECT (SELECT count(*) FROM scored) AS total, total_berita AS unik,
  round(100 * total_berita / nullif((SELECT count(*) FROM scored), 0))::INTEGER AS unik_pct,
  round(100 * positif / nullif(total_berita, 0))::INTEGER AS positif_pct, round(100 * negatif / nullif(total_berita, 0))::INTEGER AS negatif_pct,
  round(100 * netral / nullif(total_berita, 0))::INTEGER AS netral_pct FROM class_counts""",
)
def kpi_ratios(spark, sf_dir):
    docs = labelled(spark, sf_dir, *UNIQUE_BY)
    unique = dedup.near_dedup(checkpointed(dedup.exact_dedup(docs)), threshold=P.THRESHOLD)
    return report.kpi_ratios(report.sentiment_counts(unique), docs)


@query(
    "r5_category_shares",
    ALL + f"SELECT name, value, round(100 * value / sum(value) OVER ())::INTEGER AS pct FROM ({CATEGORIES})",
)
def category_shares(spark, sf_dir):
    docs = checkpointed(stemmed(spark, sf_dir))
    return report.category_shares(checkpointed(categories_of(docs)))


SOURCED = "sourced AS (SELECT seq, judul, tanggal, CASE source WHEN 'src3' THEN '' WHEN 'src4' THEN NULL ELSE source END AS source FROM articles)"


def sourced(spark, sf_dir):
    """Articles of which some lack a source."""
    source = F.when(F.col("source") == "src3", "").when(F.col("source") != "src4", F.col("source"))
    return articles(spark, sf_dir).withColumn("source", source)


@query(
    "r6_distinct_sources",
    with_ctes(ARTICLES, SOURCED)
    + "SELECT DISTINCT coalesce(nullif(source, ''), 'Tidak diketahui') AS source FROM sourced",
)
def distinct_sources(spark, sf_dir):
    return report.distinct_sources(sourced(spark, sf_dir))


@query(
    "r7_source_filter",
    with_ctes(ARTICLES, SOURCED)
    + "SELECT seq FROM sourced WHERE coalesce(nullif(source, ''), 'Tidak diketahui') IN ('src1', 'src7', 'Tidak diketahui')",
)
def source_filter(spark, sf_dir):
    return report.of_sources(sourced(spark, sf_dir), ["src1", "src7", "Tidak diketahui"]).select("seq")


@query(
    "r8_page",
    with_ctes(ARTICLES) + "SELECT seq, judul, tanggal FROM articles ORDER BY seq LIMIT 10 OFFSET 50",
)
def page(spark, sf_dir):
    return report.page_of(articles(spark, sf_dir), 6).select("seq", "judul", "tanggal")


@query(
    "r8_page_count",
    with_ctes(ARTICLES) + "SELECT count(*) AS n, greatest(1, ceil(count(*) / 10))::BIGINT AS pages FROM articles",
)
def page_count(spark, sf_dir):
    return report.page_count(articles(spark, sf_dir))


@query(
    "r9_top_slice",
    with_ctes(STEMMED, NGRAMS.format(n=1, k=100))
    + "SELECT kata, frekuensi FROM ranked ORDER BY frekuensi DESC, first LIMIT 10",
)
def top_slice(spark, sf_dir):
    return keywords.top_keywords(stemmed(spark, sf_dir), 10)


AS_OF = dt.date(2024, 1, 17)


@query(
    "r10_period_label",
    """SELECT event_id, CAST(CASE WHEN date_trunc('month', ts) = DATE '2024-01-01' THEN least(last_day(ts::DATE), DATE '2024-01-17')
  ELSE last_day(ts::DATE) END AS VARCHAR) AS label_end FROM events""",
)
def period_label(spark, sf_dir):
    from catalog.adapter import table

    end = dates.period_label_end(F.to_date("ts"), F.lit(AS_OF))
    return table(spark, sf_dir, "events").select("event_id", end.cast("string").alias("label_end"))


RUN_EXACT = """exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(judul), source ORDER BY seq) AS rn FROM scored) WHERE rn = 1)"""
RUN = f"""run AS (SELECT (SELECT count(*) FROM scored) AS a, (SELECT count(*) FROM tried) AS b,
  (SELECT least(count(*), {P.LIMIT}) FROM tried WHERE is_full_text OR trim(content) <> '') AS c,
  (SELECT count(*) FROM exact) AS d, count(*) AS e, count(*) FILTER (sentiment = 'Positif') AS p,
  count(*) FILTER (sentiment = 'Negatif') AS n, count(*) FILTER (sentiment = 'Netral') AS o FROM near)"""
NEAR_OF_EXACT = (
    VECTORS.format(source="exact").replace("tokens AS", "near_tokens AS").replace("FROM tokens GROUP", "FROM near_tokens GROUP"),
    PAIRS,
    GREEDY.format(source="exact"),
)


SUMMARY_SHEET = """summary_sheet AS (SELECT unnest(generate_series(1, 9))::INTEGER AS no, unnest(['Total berita (sebelum dedup)', 'Total kandidat dicoba', 'Berhasil di-scrape',
  'Setelah dedup exact', 'Setelah dedup semantic', 'Total berita final', 'Sentimen Positif', 'Sentimen Negatif', 'Sentimen Netral']) AS "Metrik",
  unnest([a, b, c, d, e, e, p, n, o])::VARCHAR AS "Nilai" FROM run)"""


def run_of(docs, spark, sf_dir):
    """Unique documents of a run, and its counts."""
    tried = collect.until_quota(filled(spark, sf_dir), P.LIMIT)
    collected = collect.collection_counts(collect.top_up(tried, P.LIMIT), tried)
    exact = checkpointed(dedup.exact_dedup(docs))
    unique = checkpointed(dedup.near_dedup(exact, threshold=P.THRESHOLD))
    return unique, run_counts(dedup.funnel(docs, exact, unique), report.sentiment_counts(unique), collected)


@query(
    "w2_summary_table",
    with_ctes(STEMMED, SCORED, FETCHED, TRIED, RUN_EXACT, *NEAR_OF_EXACT, RUN, SUMMARY_SHEET, recursive=True)
    + "SELECT * FROM summary_sheet",
)
def summary_table(spark, sf_dir):
    return report.summary_table(run_of(labelled(spark, sf_dir, *UNIQUE_BY), spark, sf_dir)[1])


@query(
    "w3_articles_table",
    with_ctes(STEMMED, SCORED)
    + """SELECT tanggal, judul, source, sentiment, round(score, 6) AS sentiment_score, url, content, text_final FROM scored""",
)
def articles_table(spark, sf_dir):
    docs = labelled(spark, sf_dir, "tanggal", "judul", "source", "url", "content", "text_final", "sentiment_score_lexicon")
    docs = docs.withColumn("sentiment_score", r6("sentiment_score_lexicon"))
    return report.report_rows(docs)


@query(
    "w4_keyword_table",
    with_ctes(STEMMED, NGRAMS.format(n=1, k=100)) + "SELECT kata, frekuensi FROM ranked",
)
def keyword_table(spark, sf_dir):
    return keywords.top_keywords(stemmed(spark, sf_dir))


@query("w5_topic_table", ALL + SUMMARY)
def topic_table(spark, sf_dir):
    docs = checkpointed(stemmed(spark, sf_dir))
    rows = topics.topic_summary(assigned(docs), topics.topic_definitions(given_words(docs, 5)))
    return report.topic_table(rows)


VALIDATION_SHEET = """validation_sheet AS (SELECT unnest(generate_series(1, 8))::INTEGER AS no, unnest(['Model dilatih?', 'Accuracy', 'Precision', 'Recall',
  'F1-score', 'Jumlah data latih', 'Jumlah data uji', 'Catatan']) AS "Metrik",
  unnest(['true', 'true', 'true', 'true', 'true', (SELECT count(*) FROM split WHERE NOT is_test)::VARCHAR,
    (SELECT count(*) FROM split WHERE is_test)::VARCHAR, NULL]) AS "Nilai")"""


def metrics_in_range(sheet):
    """The validation sheet; of its four figures between 0 and 1 that cannot come from SQL, whether they are."""
    value = F.col("Nilai").cast("double").between(0, 1).cast("string")
    return sheet.withColumn("Nilai", F.when(F.col("no").between(2, 5), value).otherwise(F.col("Nilai")))


@query("w6_validation_table", with_ctes(GOLDEN, SPLIT, VALIDATION_SHEET) + "SELECT * FROM validation_sheet")
def validation_table(spark, sf_dir):
    """Of the model trained on the human labels."""
    return metrics_in_range(report.validation_table(classify.train_golden(golden(spark, sf_dir), rules=P.RULES)[1]))


@query(
    "w9_evaluation_lines",
    with_ctes(STEMMED, EVALUATED, OVERALL, FULL_REPORT)
    + """SELECT 'kelas' AS bagian, label AS nama, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM full_report
UNION ALL SELECT 'ringkasan', 'accuracy', round(accuracy, 6), round(accuracy, 6), round(accuracy, 6), rows FROM overall
UNION ALL SELECT 'matriks', actual || ' -> ' || predicted, 0, 0, 0, n FROM cm""",
)
def evaluation_lines(spark, sf_dir):
    counts = evaluated(spark, sf_dir)
    return evaluate.report_lines(counts).select(
        "bagian", "nama", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@query(
    "w1_report_bundle",
    with_ctes(
        GOLDEN, SPLIT, VALIDATION_SHEET, SCORED, FETCHED, TRIED, RUN_EXACT, *NEAR_OF_EXACT, RUN, VOCABULARY,
        NGRAMS.format(n=1, k=100).replace("FROM stemmed", "FROM near"), GIVEN.format(k=5).replace("words AS", "topic_words AS"),
        DEFINITIONS.replace("FROM stemmed", "FROM near").replace("FROM words", "FROM topic_words"), SUMMARY_SHEET, recursive=True,
    )
    + f"""SELECT 'ringkasan' AS sheet, "Metrik" AS nama, "Nilai" AS nilai FROM summary_sheet
UNION ALL SELECT 'berita', judul, sentiment FROM near
UNION ALL SELECT 'kata_kunci', kata, frekuensi::VARCHAR FROM ranked
UNION ALL SELECT 'topik_lda', label, terms || ': ' || jumlah_berita FROM ({SUMMARY})
UNION ALL SELECT 'validasi_model', "Metrik", "Nilai" FROM validation_sheet""",
)
def report_bundle(spark, sf_dir):
    """The rows of the five sheets of one run: its counts, unique articles, words, given topics and trained model."""
    docs = labelled(spark, sf_dir, *UNIQUE_BY, *"tanggal url content text_final tokens_stemmed sentiment_score_lexicon".split())
    unique, counts = run_of(docs, spark, sf_dir)
    sheets = report_tables(
        {
            "run_counts": counts,
            "articles": unique,
            "top_keywords": keywords.top_keywords(unique),
            "topics": topics.topic_summary(assigned(unique), topics.topic_definitions(given_words(docs, 5))),
            "validation": classify.train_golden(golden(spark, sf_dir), rules=P.RULES)[1],
        }
    )
    sheets["validasi_model"] = metrics_in_range(sheets["validasi_model"])
    shown = {
        "ringkasan": ("Metrik", "Nilai"), "berita": ("judul", "sentiment"), "kata_kunci": ("kata", "frekuensi"),
        "topik_lda": ("label", F.concat_ws(": ", "terms", "jumlah_berita")), "validasi_model": ("Metrik", "Nilai"),
    }
    rows = [
        sheets[sheet].select(F.lit(sheet).alias("sheet"), F.col(name).alias("nama"), (F.col(value) if isinstance(value, str) else value).cast("string").alias("nilai"))
        for sheet, (name, value) in shown.items()
    ]
    return reduce(DataFrame.union, rows)
