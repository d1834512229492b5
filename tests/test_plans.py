import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from wartaframe.operators import sentiment
from wartaframe.plans import analyze, outputs
from wartaframe.sources import feed
from wartaframe.streaming import live

SMALL = "/root/testdata/sf0.001"


def landed(tmp_path, n=60):
    """Feed items and pages as files, with copies and items out of the period."""
    rng = random.Random(2)
    themes = [["harga", "beras", "cabai", "naik"], ["saham", "bursa", "modal", "untung"], ["ekspor", "produksi", "turun", "pabrik"]]
    items, pages = [], []
    for i in range(n):
        words = [rng.choice(themes[i % 3]) for _ in range(25)]
        words += [f"kota{rng.randrange(12)}{c}" for c in "abcdefghijklmnopqrst"]
        month = "Jan" if i % 10 else "Mar"
        items.append({
            "seq": i, "published": f"Mon, {i % 28 + 1:02d} {month} 2024 08:00:00 GMT",
            "title": f"Ekonomi {i % 50} - Media", "description": f"<p>{' '.join(words[:8])}</p>",
            "link": f"u{i}", "source": {"title": f"m{i % 4}"},
        })
        if i % 4:
            pages.append((f"u{i}", f"<nav>menu</nav><p>Ekonomi {' '.join(words)}</p>"))
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(i) for i in items))
    return str(folder), pages


def test_analysis_from_landed_feed_to_report(spark, tmp_path):
    folder, pages = landed(tmp_path)
    items = feed.read_feed(spark, folder)
    page_table = spark.createDataFrame([(*p, 1) for p in pages], "url string, html string, attempt bigint")
    lexicon = spark.createDataFrame(
        [("untung", 4.0), ("naik", -2.0), ("turun", -3.0), ("harga beras", -1.0)], "word string, weight double"
    )
    settings = analyze.AnalysisSettings(
        2024, "Januari", "ekonomi", limit=40, candidate_topics=(2, 3), passes=1
    )
    result = analyze.analyze(items, page_table, lexicon, settings)
    n = result["articles"].count()
    steps = {r.step: r.jumlah for r in result["funnel"].collect()}
    assert steps["sebelum_dedup"] <= 40 and 0 < n == steps["setelah_semantic_dedup"]
    assert result["articles"].filter("sentiment_score IS NULL OR label_topik IS NULL").isEmpty()
    assert result["trend"].agg(F.sum("berita")).first()[0] == n
    assert sum(r.value for r in result["categories"].collect()) == n
    tables = outputs.report_tables(result)
    for fmt in ("parquet", "csv"):
        outputs.write_report(tables, str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet/ringkasan")).count() == 9
    assert spark.read.parquet(str(tmp_path / "parquet/validasi_model")).count() == 8
    berita = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv/berita"))
    assert berita.count() == n and len(berita.columns) == 9


def test_stream_equals_batch(spark, tmp_path):
    folder, _ = landed(tmp_path)
    lexicon = spark.createDataFrame([("untung", 4.0), ("naik", -2.0)], "word string, weight double")
    stream = live.prepared(live.first_seen(live.stream_feed(spark, folder)))
    scored, state = str(tmp_path / "scored"), str(tmp_path / "state")
    live.write_scored(stream, lexicon, scored, state).trigger(availableNow=True).start().awaitTermination()
    batch = live.prepared(feed.read_feed(spark, folder))
    batch = sentiment.score_articles(batch, lexicon)
    want = {r.seq: r.sentiment_lexicon for r in batch.collect()}
    got = {r.seq: r.sentiment for r in spark.read.parquet(scored).collect()}
    titles = batch.select("judul", "source").distinct().count()
    assert len(got) == titles and all(want[s] == label for s, label in got.items())


def test_registered_names():
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 100


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in ("documents", "labels", "pages", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize(
    "name",
    ["a6_feed_dedup", "a9_page_text", "c13_stem_table", "d3_similar_pairs", "d4_near_dedup", "s7_score_and_matches",
     "m4_stratified_split", "e6_golden_upsert", "t6_coherence", "k1_top_ngrams", "r1_daily_trend"],
)
def test_query_equals_sql(spark, database, name):
    df = driver.queries()[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    rel = database.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(c) for c in df.columns]
    want = [tuple(r[i] for i in order) for r in rel.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
