"""Trend, counts, ratios and the tables of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wartaframe.functions import dates
from wartaframe.functions import fixed_values as fixed
from wartaframe.operators.order import key_at
from wartaframe.schemas import ARTICLE_RESULT, REPORT_ARTICLE
from wartaframe.session import checkpointed


def daily_trend(articles: DataFrame) -> DataFrame:
    """Articles per day and sentiment; undated rows and rows without title are left out."""
    label = F.lower("sentiment")
    titled = F.col("judul").isNotNull()
    return (
        articles.select(dates.published_date(F.col("tanggal")).alias("date"), label.alias("s"), titled.alias("t"))
        .filter(F.col("date").isNotNull() & F.col("s").isNotNull())
        .groupBy("date")
        .agg(
            F.count_if("t").alias("berita"),
            *[F.count_if(F.col("t") & (F.col("s") == name)).alias(name) for name in fixed.LABELS],
        )
        .select("date", F.date_format("date", "dd").alias("day"), "berita", *fixed.LABELS)
        .orderBy("date")
    )


def sentiment_counts(articles: DataFrame) -> DataFrame:
    """One row: positif, negatif, netral and all articles."""
    label = F.lower("sentiment")
    return articles.agg(
        *[F.count_if(F.coalesce(label == name, F.lit(False))).alias(name) for name in fixed.LABELS],
        F.count(F.lit(1)).alias("total_berita"),
    )


def status_counts(articles: DataFrame) -> DataFrame:
    return (
        articles.filter(F.col("scrape_status_label").isNotNull())
        .groupBy("scrape_status_label")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "scrape_status_label")
    )


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; null for an empty whole."""
    return F.round(100 * part / F.nullif(whole, F.lit(0))).cast("int")


def kpi_ratios(counts: DataFrame, before_dedup: DataFrame) -> DataFrame:
    """Unique share and sentiment shares from :func:`sentiment_counts`."""
    total = before_dedup.agg(F.count(F.lit(1))).scalar()
    unique = F.col("total_berita")
    return counts.select(
        total.alias("total"),
        unique.alias("unik"),
        percent(unique, total).alias("unik_pct"),
        *[percent(F.col(name), unique).alias(f"{name}_pct") for name in fixed.LABELS],
    )


def category_shares(categories: DataFrame) -> DataFrame:
    whole = categories.agg(F.sum("value")).scalar()
    share = F.coalesce(percent(F.col("value"), whole), F.lit(0))
    return categories.select("name", "value", share.alias("pct"))


def source_name(source: Column) -> Column:
    return F.coalesce(F.nullif(source, F.lit("")), F.lit(fixed.UNKNOWN_SOURCE))


def distinct_sources(articles: DataFrame) -> DataFrame:
    return articles.select(source_name(F.col("source")).alias("source")).distinct().orderBy("source")


def of_sources(articles: DataFrame, sources: list[str]) -> DataFrame:
    """Articles of the named sources; an empty list means all."""
    return articles.filter(source_name(F.col("source")).isin(sources)) if sources else articles


def page_of(articles: DataFrame, page: int, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """The rows of a 1-based page in the order of ``seq``; only they are sorted."""
    keys = checkpointed(articles.select("seq"))
    before, last = key_at(keys, (page - 1) * size), key_at(keys, page * size)
    if page < 1 or (page > 1 and before is None):
        return articles.limit(0)
    rows = articles if before is None else articles.filter(F.col("seq") > before)
    return (rows if last is None else rows.filter(F.col("seq") <= last)).orderBy("seq")


def page_after(articles: DataFrame, seq: int, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """The page that follows the row ``seq``: no place is counted, earlier rows are not read."""
    return page_of(articles.filter(F.col("seq") > seq), 1, size)


def page_count(articles: DataFrame, size: int = fixed.PAGE_SIZE) -> DataFrame:
    n = F.count(F.lit(1))
    return articles.agg(
        n.alias("n"), F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("bigint").alias("pages")
    )


def article_results(articles: DataFrame) -> DataFrame:
    """The published article columns with their types; what is missing gets a default."""
    def column(name: str, kind: str, default) -> Column:
        present = F.col(name).cast(kind) if name in articles.columns else F.lit(None).cast(kind)
        return F.coalesce(present, F.lit(default).cast(kind)).alias(name)

    return articles.select(*[column(*spec) for spec in ARTICLE_RESULT])


def report_rows(articles: DataFrame) -> DataFrame:
    return articles.select(*[c for c in REPORT_ARTICLE if c in articles.columns])


def _key_value(row: DataFrame, metrics: tuple[tuple[str, str], ...]) -> DataFrame:
    pairs = [
        F.struct(F.lit(i).alias("no"), F.lit(name).alias("Metrik"),
                 F.col(column).cast("string").alias("Nilai"))
        for i, (name, column) in enumerate(metrics, 1)
    ]
    return row.select(F.inline(F.array(*pairs)))


def summary_table(row: DataFrame) -> DataFrame:
    """Nine (no, Metrik, Nilai) lines from one row of run counts."""
    return _key_value(
        row,
        (
            ("Total berita (sebelum dedup)", "jumlah_sebelum_dedup"),
            ("Total kandidat dicoba", "total_pool_dicoba"),
            ("Berhasil di-scrape", "jumlah_didapat"),
            ("Setelah dedup exact", "jumlah_setelah_exact_dedup"),
            ("Setelah dedup semantic", "jumlah_setelah_semantic_dedup"),
            ("Total berita final", "total_berita"),
            ("Sentimen Positif", "positif"),
            ("Sentimen Negatif", "negatif"),
            ("Sentimen Netral", "netral"),
        ),
    )


def validation_table(row: DataFrame) -> DataFrame:
    """Eight (no, Metrik, Nilai) lines from the validation row."""
    return _key_value(
        row,
        (
            ("Model dilatih?", "trained"),
            ("Accuracy", "accuracy"),
            ("Precision", "precision"),
            ("Recall", "recall"),
            ("F1-score", "f1"),
            ("Jumlah data latih", "train_size"),
            ("Jumlah data uji", "test_size"),
            ("Catatan", "note"),
        ),
    )


def topic_table(topics: DataFrame) -> DataFrame:
    return topics.withColumn("terms", F.array_join("terms", ", "))
