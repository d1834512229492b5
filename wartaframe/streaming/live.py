"""The same stages over a stream of landed feed items.

Cleaning and scoring rules are stateless. Exact duplicates and the daily trend
keep state that a watermark bounds. Near duplicates, model fitting and topics
need the whole corpus and stay batch jobs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wartaframe.functions import dates
from wartaframe.functions import fixed_values as fixed
from wartaframe.functions import text as tx
from wartaframe.operators import prepare
from wartaframe.operators.sentiment import score_articles
from wartaframe.schemas import FEED_ITEM
from wartaframe.sources.feed import feed_articles


def stream_feed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return feed_articles(spark.readStream.schema(FEED_ITEM).format(fmt).load(path))


def first_seen(articles: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Articles with ``published_at``, one per (title, source) within the watermark."""
    return (
        articles.withColumn("published_at", dates.parse_published(F.col("tanggal")))
        .filter(F.col("published_at").isNotNull())
        .withColumn("_title", tx.title_key(F.col("judul")))
        .withWatermark("published_at", lateness)
        .dropDuplicatesWithinWatermark(["_title", "source"])
        .drop("_title")
    )


def prepared(articles: DataFrame, stopwords: Iterable[str] = (), **stemming) -> DataFrame:
    return prepare.stem_articles(prepare.clean_articles(articles, stopwords), **stemming)


def write_scored(
    articles: DataFrame, lexicon: DataFrame, path: str, checkpoint: str, **scoring
) -> DataStreamWriter:
    """Score each batch with the batch operators and append it to a table.

    A batch that is run again after a failure replaces its own folder.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        scored = score_articles(batch, lexicon, **scoring)
        labelled = scored.withColumn("sentiment", F.col("sentiment_lexicon"))
        labelled.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return articles.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)


def trend(articles: DataFrame) -> DataFrame:
    """Articles per day and sentiment; a day is final once the watermark passes it."""
    label = F.lower("sentiment")
    return (
        articles.groupBy(F.window("published_at", "1 day").alias("day"))
        .agg(
            F.count("judul").alias("berita"),
            *[F.count_if(label == name).alias(name) for name in fixed.LABELS],
        )
        .select(F.to_date("day.start").alias("date"), "berita", *fixed.LABELS)
    )
