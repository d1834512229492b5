"""Landed feed items and landed pages as article tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wartaframe.functions import text as tx
from wartaframe.operators.joins import fits_broadcast
from wartaframe.schemas import ARTICLE, FEED_ITEM, PAGE


def read_feed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Feed items landed as JSON or parquet, read with a declared schema."""
    return feed_articles(spark.read.schema(FEED_ITEM).format(fmt).load(path))


def feed_articles(items: DataFrame) -> DataFrame:
    """Feed items as articles; absent fields become ''."""
    columns = {
        "tanggal": "published",
        "judul": "title",
        "content": "description",
        "url": "link",
        "source": "source.title",
    }
    return items.select(
        "seq", *[F.coalesce(F.col(c), F.lit("")).alias(name) for name, c in columns.items()]
    )


def read_articles(
    spark: SparkSession, path: str, fmt: str = "parquet", header: bool = True
) -> DataFrame:
    reader = spark.read.schema(ARTICLE).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", header).option("multiLine", True).option("escape", '"')
    return reader.load(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(PAGE).format(fmt).load(path)


def with_page_text(items: DataFrame, pages: DataFrame, order: str) -> DataFrame:
    """Left join to the readable text (``full_text``) of the landed page of the url.

    ``items`` are deduplicated, hence unique in url. Only landings of their urls are
    read further, and text is extracted where a page lies: raw markup crosses the
    network only if the urls are too many to copy. Of several landings of a url the
    first in ``order`` (an attempt or a time) that yields an accepted text counts,
    as a retry would.
    """
    wanted = items.select("url").distinct()
    wanted = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    pages = pages.join(wanted, "url", "left_semi")
    text = tx.main_text(F.col("html"))
    # min_by skips null orders. A filter would be pushed below and extract again.
    accepted = F.when(~tx.is_rejected_content(F.col("full_text")), F.col("_order"))
    landed = (
        pages.select("url", F.col(order).alias("_order"), text.alias("full_text"))
        .withColumn("_order", accepted)
        .groupBy("url")
        .agg(F.min_by("full_text", "_order").alias("full_text"))
    )
    return items.join(landed, "url", "left")
