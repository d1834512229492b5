"""Joins that stay balanced when a few keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wartaframe.session import checkpointed

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
#: A dictionary of one short key and a number or two may have so many times the rows, within the same bytes.
NARROW = 4
HOT_KEYS = 1_000
FREQUENT_KEYS = 100_000
HOT_SPREAD = 1_024
#: Text of one part where a text becomes many rows.
PART_BYTES = 8 << 20


def fits_broadcast(small: DataFrame, times: int = 1) -> bool:
    """Whether the table was measured and found small enough to copy to every executor."""
    most = BROADCAST_ROWS * times
    texts = [c for c, kind in small.dtypes if kind not in ("bigint", "int", "double", "boolean")]
    width = F.lit(8 * len(small.columns))
    for name in texts:
        width = width + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    rows, size = small.limit(most + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows <= most and (size or 0) <= BROADCAST_BYTES


def dealt_by(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The rows dealt out by a key, so that no part holds much more than PART_BYTES of text.

    Grouping by the key, alone or with others, then needs no further shuffle, however many
    rows each text is taken apart into.
    """
    return rows.repartition(parts_of(rows, text), key)


def parts_of(rows: DataFrame, text: str) -> int:
    """Into how many parts ``dealt_by`` deals the rows: one for each core, or more by their text."""
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def numbered(values: DataFrame, name: str) -> DataFrame:
    """The rows with a number from 0 that stays small: no more than partitions times the rows of the largest."""
    values = checkpointed(values)
    parts, place = values.rdd.getNumPartitions(), F.monotonically_increasing_id()
    # the upper bits are the partition, the lower 33 the place in it
    number = place.bitwiseAND(F.lit((1 << 33) - 1)) * parts + F.shiftright(place, 33)
    return checkpointed(values.withColumn(name, number))


def join_statistics(
    rows: DataFrame, stats: DataFrame, key: str, count: str, how: str = "inner", copy_small: bool = True
) -> DataFrame:
    """Join rows to one aggregated line per key, in one pass over the rows.

    A table found small is broadcast, unless ``copy_small`` asks for one plan at all sizes.

    ``stats`` is unique in ``key`` and counts the rows of each key in ``count``.
    The HOT_KEYS most frequent keys are broadcast (that many lines at most), so
    each key left for the shuffle join holds at most 1/HOT_KEYS of the rows.
    Rows already answered by the broadcast are spread evenly over the shuffle.
    """
    payload = [c for c in stats.columns if c != key]
    if copy_small and fits_broadcast(stats):
        return rows.join(F.broadcast(stats), key, how)
    hot = stats.orderBy(F.desc(count), key).limit(HOT_KEYS)
    hot = hot.select(F.col(key), F.struct(*payload).alias("_hot"))
    cold = stats.select(
        F.col(key), F.lit(0).alias("_lane"), F.struct(*payload).alias("_cold")
    )
    lane = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*rows.columns), F.lit(HOT_SPREAD)).cast("int") + 1
    )
    joined = (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn("_lane", lane)
        .join(cold, [key, "_lane"], "left")
        .withColumn("_stats", F.coalesce("_hot", "_cold"))
    )
    if how == "inner":
        joined = joined.filter(F.col("_stats").isNotNull())
    kept = [c for c in rows.columns if c != key]
    return joined.select(key, *kept, *[F.col(f"_stats.{c}").alias(c) for c in payload])


def join_frequent_first(
    rows: DataFrame, stats: DataFrame, key: str, count: str, dealt: tuple[int, str] | None = None
) -> DataFrame:
    """Inner join like ``join_statistics`` for rows that are cheap to read twice.

    Rows of the FREQUENT_KEYS most frequent keys, most of a text's words, are answered beside
    the rows and go through no shuffle; only the others are shuffled, none of their keys a large one.
    Rows ``dealt`` into so many parts by a column stay so: those shuffled come back to their part.
    """
    if fits_broadcast(stats, NARROW):
        return rows.join(F.broadcast(stats), key)
    hot = checkpointed(stats.orderBy(F.desc(count), key).limit(FREQUENT_KEYS))
    listed = F.broadcast(hot.select(key))
    rest = rows.join(listed, key, "left_anti").join(stats.join(listed, key, "left_anti"), key)
    if dealt is not None:
        rest = rest.repartition(*dealt)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", times: int = 1) -> DataFrame:
    """Join rows to a dictionary table that is unique in ``key``.

    A dictionary that was counted and found small is broadcast. A larger one is
    matched with the key frequencies of the rows first, so that hot keys can be
    told apart. ``times`` as in ``fits_broadcast``.
    """
    if fits_broadcast(lookup, times):
        return rows.join(F.broadcast(lookup), key, how)
    frequency = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return join_statistics(rows, frequency.join(lookup, key), key, "_n", how).drop("_n")


def without_keys(rows: DataFrame, closed: DataFrame, key: str, count: str) -> DataFrame:
    """Anti join to keys listed with their row counts, balanced as above."""
    marked = join_statistics(
        rows, closed.select(key, count, F.lit(True).alias("_closed")), key, count, "left"
    )
    return marked.filter(F.col("_closed").isNull()).select(*rows.columns)
