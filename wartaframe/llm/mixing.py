"""Mixing sources to target weights by systematic sampling.

Every source has a target number of words; each of its documents is expected
target / source_size times in the mix. The expected copies are summed up along
the source, one random offset is added, and a document is emitted once for each
integer boundary its interval crosses: at most ``max_times`` times, and always
as a whole. Documents run from long to short, so that neighbours are of like size
and the words taken stay within about one document of the target.

The position of a document in its source is found without sorting the source in
one task: counts per (source, size) and per (source, size, lane) give offsets, a
lane holds 1/256 of one size of one source, and only lanes are sorted. The table
of sources (one row each) is the only one ordered as a whole.

Defined results. A null or wordless text has size 0 and is emitted without
adding words. Null sources are one source, ordered last. Rows that repeat a
document are sampled one by one by ``mix_plan``; ``mix`` emits them as one
document whose copies add up. An empty table gives an empty mix. Reruns agree:
offset and lanes are hashes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wartaframe.llm.words import WORD
from wartaframe.session import checkpointed

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words.
SHARE = 1.5
MAX_TIMES = 2
SEED = "mix-1"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and number of words; narrow, so that text is read once."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    lane = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("_key"),
        words.alias("size"),
        lane.alias("_lane"),
        F.xxhash64("text").alias("_text"),
    )


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_times: int = MAX_TIMES,
) -> DataFrame:
    """(_key, source_size, target): shares by weight, stopped at the limit of each source.

    The shares that end at their limits are those with the smallest limit per
    weight; what they leave is divided among the others by weight.
    """
    per_source = sizes.groupBy("_key").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy((F.col("_key") == "").cast("int"), "_key")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    everything = Window.partitionBy()
    limit = (max_times * F.col("source_size")).cast("double")
    ordered = Window.orderBy("_ratio", "_key")
    table = (
        per_source.withColumn("_w", F.get(F.array(*[F.lit(float(w)) for w in weights]), place))
        .withColumn("_limit", limit)
        .withColumn("_ratio", F.col("_limit") / F.col("_w"))
        .withColumn("_goal", share * F.sum("source_size").over(everything))
        .withColumn("_before", F.coalesce(F.sum("_limit").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_after", F.sum("_w").over(ordered.rowsBetween(0, Window.unboundedFollowing)))
    )
    stopped = (F.col("_goal") - F.col("_before")) * F.col("_w") >= F.col("_limit") * F.col("_after")
    table = table.withColumn("_stopped", stopped)
    spent = F.coalesce(F.sum(F.when(F.col("_stopped"), F.col("_limit"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_stopped"), F.col("_w"))).over(everything)
    level = (F.col("_goal") - spent) / open_weight
    target = F.when(F.col("_stopped"), F.col("_limit")).otherwise(F.col("_w") * level)
    return table.select("_key", "source_size", target.alias("target"))


def ranked(sizes: DataFrame) -> DataFrame:
    """Adds ``_rank``: 1-based position in the source, long documents first."""
    lanes = sizes.groupBy("_key", "size", "_lane").agg(F.count(F.lit(1)).alias("_n"))
    by_size = lanes.groupBy("_key", "size").agg(F.sum("_n").alias("_n"))

    def before(window: Window) -> Column:
        return F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    by_size = by_size.select(
        "_key", "size", before(Window.partitionBy("_key").orderBy(F.desc("size"))).alias("_longer")
    )
    lanes = lanes.select(
        "_key", "size", "_lane", before(Window.partitionBy("_key", "size").orderBy("_lane")).alias("_same")
    )
    starts = lanes.join(by_size, ["_key", "size"]).select(
        "_key", "size", "_lane", (F.col("_longer") + F.col("_same")).alias("_start")
    )
    own = Window.partitionBy("_key", "size", "_lane").orderBy("doc_id", "_text")
    return (
        sizes.withColumn("_own", F.row_number().over(own))
        .join(starts, ["_key", "size", "_lane"])
        .withColumn("_rank", F.col("_start") + F.col("_own"))
        .drop("_own", "_start")
    )


def mix_plan(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_times: int = MAX_TIMES,
    seed: str = SEED,
) -> DataFrame:
    """Copies of each row of ``docs`` in the mix, and the words they take."""
    sizes = checkpointed(sized(docs))
    targets = source_targets(sizes, weights, share, max_times)
    first = F.substring(F.md5(F.concat(F.lit(seed), F.col("_key"))), 1, 8)
    offset = F.conv(first, 16, 10).cast("double") / float(1 << 32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(F.col("_rate") * F.col("_rank") + F.col("_offset")) - F.floor(
        F.col("_rate") * (F.col("_rank") - 1) + F.col("_offset")
    )
    targets = targets.withColumn("_rate", rate).withColumn("_offset", offset)
    # one row per source; a hot source is the larger side of the join, which adaptive execution can split
    return (
        ranked(sizes)
        .join(targets, "_key")
        .withColumn("copies", copies.cast("long"))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("copies") * F.col("size")).alias("taken"),
            "copies",
            "_text",
        )
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, repeated as planned."""
    # the columns of docs stay inside one struct, so that no name of theirs can meet one of the plan's
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text"))
    rows = docs.select(own.alias("key"), F.struct("*").alias("row")).dropDuplicates(["key"])
    plan = mix_plan(docs.select("doc_id", "text", "source"), **options)
    plan = plan.groupBy(F.struct("doc_id", "_text").alias("key")).agg(F.sum("copies").cast("int").alias("copies"))
    repeated = rows.join(plan.filter("copies > 0"), "key")
    return repeated.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


#: The plan in DuckDB SQL, with the parameters above.
PLAN_SQL = rf"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, '') AS key,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS lane
  FROM documents),
sources AS (SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
weighed AS (
  SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE],
      ((row_number() OVER (ORDER BY (key = '')::INTEGER, key) - 1) % 3 + 1)::INTEGER) AS w,
    ({MAX_TIMES} * source_size)::DOUBLE AS lim,
    {SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS goal
  FROM sources),
ordered AS (
  SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY lim / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM weighed),
stopped AS (SELECT *, (goal - before) * w >= lim * after AS stop FROM ordered),
targets AS (
  SELECT key, source_size, CASE WHEN stop THEN lim ELSE w *
    ((goal - coalesce(sum(lim) FILTER (WHERE stop) OVER (), 0)) / sum(w) FILTER (WHERE NOT stop) OVER ()) END AS target,
    ('0x' || substr(md5('{SEED}' || key), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS off
  FROM stopped),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY size DESC, lane, doc_id) AS place FROM sized),
copied AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM ranked JOIN targets USING (key))
SELECT doc_id, size, source_size, target,
  ((floor(rate * place + off) - floor(rate * (place - 1) + off)) * size)::BIGINT AS taken
FROM copied
"""
