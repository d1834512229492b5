"""Hard negatives of stated anchors, by a vertical scan with bounds (BOND).

Vectors are scaled to integers and compared by their exact inner product. For
each anchor the first POSITIVES rows of its label are its positives; for each of
these, the first NEGATIVES rows of other labels whose score lies between two
shares of the positive's score are its hard negatives.

A shard of the vectors is stored dimension by dimension with the least and the
largest value of each. An anchor reads the dimensions in the order of its own
descending magnitudes, STEP at a time. What the unread dimensions can still add
is bounded from below and above by those values, so a candidate leaves the bitmap
as soon as its upper bound is below the best rows found, or its bounds miss every
window. Whoever is left after the last dimension has its exact score.

Scale. Every anchor must be held against every row, as its windows are exact. Both
meet in blocks: a task holds one shard and one block of anchors (some
megabytes), and sends on the few best of each anchor. With s rows a shard and b
anchors a block, n rows and m anchors cost n * m * (1/s + 1/b) shuffled vectors.
Shards are dealt by row, so neither a frequent label nor copies fill a task.

Defined results. Rows with a null label, vector or id, or a null or non-finite
component take no part. A shorter vector counts as padded with zeros; an empty
one scores 0 with all. Scaled components beyond 2^26 count as 2^26. Rows that
repeat an id are rows of their own: only an anchor's own row is not its
candidate. Score ties go to the smaller id. Anchors without positives, and
positives without hard negatives, give no rows, nor does an empty table. A positive
score below zero has an empty window. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wartaframe.session import checkpointed

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Share of the positive's score, in percent, that a hard negative's score has at least and at most.
LEAST_PERCENT = 50
MOST_PERCENT = 95
SHARD_ROWS = 8192
ANCHOR_BLOCK = 8192
#: Dimensions that are read between two looks at the bounds.
STEP = 8
ANCHOR_EVERY = 50
_LIMIT = 1 << 26


def scaled(vectors: DataFrame, id_column: str, vector_column: str, label: Column) -> DataFrame:
    """(row, id, label, v) of the rows that take part; ``row`` tells rows of one id apart."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite)
    whole = F.transform("v", lambda x: F.least(F.greatest(F.floor(x * SCALE), F.lit(-_LIMIT)), F.lit(_LIMIT)).cast("int"))
    # the numbers of rows are fixed by the checkpoint
    return checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("v")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as the columns of a matrix, padded with zeros."""
    sizes = column.combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((width, len(sizes)), np.int64)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at, np.repeat(np.arange(len(sizes)), sizes)] = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max((int(max(c.combine_chunks().value_lengths().to_pylist(), default=0)) for c in columns), default=0)


class Columns:
    """The vectors of a shard, stored by dimension, in the order of ties."""

    def __init__(self, found: pa.Table, width: int):
        found = found.sort_by([("id", "ascending"), ("row", "ascending")])
        self.row, self.id, self.label = (found.column(c).to_numpy() for c in ("row", "id", "label"))
        self.x = _matrix(found.column("v"), width)
        self.low, self.high = self.x.min(axis=1, initial=0), self.x.max(axis=1, initial=0)
        largest = np.maximum(-self.low, self.high)
        # doubles are faster and exact while no sum reaches 2^53
        self.exact = float(largest.sum())
        self.doubles = self.x.astype(np.float64)

    def scan(
        self, anchor: np.ndarray, alive: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]
    ) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the candidates that ``wanted`` keeps to the end.

        ``alive`` are the places of the first candidates in order; ``wanted`` is given
        lower and upper bounds of their scores.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        least = np.minimum(a * self.low[order], a * self.high[order])
        most = np.maximum(a * self.low[order], a * self.high[order])
        safe = self.exact * float(np.abs(a).max(initial=0)) < 2**53
        x, a = (self.doubles, a.astype(np.float64)) if safe else (self.x, a)
        score = np.zeros(len(alive), x.dtype)
        for start in range(0, len(order), STEP):
            read = order[start : start + STEP]
            block = x[read] if len(alive) == len(self.row) else x[np.ix_(read, alive)]
            score += a[start : start + STEP] @ block
            rest = start + STEP
            kept = wanted(score + int(least[rest:].sum()), score + int(most[rest:].sum()))
            alive, score = alive[kept], score[kept]
            if not len(alive):
                break
        return alive, score.astype(np.int64)


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n highest scores, the first in a tie."""
    return np.argsort(-score, kind="stable")[:n]


def _nth(values: np.ndarray, n: int):
    """The n-th highest value, or less than any without so many."""
    return np.partition(values, -n)[-n] if len(values) >= n else -np.inf


def _meet(rows: DataFrame, anchors: DataFrame, search, schema: str, extra: list[str]) -> DataFrame:
    """Rows of ``search(shard, block)`` for every shard of rows and block of anchors."""
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("row", F.lit(9)), F.lit(blocks)).cast("int").alias("block")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    held = rows.select(shard, every_block, "row", "id", "label", "v")
    asked = anchors.select(block, every_shard, "row", "id", "label", "v", *extra)
    return held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, schema)


def _table(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.Table.from_arrays([pa.array(c) for c in columns], names)


def _positives(rows: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """anchor, anchor_id, positive_id, positive_score, place: the first rows of an anchor's label."""
    names = ["anchor", "anchor_id", "positive", "positive_id", "positive_score"]

    def search(found: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if len(found) and len(asked):
            width = _width(found.column("v"), asked.column("v"))
            shard, vectors = Columns(found, width), _matrix(asked.column("v"), width)
            who = [asked.column(c).to_numpy() for c in ("row", "id", "label")]
            for k, (row, name, label) in enumerate(zip(*who)):
                same = np.flatnonzero((shard.label == label) & (shard.row != row))
                place, score = shard.scan(vectors[:, k], same, lambda low, high: high >= _nth(low, most))
                best = _best(score, most)
                place, ones = place[best], np.ones(len(best), np.int64)
                parts.append((row * ones, name * ones, shard.row[place], shard.id[place], score[best]))
        return _table(parts, names)

    hits = _meet(rows, anchors, search, ", ".join(f"{n} long" for n in names), [])
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def _negatives(rows: DataFrame, anchors: DataFrame, most: int, percents: tuple[int, int]) -> DataFrame:
    """anchor, positive_score, negative_id, negative_score, rank for the windows ``scores`` of each anchor."""
    names = ["anchor", "positive_score", "negative", "negative_id", "negative_score"]
    least_percent, most_percent = percents

    def search(found: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if len(found) and len(asked):
            width = _width(found.column("v"), asked.column("v"))
            shard, vectors = Columns(found, width), _matrix(asked.column("v"), width)
            who = [asked.column(c).to_numpy() for c in ("row", "label")]
            for k, (row, label, scores) in enumerate(zip(*who, asked.column("scores").to_pylist())):
                windows = [(s, -(-least_percent * s // 100), most_percent * s // 100) for s in scores]

                def wanted(low, high):
                    kept = np.zeros(len(low), bool)
                    for _, bottom, top in windows:
                        sure = low[(low >= bottom) & (high <= top)]
                        kept |= (high >= max(bottom, _nth(sure, most))) & (low <= top)
                    return kept

                other = np.flatnonzero(shard.label != label)
                place, score = shard.scan(vectors[:, k], other, wanted)
                for s, bottom, top in windows:
                    inside = np.flatnonzero((score >= bottom) & (score <= top))
                    inside = inside[_best(score[inside], most)]
                    at, ones = place[inside], np.ones(len(inside), np.int64)
                    parts.append((row * ones, s * ones, shard.row[at], shard.id[at], score[inside]))
        return _table(parts, names)

    hits = _meet(rows, anchors, search, ", ".join(f"{n} long" for n in names), ["scores"])
    order = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percents: tuple[int, int] = (LEAST_PERCENT, MOST_PERCENT),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``is_anchor`` is a condition on ``id``; ``label`` is the column ``label`` unless given.
    """
    rows = scaled(vectors, id_column, vector_column, F.col("label") if label is None else label)
    anchors = rows.filter(is_anchor)
    near = checkpointed(_positives(rows, anchors, positives))
    asked = near.groupBy("anchor").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    # both tables have one line for each anchor
    asked = anchors.join(asked, anchors["row"] == asked["anchor"]).drop("anchor")
    far = _negatives(rows, checkpointed(asked), negatives, percents)
    return near.join(far, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def standard_anchors(every: int = ANCHOR_EVERY) -> Column:
    return F.col("id") % every == 0


def shifted_label(id_column: str = "vec_id", every: int = 7, labels: int = 10) -> Column:
    """The label, moved on by one where the id is divisible by ``every``."""
    return F.when(F.col(id_column) % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))


#: The same rows from all pairs.
SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
met AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % {ANCHOR_EVERY} = 0
),
pos AS (
  SELECT anchor, anchor_id, other AS positive, id AS positive_id, score AS positive_score FROM met WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN met USING (anchor, anchor_id)
WHERE NOT same AND {LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= {MOST_PERCENT} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, id) <= {NEGATIVES}
"""
