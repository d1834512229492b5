"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order of distance (the first
PREFIX of PIVOTS). Each shard of the index posts its vectors in an inverted file
per pivot. A query walks the files of its own nearest pivots, which yields the
footrule distance between its permutation and those of all vectors met; the best
RERANK share is compared on the original vectors in double precision.

Pivots are PIVOTS different vectors with the smallest hashes of their ids: a
bounded sample, copied to all tasks. Every row is indexed. Shards are dealt out by a hash of the
id and hold SHARD_ROWS vectors (expected), whatever labels or copies there are.
Queries are a stated set; they meet the shards in blocks of QUERY_BLOCK, so a
task holds one shard and one block, and sends on the best of each query only.
Footrule ties go to the smaller id, so of many equal vectors the right ones stay.

Defined results. Vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do null ids. Rows that
repeat an id count once (the smallest vector). A query has every other row as a
candidate; with fewer than k rows all are returned. Score ties go to the smaller
id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wartaframe.session import checkpointed

PIVOTS = 512
PREFIX = 32
SHARD_ROWS = 8192
QUERY_BLOCK = 1024
#: Share of a shard that is reranked, and the least number of vectors.
RERANK = 0.3
RERANK_LEAST = 1000
K = 10
QUERY_EVERY = 100


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the vectors that take part, one row per id."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    rows = checkpointed(rows.groupBy("id").agg(F.min("v").alias("v")))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (usual.n if usual else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties to the smaller pivot."""
    apart = (pivots**2).sum(axis=1) - 2 * x @ pivots.T
    return np.argsort(apart, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def permuted(rows: DataFrame, pivots: np.ndarray, prefix: int) -> DataFrame:
    """Adds ``perm``: the ordered nearest pivots of each vector."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                perm = _permutations(_matrix(part.column("v")), pivots, prefix)
                ends = np.arange(len(perm) + 1, dtype=np.int32) * perm.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(perm.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), lists], ["id", "v", "perm"])

    return rows.mapInArrow(add, "id long, v array<double>, perm array<smallint>")


class InvertedFiles:
    """Postings (vector, place) of each pivot for the vectors of one shard."""

    def __init__(self, perm: np.ndarray, pivots: int):
        self.rows, self.prefix = perm.shape
        order = np.argsort(perm.ravel(), kind="stable")
        self.vector = order // self.prefix
        self.place = order % self.prefix
        self.start = np.searchsorted(perm.ravel()[order], np.arange(pivots + 1))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Footrule distance to every vector, less a constant; absent pivots stand at the end."""
        total = np.zeros(self.rows, np.int64)
        for place, pivot in enumerate(query):
            post = slice(self.start[pivot], self.start[pivot + 1])
            theirs = self.place[post]
            total[self.vector[post]] += np.abs(theirs - place) - (self.prefix - theirs) - (self.prefix - place)
        return total


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = K,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    rerank: float = RERANK,
) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows found for each query.

    ``is_query`` is a condition on ``id``.
    """
    rows = usable(vectors, id_column, vector_column)
    # a bounded sample, four times as large as needed: equal vectors make one pivot
    chosen = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(4 * pivots).select("v").collect()
    chosen = list(dict.fromkeys(tuple(r.v) for r in chosen))[:pivots]
    count = rows.count()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table = np.array(chosen)
    prefix = min(prefix, len(table))
    index = checkpointed(permuted(rows, table, prefix))

    shards = -(-count // SHARD_ROWS)
    blocks = -(-index.filter(is_query).count() // QUERY_BLOCK)
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(max(1, blocks))).cast("int")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))).alias("block")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    posted = index.select(shard.alias("shard"), "id", "v", "perm").select("shard", every_block, "id", "v", "perm")
    asked = index.filter(is_query).select(block.alias("block"), "id", "v", "perm")
    asked = asked.select(every_shard, "block", "id", "v", "perm")

    def search(found: pa.Table, queries: pa.Table) -> pa.Table:
        found = found.sort_by("id")
        ids, x = found.column("id").to_numpy(), _matrix(found.column("v")) if len(found) else None
        out: list[tuple[np.ndarray, ...]] = []
        if len(found) and len(queries):
            files = InvertedFiles(_matrix(found.column("perm")), len(table))
            most = max(RERANK_LEAST, int(rerank * len(ids)))
            asked_by = queries.column("id").to_numpy()
            for q, v, perm in zip(asked_by, _matrix(queries.column("v")), _matrix(queries.column("perm"))):
                near = np.argsort(files.footrule(perm), kind="stable")[: most + 1]
                near = near[ids[near] != q][:most]
                score = np.sqrt(((x[near] - v) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], score))[:k]
                out.append((np.full(len(best), q), ids[near[best]], score[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for t in (int, int, float)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    met = posted.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    hits = met.applyInArrow(search, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def standard_queries(every: int = QUERY_EVERY) -> Column:
    return F.col("id") % every == 0
