"""Resampling of documents towards a target text distribution, by bit-sliced importance weights.

Features are all runs of one to three consecutive words; a feature falls into the
bucket of its CRC-32. A bucket's gain is the scaled and rounded log ratio of its
smoothed shares in the target texts and in the corpus. A document's weight is the
sum of gains over its features. It is found by bit-sliced aggregation: the bucket
counts of a document become planes of bits (plane k holds bit k of every count),
and so do the gains (positive and negative ones apart). The popcount of a count
plane AND a gain plane, times the power of two of both, summed over all pairs of
planes, is the exact weight.

A document's score is its weight plus a Gumbel variate that a digest of its id
fixes, so the highest scores are a draw without replacement in proportion to
exp(weight / 1000), and reruns agree. PERCENT of the documents with LEAST_WORDS
words or more are drawn.

Scale. Three passes over narrow rows: bucket counts are summed inside a task
before their shuffle and BUCKETS lines reach the driver, whatever the corpus;
weights take one pass over the texts; ranks come from range partitions and the
counts of those, never from one task.

Defined results. A null, empty or wordless text has no features and weight 0. A
null doc_id is digested as an empty one and comes last among ties. Rows that
repeat an id are drawn one by one, the one with fewer features first in a tie.
Without target texts all gains follow from smoothing alone. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wartaframe.llm.words import Words, pieces, words
from wartaframe.session import checkpointed

BUCKETS = 10_000
LONGEST_RUN = 3
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
#: Documents whose counts are unfolded at once.
CHUNK = 256

_bytes = np.arange(256, dtype=np.uint8)
_is_upper = (_bytes >= ord("A")) & (_bytes <= ord("Z"))
_is_word = _is_upper | ((_bytes >= ord("0")) & (_bytes <= ord("9"))) | ((_bytes >= ord("a")) & (_bytes <= ord("z"))) | (_bytes >= 0x80)
#: Lower case of A-Z; bytes outside words become spaces.
_FOLDED = np.where(_is_word, np.where(_is_upper, _bytes + 32, _bytes), 32).astype(np.uint8)


def _folded(texts: pa.Array) -> pa.Array:
    """The texts with words of this operator set apart by spaces."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    data = _FOLDED[np.frombuffer(data, np.uint8)]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(data)], offset=texts.offset)


@lru_cache(maxsize=4096)
def _zeros(length: int) -> np.ndarray:
    """What ``length`` zero bytes after a text do to each byte of its CRC: four tables of 256."""
    if length == 1:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
        rest = [np.arange(256, dtype=np.uint32) << np.uint32(8 * (k - 1)) for k in (1, 2, 3)]
        return np.stack([table, *rest])
    half = _zeros(length // 2)
    out = _shifted(half, half)
    return _shifted(out, _zeros(1)) if length % 2 else out


def _shifted(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return (
        tables[0][crc & byte]
        ^ tables[1][(crc >> np.uint32(8)) & byte]
        ^ tables[2][(crc >> np.uint32(16)) & byte]
        ^ tables[3][crc >> np.uint32(24)]
    )


def _appended(crc: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts with tails appended, from both CRCs and the tails' lengths in bytes."""
    out = np.empty_like(crc)
    order = np.argsort(length, kind="stable")
    sizes, starts = np.unique(length[order], return_index=True)
    for size, rows in zip(sizes, np.split(order, starts[1:])):
        out[rows] = _shifted(crc[rows], _zeros(int(size))) ^ tail[rows]
    return out


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every feature."""
    if not len(w.doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
    spans = [w.data[a:b].tobytes() for a, b in zip(w.starts[first], w.ends[first])]
    space = zlib.crc32(b" ")
    alone = np.array([zlib.crc32(s) for s in spans], np.uint32)[which]
    after = np.array([zlib.crc32(s, space) for s in spans], np.uint32)[which]
    length = w.ends - w.starts + 1
    rows, values, crc = [w.doc], [alone], alone
    for n in range(2, LONGEST_RUN + 1):
        at = w.windows(n)
        crc = _appended(crc[at], after[at + n - 1], length[at + n - 1])
        rows.append(w.doc[at])
        values.append(crc)
        whole = np.zeros(len(w.doc), np.uint32)
        whole[at] = crc
        crc = whole
    return np.concatenate(rows), np.concatenate(values).astype(np.int64) % BUCKETS


def _split(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Pieces of a batch and the words of their texts."""
    at = batch.schema.get_field_index("text")
    batch = batch.set_column(at, "text", _folded(batch.column("text")))
    for piece in pieces(batch):
        yield piece, words(piece.column("text"))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Number of features in each bucket over all texts."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, w in _split(batch):
                total += np.bincount(_features(w)[1], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in counted.collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of each bucket's smoothed shares, rounded down."""
    all_corpus, all_target = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratios = (target + 1.0) * all_corpus / ((corpus + 1.0) * all_target)
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _planes(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Signed powers of two, and the plane of the buckets whose gain holds them."""
    out = []
    for sign, size in ((1, np.maximum(gain, 0)), (-1, np.maximum(-gain, 0))):
        for bit in range(int(size.max(initial=0)).bit_length()):
            out.append((sign << bit, _planes(((size >> bit) & 1).astype(bool)[None])[0]))
    return out


def bit_sliced_weights(row: np.ndarray, bucket: np.ndarray, rows: int, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum of gains over the features of each row."""
    weight = np.zeros(rows, np.int64)
    cell, count = np.unique(row * BUCKETS + bucket, return_counts=True)
    doc = cell // BUCKETS
    for low in range(0, rows, CHUNK):
        begin, end = np.searchsorted(doc, (low, low + CHUNK))
        own, place, n = doc[begin:end], cell[begin:end] % BUCKETS, count[begin:end]
        for bit in range(int(n.max(initial=0)).bit_length()):
            has = (n >> bit) & 1 > 0
            named, at = np.unique(own[has], return_inverse=True)
            bits = np.zeros((len(named), BUCKETS), bool)
            bits[at, place[has]] = True
            sliced = _planes(bits)
            for power, plane in planes:
                weight[named] += (power << bit) * np.bitwise_count(sliced & plane).sum(axis=1, dtype=np.int64)
    return weight


def weighted(docs: DataFrame, planes: list[tuple[int, np.ndarray]]) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, w in _split(batch):
                row, bucket = _features(w)
                weight = bit_sliced_weights(row, bucket, len(piece), planes)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(w.counts.astype(np.int64)),
                        pa.array(np.bincount(row, minlength=len(piece)).astype(np.int64)),
                        pa.array(weight),
                    ],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def _with_score(rows: DataFrame, seed: int) -> DataFrame:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + gumbel.cast("long"))


def _ranked(rows: DataFrame, draw: int) -> DataFrame:
    """Adds ``rank`` by falling score to the first ``draw`` rows, null to the others."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    # equal rows may part anywhere, so a heap of them is no single partition
    ranged = rows.withColumn("lane", F.rand(1)).repartitionByRange(*order, F.asc("lane"))
    ranged = checkpointed(ranged.withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for part, n in sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        if before < draw:
            offsets.append((part, before))
        before += n
    parts = ranged.sparkSession.createDataFrame(offsets, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order, "lane")) + F.col("before")
    drawn = ranged.join(F.broadcast(parts), "part").withColumn("rank", place.cast("long"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).select(*rows.columns, "rank")
    last = max((part for part, _ in offsets), default=-1)
    rest = ranged.filter(F.col("part") > last).select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return drawn.union(rest)


def resampling(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; ranks only of those drawn.

    ``target`` holds the texts of the wanted distribution in its column ``text``.
    """
    planes = gain_planes(gains(bucket_counts(docs), bucket_counts(target)))
    scored = checkpointed(_with_score(weighted(docs, planes), seed))
    eligible = scored.filter(F.col("n_words") >= least_words)
    draw = percent * eligible.count() // 100
    short = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return _ranked(eligible, draw).union(short)


_NIBBLES = [0] * 16
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = (_c >> 1) ^ (0xEDB88320 * (_c & 1))
    _NIBBLES[_i] = _c


def _sql_step(x: str) -> str:
    table = "[" + ", ".join(f"{c}::UBIGINT" for c in _NIBBLES) + "]"
    return f"xor(({x}) >> 4, {table}[CAST(({x}) & 15 AS INTEGER) + 1])"


_RUNS = """list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"""
_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: The same rows with CRC-32 over every byte of every feature.
SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w, false AS wanted FROM documents
  UNION ALL SELECT 0, NULL, {_WORDS}, true FROM benchmark
),
runs AS (
  SELECT r, wanted, x, count(*) AS n FROM (SELECT r, wanted, unnest({_RUNS}) AS x FROM texts) GROUP BY ALL
),
names AS (
  SELECT x, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::UBIGINT) AS bytes
  FROM (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM runs))
),
buckets AS (
  SELECT x, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes),
    lambda c, b: {_sql_step(_sql_step("xor(c, b)"))}), 4294967295::UBIGINT) % {BUCKETS} AS INTEGER) AS bucket
  FROM names
),
counted AS (SELECT r, wanted, bucket, sum(n) AS n FROM runs JOIN buckets USING (x) GROUP BY ALL),
sums AS (
  SELECT CAST(coalesce(sum(n) FILTER (NOT wanted), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (wanted), 0) AS DOUBLE) AS t
  FROM counted
),
per_bucket AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (NOT wanted), 0) AS DOUBLE) AS s,
         CAST(coalesce(sum(n) FILTER (wanted), 0) AS DOUBLE) AS t
  FROM counted GROUP BY bucket
),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((b.t + 1) * (a.s + {BUCKETS}) / ((b.s + 1) * (a.t + {BUCKETS})))) AS BIGINT) AS g
  FROM per_bucket b, sums a
),
weights AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight
  FROM counted JOIN gain USING (bucket) WHERE NOT wanted GROUP BY r
),
scored AS (
  SELECT r, doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE
         ))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (r) WHERE NOT wanted
),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n
  FROM scored WHERE words >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""
