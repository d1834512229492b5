"""Removal of word passages that an earlier document holds, found through difference-cover anchors.

A window is WINDOW consecutive words. A word goes when a window that covers it
also starts in a document with a smaller doc_id. Windows are not hashed
everywhere to find the shared ones. Positions modulo PERIOD that belong to COVER,
a perfect difference cover, carry anchors of WINDOW - PERIOD + 1 words: for any
two places of one window there is a shift below PERIOD at which both have an
anchor, and the anchors are equal. So a window can only recur where an anchor
does.

1. Equal texts are settled first: all but the smallest doc_id lose all windows.
2. Anchors (six in 31 words) held by two documents are shared.
3. Around shared anchors the match is extended: the windows that contain one are
   hashed (96 bits), and go where a smaller doc_id holds them, too.

Skew and scale. No pair of documents is ever written. Anchors and windows are
shuffled once, sorted and read as a stream, which keeps one line of a group in
mind, not the group. A batch of documents settles what its own documents share
before that and sends one of them on, so a passage of a third of all documents
reaches the shuffle once per batch. Texts move once, to the places of their shared
anchors; what is left of a text is cut only where it loses words.

Defined results. A null, empty or wordless text has no words and an empty kept
text. Rows with a null doc_id have no place in the order: they lose nothing and
take nothing from others. Rows that repeat a doc_id do not take from each other,
whatever their texts. Words that are left are joined by one space; a text that
loses nothing stays as it is. Extra columns are ignored. Hashes stand for words and windows: the
chance of any wrong match is about 1e-3 in 10^13 windows that share an anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wartaframe.llm.words import Words, mix, pieces, powers, words
from wartaframe.operators.joins import join_statistics
from wartaframe.session import checkpointed

WINDOW = 50
PERIOD = 31
#: Every difference modulo 31 occurs exactly once among these.
COVER = (1, 5, 11, 24, 25, 27)
#: Documents up to which a list of them is copied to all executors instead of moving the texts.
BROADCAST_DOCUMENTS = 1_000
#: Copies (16 bytes each) up to which they are left out before anchors are hashed, else after it.
BROADCAST_COPIES = 1_000_000
_KEY = ["doc_id", "version"]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text that tells rows of one id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("version", F.xxhash64("text"))


def _measured(listed: DataFrame) -> DataFrame:
    """The list, broadcast where it was counted and found short, else merged."""
    short = listed.limit(BROADCAST_DOCUMENTS + 1).count() <= BROADCAST_DOCUMENTS
    return F.broadcast(listed) if short else listed.hint("merge")


def _copies(rows: DataFrame) -> DataFrame:
    """Keys of rows whose text a smaller doc_id has."""
    seen = checkpointed(rows.select(*_KEY, F.xxhash64(F.lit(1), "text").alias("other")))
    seen = seen.select(*_KEY, F.struct("version", "other").alias("content"))
    groups = seen.groupBy("content").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")
    )
    groups = checkpointed(groups.filter("least < most").select("content", "least", "n"))
    copies = join_statistics(seen, groups, "content", "n").filter("doc_id > least")
    return checkpointed(copies.select(*_KEY).distinct())


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal keys, and the run of each row."""
    first = np.zeros(len(keys[0]), bool)
    first[:1] = True
    for key in keys:
        first[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(first), np.cumsum(first) - 1


def _anchors(texts: DataFrame, window: int, length: int) -> DataFrame:
    """(anchor, doc_id, at, sure): hashes of the words at cover positions.

    Rows that are ``sure`` share their anchor with another document of their batch;
    one of these comes again among the others.
    """
    wanted = np.isin(np.arange(PERIOD), COVER)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
            for piece in pieces(batch):
                w = words(piece.column("text"))
                start = w.windows(length)
                place = start - w.first[w.doc[start]]
                kept = wanted[place % PERIOD] & (w.counts[w.doc[start]] >= window)
                start, place = start[kept], place[kept]
                ids = piece.column("doc_id").to_numpy()
                parts.append((w.window_hash(start, length).view(np.int64), ids[w.doc[start]], place.astype(np.int32)))
            anchor, doc, at = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((doc, anchor))
            anchor, doc, at = anchor[order], doc[order], at[order]
            starts, group = _groups(anchor)
            sure = np.zeros(len(anchor), bool)
            if len(starts):
                sure = (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts))[group]
            again = starts[sure[starts]]
            out = np.concatenate((np.arange(len(anchor)), again))
            marks = np.concatenate((sure, np.zeros(len(again), bool)))
            columns = [pa.array(c) for c in (anchor[out], doc[out], at[out], marks)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "at", "sure"])

    return texts.select("doc_id", "text").mapInArrow(rows, "anchor long, doc_id long, at int, sure boolean")


def _shared(anchors: DataFrame) -> DataFrame:
    """doc_id and at of the anchors that two documents hold."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, None
        for batch in batches:
            anchor, doc, at = (batch.column(c).to_numpy() for c in ("anchor", "doc_id", "at"))
            if held is not None:
                anchor, doc, at = (np.concatenate(c) for c in zip(held, (anchor, doc, at)))
            if not len(anchor):
                continue
            starts, group = _groups(anchor)
            shared = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
            shared |= np.zeros(1, bool) if known is None else anchor[starts] == known
            kept = shared[group]
            # the last anchor may go on: its rows wait until a second document comes
            last = slice(starts[-1], None)
            known = anchor[-1] if shared[-1] else None
            held = None if shared[-1] else (anchor[last], doc[last], at[last])
            yield pa.RecordBatch.from_arrays([pa.array(doc[kept]), pa.array(at[kept])], ["doc_id", "at"])

    settled = anchors.filter("sure").select("doc_id", "at")
    rest = anchors.filter("NOT sure").select("anchor", "doc_id", "at").repartition("anchor").sortWithinPartitions("anchor")
    return settled.union(rest.mapInArrow(stream, "doc_id long, at int"))


def _window_hashes(w: Words, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of hash of the n words from each index on."""
    rolling = np.zeros(len(w.doc) + 1, np.uint64)
    np.cumsum(mix(w.hashes ^ np.uint64(0x5DEECE66D)) * powers("up", len(w.doc))[: len(w.doc)], out=rolling[1:])
    other = mix((rolling[start + n] - rolling[start]) * w.down[start])
    return w.window_hash(start, n).view(np.int64), (other >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _marks(total: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each of ``total`` places lies in one of the half-open ranges."""
    steps = np.bincount(begins, minlength=total + 1) - np.bincount(ends, minlength=total + 1)
    return np.cumsum(steps)[:total] > 0


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each item of a column of lists."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)


def _windows(candidates: DataFrame, window: int, length: int) -> DataFrame:
    """(high, low, doc_id, version, at, sure): hashes of all windows around the shared anchors.

    A smaller doc_id of the batch has the rows that are ``sure``.
    """
    names = ["high", "low", *_KEY, "at", "sure"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64, np.int32))]
            for piece in pieces(batch):
                w = words(piece.column("text"))
                row, at = _flat(piece.column("anchors"))
                fits = (at < w.counts[row]) & (w.counts[row] >= window)
                row, at = row[fits], at[fits]
                ends = w.first[row] + np.minimum(at, w.counts[row] - window) + 1
                begins = np.minimum(w.first[row] + np.maximum(at - (window - length), 0), ends)
                start = np.flatnonzero(_marks(len(w.doc), begins, ends))
                row = w.doc[start]
                ids, versions = (piece.column(c).to_numpy()[row] for c in _KEY)
                parts.append((*_window_hashes(w, start, window), ids, versions, (start - w.first[row]).astype(np.int32)))
            high, low, doc, version, at = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((doc, low, high))
            high, low, doc, version, at = (c[order] for c in (high, low, doc, version, at))
            starts, group = _groups(high, low)
            sure = doc > doc[starts][group]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (high, low, doc, version, at, sure)], names)

    schema = "high long, low int, doc_id long, version long, at int, sure boolean"
    return candidates.select(*_KEY, "text", "anchors").mapInArrow(rows, schema)


def _held_before(windows: DataFrame) -> DataFrame:
    """doc_id, version and at of the windows that a smaller doc_id holds."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            high, low, doc = (batch.column(c).to_numpy() for c in ("high", "low", "doc_id"))
            if not len(doc):
                continue
            starts, group = _groups(high, low)
            least = doc[starts]
            if last is not None and last[:2] == (high[0], low[0]):
                least[0] = last[2]
            last = (high[-1], low[-1], least[-1])
            yield batch.filter(pa.array(doc > least[group])).select([*_KEY, "at"])

    settled = windows.filter("sure").select(*_KEY, "at")
    rest = windows.filter("NOT sure").drop("sure").repartition("high", "low").sortWithinPartitions("high", "low", "doc_id")
    return settled.union(rest.mapInArrow(stream, "doc_id long, version long, at int"))


def _long(docs: DataFrame, window: int) -> DataFrame:
    """Rows that may have a window: so many words have at least so many bytes."""
    return _rows(docs).filter((F.octet_length("text") >= 2 * window - 1) & F.col("doc_id").isNotNull())


def _repeats(long: DataFrame, copies: DataFrame, window: int) -> DataFrame:
    """doc_id, version, text and ``starts``: documents with windows that also start in one with a smaller id."""
    length = window - PERIOD + 1
    read = long
    if copies.count() <= BROADCAST_COPIES:
        read = long.join(F.broadcast(copies), _KEY, "left_anti")
    shared = _shared(_anchors(read, window, length))
    # rows of one id get each other's places, too: more windows to look at, no other result
    places = shared.groupBy("doc_id").agg(F.collect_set("at").alias("anchors"))
    copied = copies.groupBy("doc_id").agg(F.collect_set("version").alias("copied"))
    places = checkpointed(places.join(copied, "doc_id", "left"))
    candidates = long.join(_measured(places), "doc_id")
    candidates = candidates.filter(~F.coalesce(F.array_contains("copied", F.col("version")), F.lit(False)))
    candidates = checkpointed(candidates.select(*_KEY, "text", "anchors"))
    gone = _held_before(_windows(candidates, window, length))
    gone = checkpointed(gone.groupBy(*_KEY).agg(F.collect_list("at").alias("starts")))
    # rows that repeat both id and text are one here
    return candidates.drop("anchors").dropDuplicates(_KEY).join(_measured(gone), _KEY)


def _joined(w: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    begins, sizes, doc = w.starts[kept], (w.ends - w.starts)[kept], w.doc[kept]
    # a space after each word but the last of a text
    spaced = np.concatenate((doc[1:] == doc[:-1], [False])) if len(doc) else np.zeros(0, bool)
    sizes = sizes + spaced
    ends = np.cumsum(sizes)
    source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)
    data = w.data[np.minimum(source, max(len(w.data) - 1, 0))]
    data[ends[spaced] - 1] = 32
    offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, sizes, w.texts).astype(np.int64))))
    return pa.Array.from_buffers(pa.large_string(), w.texts, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def shortened(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, version (hash of the text), n_removed, kept_text and whole of the documents that lose words.

    Of copies, which are ``whole`` repeats if they have a window at all, nothing is counted or kept.
    """
    if window < PERIOD:
        raise ValueError(f"windows have {PERIOD} words or more")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                w = words(piece.column("text"))
                row, at = _flat(piece.column("starts"))
                begins = w.first[row] + at
                gone = _marks(len(w.doc), begins, begins + window)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(piece.column(c) for c in _KEY),
                        pa.array(np.bincount(w.doc[gone], minlength=w.texts).astype(np.int64)),
                        _joined(w, ~gone).cast(pa.string()),
                    ],
                    [*_KEY, "n_removed", "kept_text"],
                )

    long = _long(docs, window)
    copies = _copies(long)
    schema = "doc_id long, version long, n_removed long, kept_text string"
    cut = _repeats(long, copies, window).select(*_KEY, "text", "starts").mapInArrow(texts, schema)
    return checkpointed(
        cut.withColumn("whole", F.lit(False)).union(
            copies.select(*_KEY, F.lit(0).cast("long"), F.lit(""), F.lit(True))
        )
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, n_removed and kept_text of every row of ``docs``; text that loses nothing stays as it is."""
    rows = _rows(docs).join(_measured(shortened(docs, window)), _KEY, "left")
    n_words = F.when(F.col("whole"), F.size(F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), F.lit(0))).cast("long"))
    whole = n_words >= window
    return rows.select(
        "doc_id",
        "text",
        F.when(whole, n_words).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole") & ~whole, F.col("text")).otherwise(F.coalesce("kept_text", "text")).alias("kept_text"),
    )


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, joined by one space, of every row."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                w = words(piece.column("text"))
                joined = _joined(w, np.ones(len(w.doc), bool))
                sums = [hashlib.sha256(text.as_buffer()).hexdigest() for text in joined]
                columns = [*(piece.column(c) for c in _KEY), pa.array(w.counts.astype(np.int64)), pa.array(sums, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*_KEY, "n_words", "whole_sha256"])

    rows = _rows(docs).mapInArrow(whole, "doc_id long, version long, n_words long, whole_sha256 string")
    changed = shortened(docs, window).select(*_KEY, "n_removed", "whole", F.sha2("kept_text", 256).alias("kept_sha256"))
    rows = rows.join(_measured(changed), _KEY, "left")
    untouched = F.col("whole").isNull() | (F.col("whole") & (F.col("n_words") < window))
    removed = F.when(F.col("whole"), F.col("n_words")).otherwise(F.col("n_removed"))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(untouched, F.lit(0)).otherwise(removed).alias("n_removed"),
        F.when(untouched, F.col("whole_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


#: The same rows from strings of whole windows.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
win AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS s
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE doc_id IS NOT NULL)
),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS k FROM win JOIN least USING (s) WHERE doc_id > m
),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (
  SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (r, k) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
