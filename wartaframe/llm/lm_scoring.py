"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of all words and of all pairs of neighbours (the end of a text is a word)
over the training texts are quantised: up to EXACT each count is a level of its own,
above it each level is GROWTH times the one below. Level j of an n-gram is one
element of the filter, so a count is read back by probing levels until one is
missing, and stands for the mean count of the n-grams read at that level, which
keeps the sum of all counts. The filter is made of segments with a fixed number of bits for each
element, so it grows with what it holds: n-grams are dealt out by hash, about
GROUP_TOKENS tokens a group, and each group of the shuffle counts its own exactly,
writes its own segment and probes it for all texts that asked. No segment leaves
its task; there is no word list and no upper size.

Texts are taken in pieces of a few hundred documents. A piece asks each group once
for its distinct n-grams, with their counts in the piece's training texts, so a
frequent word or pair is one entry for each piece and no group is hot. The answers,
exact counts of words and levels of all n-grams in the order of the question, meet
the piece again, which sums them up for its documents.

Model: p(w) = (c(w) + 1) / (N + V + 1) from probed counts, and after a word v of the
training texts, p(w | v) = L * c(v, w) / c(v) + (1 - L) * p(w) with L = PAIR_WEIGHT;
every v is followed by a word or the end, so both add up to 1, but for the width of
the levels and a chance of 1e-6 that a pair never seen is found. The base score takes
the exact counts of single words.

Defined results. A null text is empty: its only token is the end. A null doc_id
counts as the empty text in the hash that holds documents out. Rows that repeat
get equal scores. Without training texts every probability is 1 and every base
score 0. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wartaframe.llm.toxicity import remainder
from wartaframe.llm.words import Words, mix, pieces, words
from wartaframe.session import checkpointed

#: A missing element is found with a chance of (1 - exp(-12 / 32))^12, below 1e-6.
BITS_PER_ELEMENT = 32
PROBES = 12
EXACT, GROWTH = 16, 1.06
#: Quantised counts end at 2^40.
LEVELS = EXACT + int(np.ceil(np.log(2.0**40 / EXACT) / np.log(GROWTH)))
PAIR_WEIGHT = 0.5
#: Tokens of the corpus for each group of the shuffle, and the least number of groups.
GROUP_TOKENS = 2_000_000
LEAST_GROUPS = 8
#: Zstandard level of the packed texts.
TEXT_LEVEL = 7
#: Bytes of a pair's hash within its group.
PAIR_BYTES = 5
HELD_OUT = (7, 2)
END = np.uint64(0x656E64)
_ASKED = "piece long, bucket int, words binary, word_counts binary, pairs binary, pair_counts binary"
_ANSWERED = (
    "piece long, bucket int, n long, v long, exact binary, word_levels binary, "
    "pair_levels binary, by_level array<long>"
)


def _training(doc_ids: pa.Array) -> np.ndarray:
    n, out = HELD_OUT
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % n == out for d in doc_ids.to_pylist()]
    return ~np.array(held, bool)


def _packed_pieces(docs: DataFrame) -> DataFrame:
    """(piece, tokens, data): compressed runs of documents, the unit of questions and answers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=TEXT_LEVEL))
        for batch in batches:
            for piece in pieces(batch):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=options) as out:
                    out.write_batch(piece)
                w = words(piece.column("text"), lower=True)
                data = [[number], [len(w.hashes) + w.texts], [sink.getvalue().to_pybytes()]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(data, (pa.int64(), pa.int64(), pa.binary()))],
                    ["piece", "tokens", "data"],
                )
                number += 1

    return docs.select("doc_id", "text").mapInArrow(rows, "piece long, tokens long, data binary")


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _sequence(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, the end of each text included, and its text."""
    tokens = np.full(len(w.hashes) + w.texts, END, np.uint64)
    tokens[np.arange(len(w.hashes)) + w.doc] = w.hashes
    return tokens, np.repeat(np.arange(w.texts), w.counts + 1)


def _pairs(tokens: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each token that follows another one of its text, and the key of the two."""
    second = 1 + np.flatnonzero(doc[1:] == doc[:-1])
    return second, mix(tokens[second - 1] * np.uint64(3) + tokens[second])


def _dealt(keys: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts keys of one group side by side, and the groups' bounds in it."""
    bucket = keys % np.uint64(groups)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(groups + 1, dtype=np.uint64))


def _small(values: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the largest one needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}" if n else np.uint8).astype(np.int64)


def _pair_bytes(keys: np.ndarray, groups: int) -> bytes:
    """What tells pairs of one group apart."""
    rest = np.ascontiguousarray(keys // np.uint64(groups)).astype("<u8").view(np.uint8)
    return rest.reshape(-1, 8)[:, :PAIR_BYTES].tobytes()


def _pair_keys(data: bytes) -> np.ndarray:
    keys = np.zeros((len(data) // PAIR_BYTES, 8), np.uint8)
    keys[:, :PAIR_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, PAIR_BYTES)
    return keys.view("<u8").ravel().astype(np.uint64)


def _elements(keys: np.ndarray, level: int | np.ndarray) -> np.ndarray:
    return mix(keys + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64))


def _levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 0 where there is none."""
    above = np.log(np.maximum(counts, EXACT) / EXACT) / np.log(GROWTH)
    return np.minimum(np.minimum(counts, EXACT) + np.ceil(above - 1e-9).astype(np.int64), LEVELS)


def _segment(keys: np.ndarray, counts: np.ndarray, most_bits: int | None = None) -> bytes:
    """Bits of a filter segment that holds all levels of all keys; ``most_bits`` is for tests."""
    levels = _levels(counts)
    bits = int(max(64, min(BITS_PER_ELEMENT * levels.sum(), most_bits or np.inf))) // 8 * 8
    out = np.zeros(bits // 8, np.uint8)
    order = np.argsort(-levels, kind="stable")
    keys, levels = keys[order], levels[order]
    for level in range(1, int(levels.max(initial=0)) + 1):
        element = _elements(keys[: np.searchsorted(-levels, -level, side="right")], level)
        for probe in range(PROBES):
            bit = mix(element + np.uint64(probe)) % np.uint64(bits)
            np.bitwise_or.at(out, (bit >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (bit & np.uint64(7)).astype(np.uint8))
    return out.tobytes()


def joined(segments: dict[int, bytes], groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits and first bit of each segment, and all segments in one array."""
    parts = [segments.get(i, b"\0" * 8) for i in range(groups)]
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    return (sizes * 8).astype(np.uint64), (np.cumsum(sizes) - sizes) * 8, data


def _middle(levels: np.ndarray) -> np.ndarray:
    """A count for each level."""
    return np.minimum(levels, EXACT) * GROWTH ** np.maximum(levels - EXACT - 0.5, 0)


def _by_level(levels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Number of seen n-grams read at each level, then the sums of their counts."""
    at, count = levels[counts > 0], counts[counts > 0]
    sums = np.bincount(at, count, LEVELS + 1)
    return np.concatenate((np.bincount(at, minlength=LEVELS + 1), np.rint(sums).astype(np.int64)))


def _means(by_level: np.ndarray) -> np.ndarray:
    """Mean count of the n-grams read at each level; the middle where there is none."""
    n, total = by_level.reshape(2, -1)
    return np.where(n > 0, total / np.maximum(n, 1), _middle(np.arange(LEVELS + 1)))


@dataclass
class CountFilter:
    """The finished filter: counts of n-grams by repeated membership probes."""

    bits: np.ndarray
    start: np.ndarray
    data: np.ndarray

    def counts(self, keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Middle of the quantised count of each key; 0 where it was never seen."""
        return _middle(self.levels(keys, segment))

    def levels(self, keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Highest level of each key; 0 where it was never seen."""
        level = np.zeros(len(keys), np.int64)
        rows = np.arange(len(keys))
        for step in range(1, LEVELS + 1):
            element = _elements(keys[rows], step)
            for probe in range(PROBES):
                bit = (mix(element + np.uint64(probe)) % self.bits[segment[rows]]).astype(np.int64)
                at = self.start[segment[rows]] + bit
                found = (self.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
                rows, element = rows[found], element[found]
            if not len(rows):
                break
            level[rows] = step
        return level


def _asked(packed: DataFrame, groups: int) -> DataFrame:
    """Distinct n-grams of each piece for each group, with their counts in the piece's training texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("piece").to_pylist(), batch.column("data").to_pylist()):
                piece = _unpacked(data)
                tokens, doc = _sequence(words(piece.column("text"), lower=True))
                own = _training(piece.column("doc_id"))[doc]
                second, pair = _pairs(tokens, doc)
                columns: list[list[bytes]] = []
                for keys, mine, pack in (
                    (tokens, own, np.ndarray.tobytes),
                    (pair, own[second], lambda k: _pair_bytes(k, groups)),
                ):
                    keys, inverse = np.unique(keys, return_inverse=True)
                    counts = np.bincount(inverse[mine], minlength=len(keys))
                    order, bounds = _dealt(keys, groups)
                    parts = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                    columns += [[pack(keys[p]) for p in parts], [_small(counts[p]) for p in parts]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * groups, pa.int64()),
                        pa.array(range(groups), pa.int32()),
                        *[pa.array(c, pa.binary()) for c in columns],
                    ],
                    ["piece", "bucket", "words", "word_counts", "pairs", "pair_counts"],
                )

    return packed.select("piece", "data").mapInArrow(rows, _ASKED)


def _answered(asked: DataFrame) -> DataFrame:
    """Exact counts and probed levels for each question, and one row of totals (piece -1) a group."""

    def summed(keys: list[np.ndarray], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = np.concatenate([_numbers(c, len(k)) for k, c in zip(keys, counts)])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return distinct, inverse, np.rint(np.bincount(inverse, each, len(distinct))).astype(np.int64)

    def parts(values: np.ndarray, keys: list[np.ndarray]) -> list[bytes]:
        return [_small(v) for v in np.split(values, np.cumsum([len(k) for k in keys])[:-1])]

    def total(key: tuple, table: pa.Table) -> pa.Table:
        asked = {name: table.column(name).to_pylist() for name in table.column_names}
        words_ = [np.frombuffer(data, np.uint64) for data in asked["words"]]
        pairs = [_pair_keys(data) for data in asked["pairs"]]
        word, word_at, count = summed(words_, asked["word_counts"])
        pair, pair_at, pair_count = summed(pairs, asked["pair_counts"])
        every = np.concatenate((word, pair)), np.concatenate((count, pair_count))
        seen = every[1] > 0
        filled = CountFilter(*joined({0: _segment(every[0][seen], every[1][seen])}, 1))
        levels = filled.levels(every[0], np.zeros(len(every[0]), np.int64))
        rows = [
            [*asked["piece"], -1],
            [*asked["bucket"], key[0].as_py()],
            [*[0] * len(words_), int(count.sum())],
            [*[0] * len(words_), int((count > 0).sum())],
            [*parts(count[word_at], words_), b""],
            [*parts(levels[: len(word)][word_at], words_), b""],
            [*parts(levels[len(word) :][pair_at], pairs), b""],
            [
                *[None] * len(words_),
                np.concatenate((_by_level(levels[: len(word)], count), _by_level(levels[len(word) :], pair_count))),
            ],
        ]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64())]
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(rows, kinds)],
            ["piece", "bucket", "n", "v", "exact", "word_levels", "pair_levels", "by_level"],
        )

    return asked.groupBy("bucket").applyInArrow(total, _ANSWERED)


def lm_scores(docs: DataFrame) -> DataFrame:
    """Base score and model score of each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = checkpointed(_packed_pieces(docs))
    tokens = packed.agg(F.sum("tokens")).first()[0] or 0
    groups = max(LEAST_GROUPS, -(-tokens // GROUP_TOKENS))
    answers = checkpointed(_answered(_asked(packed, groups)))
    totals = answers.filter("piece = -1")
    n_train, v_train = (int(x or 0) for x in totals.agg(F.sum("n"), F.sum("v")).first())
    scale = n_train + v_train + 1
    # One row for each level, whatever the number of groups.
    by_level = np.zeros(4 * (LEVELS + 1), np.int64)
    for place, total in totals.select(F.posexplode("by_level")).groupBy("pos").agg(F.sum("col")).collect():
        by_level[place] = total
    word_mean, pair_mean = _means(by_level[: 2 * (LEVELS + 1)]), _means(by_level[2 * (LEVELS + 1) :])

    def score(question: pa.Table, answer: pa.Table) -> pa.Table:
        answer = answer.drop_columns(["by_level"]).sort_by("bucket").to_pydict()
        piece = _unpacked(question.column("data")[0].as_py())
        w = words(piece.column("text"), lower=True)
        tokens, doc = _sequence(w)
        second, pair = _pairs(tokens, doc)

        def found(keys: np.ndarray, *names: str) -> list[np.ndarray]:
            """Answers for each key, from the rows of all groups."""
            keys, inverse = np.unique(keys, return_inverse=True)
            order, bounds = _dealt(keys, groups)
            out = []
            for name in names:
                value = np.empty(len(keys), np.int64)
                value[order] = np.concatenate([_numbers(d, n) for d, n in zip(answer[name], np.diff(bounds))])
                out.append(value[inverse])
            return out

        exact, level = found(tokens, "exact", "word_levels")
        (pair_level,) = found(pair, "pair_levels")
        likely = np.minimum(1, (word_mean[level] + 1) / scale)
        first = exact[second - 1]
        known = first > 0
        after, once = second[known], first[known]
        both = np.minimum(pair_mean[pair_level[known]], once)
        likely[after] = PAIR_WEIGHT * both / once + (1 - PAIR_WEIGHT) * likely[after]
        sums = [np.bincount(doc, v, w.texts) for v in (exact > 0, np.log10(exact + 1.0), np.log10(likely))]
        n_tokens = w.counts + 1
        return pa.Table.from_arrays(
            [
                piece.column("doc_id").cast(pa.int64()),
                pa.array(n_tokens.astype(np.int64)),
                pa.array(np.rint(sums[0]).astype(np.int64)),
                pa.array(sums[1] - n_tokens * np.log10(scale)),
                pa.array(sums[2]),
            ],
            ["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )

    scored = (
        packed.select("piece", "data")
        .groupBy("piece")
        .cogroup(answers.filter("piece >= 0").groupBy("piece"))
        .applyInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    )
    n, out = HELD_OUT
    return scored.select(
        "doc_id",
        (remainder("doc_id", n) == out).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
