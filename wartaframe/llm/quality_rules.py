"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the words of a text that stand in
an n-gram found before or again in the same text; the rules look at the share of
the text's characters those words cover, and at the share of characters in
repeated lines. Everything is counted per text inside one Arrow batch: no
shuffle, and no loop over texts or words in Python.

Null or wordless texts have zero counts and are rejected (fewer than MIN_WORDS
words). Repeated rows each get their own, equal verdict. Extra columns are left
alone by ``keep_clean`` and ignored by ``quality_rules``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wartaframe.llm.words import Words, mix, pieces, words

MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: n-gram length -> largest share of word characters that repeated n-grams may cover.
COVERAGE_LIMITS = {6: 0.20, 8: 0.18, 10: 0.15}
#: Largest share of word characters in lines that equal an earlier line.
LINE_LIMIT = 0.30
#: Symbols per word from which a text counts as symbol junk.
SYMBOL_LIMIT = 0.10
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,
n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, """ + ", ".join(
    f"dup{n}_chars long" for n in COVERAGE_LIMITS
)


def repeated_windows(w: Words, at: np.ndarray, n: int) -> np.ndarray:
    """Those of the n-word windows beginning at ``at`` that their text holds twice or more."""
    key = mix(w.window_hash(at, n) + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return at[:0]
    found = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return at[twice[found] == key]


def covered_words(w: Words, at: np.ndarray, n: int) -> np.ndarray:
    """Words inside the n-word windows that begin at ``at``."""
    step = np.bincount(at, minlength=len(w.doc) + 1) - np.bincount(at + n, minlength=len(w.doc) + 1)
    return np.flatnonzero(np.cumsum(step[:-1]) > 0)


def characters(w: Words) -> np.ndarray:
    """Code points of each word."""
    heads = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
    return heads[w.ends] - heads[w.starts]


def repeated_lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of the text: (row, start, end)."""
    breaks = np.flatnonzero(w.data == 10)
    starts = np.concatenate((w.offsets[:-1], breaks + 1))
    row = np.concatenate((np.arange(w.texts), np.searchsorted(w.offsets, breaks, side="right") - 1))
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = w.offsets[row + 1].copy()
    inner = row[:-1] == row[1:]
    ends[:-1][inner] = starts[1:][inner] - 1
    filled = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, row = starts[filled], ends[filled], row[filled]
    value = w.span_hash(starts, ends)
    order = np.lexsort((starts, value, row))
    again = np.zeros(len(row), bool)
    again[order[1:]] = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
    return row[again], starts[again], ends[again]


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of an array, and its verdict."""
    w = words(texts)
    size = characters(w)
    everything = np.arange(len(w.doc))
    out = {"n_words": w.counts.astype(np.int64), "word_chars": w.per_text(everything, size)}
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[w.data])))
    out["n_symbols"] = symbols[w.offsets[1:]] - symbols[w.offsets[:-1]]
    row, starts, ends = repeated_lines(w)
    out["n_dup_lines"] = np.bincount(row, minlength=w.texts)
    total = np.concatenate(([0], np.cumsum(size)))
    in_lines = total[np.searchsorted(w.starts, ends)] - total[np.searchsorted(w.starts, starts)]
    out["dup_line_chars"] = np.bincount(row, in_lines, minlength=w.texts).astype(np.int64)
    at = repeated_windows(w, w.windows(REPEAT_WINDOW), REPEAT_WINDOW)
    out["n_repeat_words"] = w.per_text(covered_words(w, at, REPEAT_WINDOW))
    good = out["n_symbols"] <= SYMBOL_LIMIT * out["n_words"]
    good &= out["dup_line_chars"] <= LINE_LIMIT * out["word_chars"]
    for n, limit in COVERAGE_LIMITS.items():
        # a longer repeated run begins where a shorter one does
        at = at[at + n <= len(w.doc)]
        at = repeated_windows(w, at[w.doc[at] == w.doc[at + n - 1]], n)
        inside = covered_words(w, at, n)
        out[f"dup{n}_chars"] = w.per_text(inside, size[inside])
        good &= out[f"dup{n}_chars"] <= limit * out["word_chars"]
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (
        100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"]
    )
    out["kept"] = ~out["base_failed"] & good
    return out


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict per row of ``docs`` (doc_id, text)."""
    names = [part.split()[0] for part in SCHEMA.replace("\n", " ").split(",")][1:]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                out = measure(piece.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").cast(pa.int64())] + [pa.array(out[n]) for n in names],
                    ["doc_id", *names],
                )

    return docs.select("doc_id", "text").mapInArrow(score, SCHEMA)


def keep_clean(docs: DataFrame) -> DataFrame:
    """Rows whose text passes, with all their columns and no shuffle."""
    columns = docs.schema
    text_at = docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                kept = measure(piece.column(text_at))["kept"]
                yield piece.filter(pa.array(kept))

    return docs.mapInArrow(sift, columns)
