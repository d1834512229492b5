"""Unigram token counts by dynamic programming shared along a trie.

The words of a batch are walked in sorted order, which is a depth-first walk of
their trie: the best score and the number of tokens of a prefix are computed once
for all words that begin with it, and the end of a word stores its count. A text
has as many tokens as its words.

A word is a run outside 0x20 and 0x09-0x0D with the mark U+2581 in front. Its best
segmentation has the largest sum of piece scores, ties to fewer tokens; a character
no piece covers falls back to its UTF-8 bytes. A piece of rank r in the vocabulary
file scores -ln((r + 1) * ln(V)), the logarithm of its share under Zipf's law.

One pass without a shuffle; a task remembers a bounded number of words. The
vocabulary (fixed size) travels with the tasks. Null and wordless texts have no
tokens. Rows that repeat get equal counts. Extra columns are ignored.
"""

from __future__ import annotations

import math
import os.path
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wartaframe.llm.words import WORD, pieces

MARK = "▁"
REMEMBERED = 400_000


def piece_scores(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a sentencepiece file, by their rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
    scale = math.log(max(3, len(names)))
    return {name: -math.log((rank + 1) * scale) for rank, name in enumerate(names)}


class TrieCounter:
    """Token counts of words; remembers a bounded number of them."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = 2 * min(scores.values(), default=-10.0)
        self.known: dict[str, int] = {}
        self.word = re.compile(WORD)

    def learn(self, words: list[str]) -> None:
        """Counts of all words, each shared prefix once."""
        get, longest = self.scores.get, self.longest
        best, count, before = [0.0], [0], ""
        for word in sorted(words):
            marked = MARK + word
            shared = len(os.path.commonprefix((before, marked)))
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                size = len(marked[end - 1].encode())
                top, tokens = best[end - 1] + size * self.byte, count[end - 1] + size
                for begin in range(max(0, end - longest), end):
                    score = get(marked[begin:end])
                    if score is not None:
                        score += best[begin]
                        if score > top or (score == top and count[begin] < tokens - 1):
                            top, tokens = score, count[begin] + 1
                best.append(top)
                count.append(tokens)
            self.known[word] = count[-1]
            before = marked

    def counts(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """(words, tokens) of each text."""
        split = [self.word.findall(t or "") for t in texts]
        fresh = {w for words in split for w in words} - self.known.keys()
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = {w for words in split for w in words}
        self.learn(list(fresh))
        for words in split:
            yield len(words), sum(map(self.known.__getitem__, words))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of each row of ``docs`` (doc_id, text)."""
    scores = piece_scores(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter(scores)
        for batch in batches:
            for piece in pieces(batch):
                found = list(counter.counts(piece.column("text").to_pylist()))
                words, tokens = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").cast(pa.int64()), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                    ["doc_id", "n_words", "n_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_words long, n_tokens long")
