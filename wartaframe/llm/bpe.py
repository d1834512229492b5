"""Byte-pair encoding by speculation and verification, and decoding.

A pre-token is cut greedily into the longest tokens of the vocabulary. That is a
guess at the merge result; it is the merge result exactly when every token merges
to itself and no merge crosses the border of two neighbours. The border test is
vectorised over all neighbouring pairs of a batch; only pre-tokens with a failing
pair go through exact merging.

Border test. While a token is merged up from its bytes, the piece at its right
edge climbs its right spine, the piece at its left edge its left spine; a piece
lives until the merge that makes its parent. A merge of rank m would cross the
border if it joins a piece of the left token's right spine with one of the right
token's left spine while both live. Of equal ranks the leftmost merge goes first.

The vocabulary file is a parameter; it is read on the driver and its tables
(a few MB, fixed by the vocabulary) travel with the tasks. Encoding is one pass
without a shuffle; each task keeps a bounded dictionary of the pre-tokens it met.

Defined results. A null text is an empty one: no tokens, decoded to "". Strings
of added tokens inside a text become their ids. Rows that repeat get equal
results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wartaframe.llm.words import pieces

#: Pre-tokens a task remembers; when there are more it starts afresh.
REMEMBERED = 400_000
#: Bytes up to which words are merged side by side.
SIDE_BY_SIDE = 96
_NEVER = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in the vocabulary file.

    Printable Latin-1 bytes stand for themselves, the others follow from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_pattern(tokenizer) -> tuple[str, str, str]:
    """Pattern of pre-tokens; the same for text with young characters; what finds those.

    Letters and numbers are those of the tokenizer's Unicode version, which may be
    older than that of the regex module: characters on which the databases differ
    are classified by the tokenizer.
    """
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    wrong = []
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c) == "Cn" and (letter.match(c) or number.match(c)):
            before = "a" if letter.match(c) else "1"
            if len(tokenizer.pre_tokenizer.pre_tokenize_str(before + c)) > 1:
                wrong.append(point)
    parts = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|\s+(?!\S)|\s+"
    plain = parts.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{O}", r"[^\s\p{L}\p{N}]")
    if not wrong:
        return plain, plain, r"(?!)"
    runs, begin = [], wrong[0]
    for a, b in zip(wrong, [*wrong[1:], -1]):
        if b != a + 1:
            runs.append(f"\\U{begin:08x}-\\U{a:08x}")
            begin = b
    young = "[" + "".join(runs) + "]"
    exact = (
        parts.replace("{L}", rf"(?:(?!{young})\p{{L}})")
        .replace("{N}", rf"(?:(?!{young})\p{{N}})")
        .replace("{O}", rf"(?:{young}|[^\s\p{{L}}\p{{N}}])")
    )
    return plain, exact, f"[\\U{wrong[0]:08x}-\\U0010ffff]"


class Vocabulary:
    """Tables of a byte-level BPE vocabulary file, made once on the driver."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.added.values()])
        self.token = [b""] * self.size
        for text, i in ids.items():
            self.token[i] = bytes(letters[c] for c in text)
        for text, i in self.added.items():
            self.token[i] = text.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.byte_id = [0] * 256
        for text, i in ids.items():
            if len(text) == 1:
                self.byte_id[letters[text]] = i
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.merges = {(int(a), int(b)): (r, int(m)) for r, (a, b, m) in enumerate(zip(left, right, made))}
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order.astype(np.int32)
        parts = np.full((self.size, 2), -1, np.int32)
        rank = np.full(self.size, _NEVER, np.int32)
        for r in range(len(pairs) - 1, -1, -1):
            parts[made[r]], rank[made[r]] = (left[r], right[r]), r
        self.right_spine = self._spine(parts[:, 1], rank)
        self.left_spine = self._spine(parts[:, 0], rank)
        self.made, self.byte_ids = made.astype(np.int32), np.array(self.byte_id, np.int32)
        listed = list(ids.values())
        reached = self.merged([self.token[i] for i in listed])
        self.bytes_to_id = {self.token[i]: i for i, got in zip(listed, reached) if got == [i]}
        self.longest = max(map(len, self.bytes_to_id))
        self.patterns = split_pattern(Tokenizer.from_file(path))

    def _spine(self, child: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Levels of a spine: piece of each token (-1: none), and the rank that ends it."""
        piece, until = np.arange(self.size, dtype=np.int32), np.full(self.size, _NEVER, np.int32)
        levels = []
        while (piece >= 0).any():
            levels.append((piece, until))
            until = np.where(piece >= 0, rank[piece], _NEVER).astype(np.int32)
            piece = np.where(piece >= 0, child[piece], -1).astype(np.int32)
        return levels

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of tokens; _NEVER where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.key_rank[at], _NEVER)

    def merged(self, data: list[bytes]) -> list[list[int]]:
        """Exact merging: always the pair of lowest rank, the leftmost of equals first.

        Words of like length are merged side by side, one merge of each per step.
        """
        out: list[list[int]] = [[]] * len(data)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        short = order[sizes[order] <= SIDE_BY_SIDE]
        for i in order[sizes[order] > SIDE_BY_SIDE]:
            out[i] = self.merged_long(data[i])
        at = 0
        while at < len(short):
            width = max(8, int(sizes[short[at]]) * 3 // 2)
            stop = min(at + (1 << 15), at + int(np.searchsorted(sizes[short[at:]], width, side="right")))
            group = short[at:stop]
            self._merge_matrix(data, group, int(sizes[group[-1]]), out)
            at = stop
        return out

    def _merge_matrix(self, data: list[bytes], group: np.ndarray, width: int, out: list[list[int]]) -> None:
        flat = np.frombuffer(b"".join(data[i].ljust(width, b"\0") for i in group), np.uint8)
        ids = self.byte_ids[flat].reshape(len(group), width)
        sizes = np.fromiter((len(data[i]) for i in group), np.int64, len(group))
        ids[np.arange(width) >= sizes[:, None]] = -1
        ranks = np.full((len(group), width), _NEVER, np.int32)
        ranks[:, :-1] = self.ranks_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(group), -1)
        rows = np.arange(len(group))
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == _NEVER
            for k in np.flatnonzero(done):
                row = ids[k]
                out[group[rows[k]]] = row[row >= 0].tolist()
            rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
            if not len(rows):
                break
            every = np.arange(len(rows))
            places = np.arange(ids.shape[1] - 1)
            shifted = places + (places > at[:, None])
            ids[every, at] = self.made[best]
            ids = np.take_along_axis(ids, shifted, axis=1)
            kept = places + (places >= at[:, None])
            ranks = np.take_along_axis(ranks, kept, axis=1)
            last = ids.shape[1] - 1
            following = np.where(at < last, ids[every, np.minimum(at + 1, last)], -1)
            ranks[every, at] = self.ranks_of(ids[every, at], following)
            inner = np.flatnonzero(at > 0)
            before = at[inner] - 1
            ranks[inner, before] = self.ranks_of(ids[inner, before], ids[inner, at[inner]])

    def merged_long(self, data: bytes) -> list[int]:
        """The same for one long word, with a heap of pairs: n log n steps."""
        ids = [self.byte_id[b] for b in data]
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        heap = [(m[0], i) for i, pair in enumerate(zip(ids, ids[1:])) if (m := self.merges.get(pair))]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            found = self.merges.get((ids[i], ids[j])) if j >= 0 else None
            if found is None or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := self.merges.get((ids[a], ids[b]))):
                    heappush(heap, (m[0], a))
        return [i for i in ids if i >= 0]

    def greedy(self, data: bytes) -> list[int]:
        """Longest token at each place."""
        out, at, n = [], 0, len(data)
        lookup, longest = self.bytes_to_id, self.longest
        while at < n:
            end = min(n, at + longest)
            while (token := lookup.get(data[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def crossed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether a merge crosses the border of each pair of neighbouring tokens."""
        out = np.zeros(len(left), bool)
        for piece, until in self.right_spine:
            rows = np.flatnonzero((piece[left] >= 0) & ~out)
            for other, other_until in self.left_spine:
                rows = rows[other[right[rows]] >= 0]
                if not len(rows):
                    break
                a, b = piece[left[rows]].astype(np.int64), other[right[rows]]
                key = a * self.size + b
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = self.key_rank[at]
                hit = (self.keys[at] == key) & (rank < until[left[rows]]) & (rank <= other_until[right[rows]])
                out[rows[hit]] = True
                rows = rows[~hit]
        return out

    def encode_words(self, words: list[str]) -> tuple[list[tuple[int, ...]], int]:
        """Token ids of each pre-token, and how many needed exact merging."""
        data = [w.encode() for w in words]
        guesses = [self.greedy(d) for d in data]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(guesses)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        failing = np.unique(owner[inner[self.crossed(flat[inner], flat[inner + 1])]])
        for i, exact in zip(failing, self.merged([data[i] for i in failing])):
            guesses[i] = exact
        return [tuple(g) for g in guesses], len(failing)


class Encoder:
    """Encodes texts with one vocabulary; remembers a bounded number of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[int, ...]] = {t: (i,) for t, i in vocabulary.added.items()}
        plain, exact, young = vocabulary.patterns
        self.plain, self.exact, self.young = map(regex.compile, (plain, exact, young))
        added = "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True)))
        self.added = regex.compile(f"({added})") if added else None

    def split(self, text: str) -> list[str]:
        special = self.added is not None and any(t in text for t in self.vocabulary.added)
        parts = self.added.split(text) if special else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            else:
                rare = not part.isascii() and self.young.search(part)
                out.extend((self.exact if rare else self.plain).findall(part))
        return out

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        split = [self.split(t or "") for t in texts]
        fresh = list(set(chain.from_iterable(split)) - self.known.keys())
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {t: (i,) for t, i in self.vocabulary.added.items()}
            fresh = list(set(chain.from_iterable(split)) - self.known.keys())
        if fresh:
            self.known.update(zip(fresh, self.vocabulary.encode_words(fresh)[0]))
        known = self.known
        for words in split:
            yield list(chain.from_iterable(map(known.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        token = self.vocabulary.token
        return b"".join(map(token.__getitem__, ids)).decode(errors="replace")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Adds ``ids``: the tokens of each whole text of ``docs``."""
    vocabulary = Vocabulary(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for piece in pieces(batch):
                ids = list(encoder.encode(piece.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                    ["doc_id", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row of (doc_id, ids)."""
    vocabulary = Vocabulary(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            text = [encoder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Number of tokens, digest of the ids and digest of the decoded text, per row.

    ``with_ids`` adds the ids themselves.
    """
    vocabulary = Vocabulary(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        numbers = [str(i) for i in range(vocabulary.size)]
        for batch in batches:
            for piece in pieces(batch):
                counts, id_digests, text_digests, all_ids = [], [], [], []
                for ids in encoder.encode(piece.column("text").to_pylist()):
                    counts.append(len(ids))
                    if with_ids:
                        all_ids.append(ids)
                    listed = ",".join(map(numbers.__getitem__, ids))
                    id_digests.append(hashlib.sha256(listed.encode()).hexdigest())
                    text_digests.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                columns = {
                    "doc_id": piece.column("doc_id").cast(pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array(id_digests, pa.string()),
                    "decoded_sha256": pa.array(text_digests, pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(rows, schema)
