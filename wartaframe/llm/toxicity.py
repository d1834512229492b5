"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer turns words into symbols (insult, threat, target, negation,
reporting word); a negation, a reported-speech and a target transducer are
composed into one machine that reads the symbols of a clause and writes which
pattern each insult or threat stands in: bare, aimed at someone, negated,
reported. The matched patterns of all clauses are weighed by a logistic model.

The insult lexicon (whole words and word beginnings, for languages that inflect)
and the weights are learned from at most ``TRAIN_ROWS`` labelled rows, chosen by
a hash of doc_id. Words get into the lexicon by greedy cover: each must explain
toxic documents that no earlier one explains, so words of a much copied toxic
document do not slip in. Only text is an input of a score.

Scoring is one pass over the texts without a shuffle. An Aho-Corasick automaton
finds lexicon words; clauses without any match no pattern and need no parse.

Defined results. Null and empty texts match nothing and get the score of an
unremarkable text. Very long texts are read whole, in time that grows with their
length, clause by clause. Labels that are null or have no document are ignored, several
labels of a document count as toxic if one is; a doc_id on several rows is
learned from its smallest text. Without labels the fixed seed
words and prior weights decide. Rows that repeat get equal scores. Extra columns
are ignored (``without_toxic`` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wartaframe.llm.words import pieces
from wartaframe.session import checkpointed

#: Labelled rows that lexicon and weights are fitted on, at most (expected number).
TRAIN_ROWS = 10_000
#: Lengths of word beginnings that may become lexicon entries.
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
#: Toxic documents of the sample an entry must explain on its own.
MIN_SUPPORT = 3
#: Share of the documents with an entry that must be toxic.
MIN_PRECISION = 0.8
#: The same for words that are insults at times.
WEAK_PRECISION = 0.3
CLAUSE_END = ".!?;\n"

# Closed-class words of the grammar, for English, German, French and Spanish.
SEED_INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "trash", "clown", "disgusting")
THREATS = ("kill you", "hurt you", "beat you", "burn you", "shoot you", "töten", "umbringen", "tuer", "matarte")
TARGETS = ("you", "your", "he", "she", "they", "them", "du", "dich", "ihr", "sie", "tu", "toi", "vous", "tú", "usted", "ellos")
NEGATIONS = ("not", "never", "no", "isn't", "aren't", "nicht", "kein", "keine", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "wrote", "called", "quoted", "sagte", "schrieb", "dit", "dijo", "escribió")

#: Output of the composed machine -> prior weight of the pattern.
PATTERNS = {
    "i": 4.0,  # insult
    "u": 0.5,  # word that is an insult at times
    "a": 5.0,  # insult aimed at someone
    "c": 1.0,  # someone named after the insult
    "I": 3.0,  # negated insult
    "j": 3.0,  # reported insult
    "h": 4.0,  # threat
    "b": 5.0,  # threat aimed at someone
    "H": 2.0,  # negated threat
    "g": 2.0,  # reported threat
}
PRIOR_BIAS = -3.0
SYMBOLS = "wuihtnr."


@dataclass
class Machine:
    """Deterministic letter transducer: (state, symbol) -> (state, output); other symbols pass."""

    start: object
    moves: dict = field(default_factory=dict)

    def step(self, state, symbol: str):
        return self.moves.get((state, symbol), (state, symbol))


def compose(first: Machine, second: Machine, alphabet: str = SYMBOLS) -> Machine:
    """The machine that writes what ``second`` makes of ``first``'s output."""
    start = (first.start, second.start)
    out, todo, seen = Machine(start), [start], {start}
    while todo:
        a, b = state = todo.pop()
        for symbol in alphabet:
            next_a, middle = first.step(a, symbol)
            next_b, output = second.step(b, middle)
            out.moves[state, symbol] = (next_a, next_b), output
            if (next_a, next_b) not in seen:
                seen.add((next_a, next_b))
                todo.append((next_a, next_b))
    return out


def negation() -> Machine:
    """An insult or threat at most three words after a negation is a negated one."""
    moves = {}
    for left in range(4):
        moves[left, "n"] = 3, "w"
        moves[left, "."] = 0, "."
        if left:
            moves[left, "i"], moves[left, "h"] = (0, "I"), (0, "H")
            for other in "wutr":
                moves[left, other] = left - 1, other
    return Machine(0, moves)


def reported_speech() -> Machine:
    """After a reporting word, the rest of the clause is somebody else's."""
    moves = {("own", "r"): ("other", "w"), ("other", "r"): ("other", "w"), ("other", "."): ("own", ".")}
    for symbol, output in (("i", "j"), ("I", "j"), ("h", "g"), ("H", "g")):
        moves["other", symbol] = "other", output
    return Machine("own", moves)


def target() -> Machine:
    """An insult or threat in a clause that names its target is aimed."""
    moves = {("none", "t"): ("named", "w"), ("named", "t"): ("named", "w"), ("open", "t"): ("named", "c")}
    moves |= {("named", "i"): ("named", "a"), ("named", "h"): ("named", "b")}
    moves |= {("none", "i"): ("open", "i"), ("none", "h"): ("open", "h")}
    moves |= {(s, "."): ("none", ".") for s in ("none", "named", "open")}
    return Machine("none", moves)


class Grammar:
    """Lexicon and composed machine; counts the patterns of a text."""

    def __init__(self, insults: tuple[str, ...], weak: tuple[str, ...] = ()):
        """Entries ending in "$" are whole words, others word beginnings."""
        import ahocorasick

        self.machine = compose(compose(negation(), reported_speech()), target())
        self.whole = {e[:-1] for e in insults if e.endswith("$")}
        self.stems = tuple(e for e in insults if not e.endswith("$"))
        self.weak_whole = {e[:-1] for e in weak if e.endswith("$")}
        self.weak_stems = tuple(e for e in weak if not e.endswith("$"))
        self.fixed = {w: s for s, ws in (("t", TARGETS), ("n", NEGATIONS), ("r", REPORTS)) for w in ws}
        self.finder = ahocorasick.Automaton()
        for word in {*self.whole, *self.stems, *self.weak_whole, *self.weak_stems, *THREATS}:
            self.finder.add_word(word, len(word))
        self.finder.make_automaton()
        self.threat = re.compile("|".join(rf"\b{re.escape(t)}\b" for t in THREATS))
        self.word = re.compile(r"\x00|[^\W\d_]+(?:'[^\W\d_]+)?")
        self.stop = re.compile(f"[{re.escape(CLAUSE_END)}]")

    def symbol(self, word: str) -> str:
        if word == "\0":
            return "h"
        if word in self.whole or (self.stems and word.startswith(self.stems)):
            return "i"
        if word in self.weak_whole or (self.weak_stems and word.startswith(self.weak_stems)):
            return "u"
        return self.fixed.get(word, "w")

    def clauses(self, text: str) -> set[tuple[int, int]]:
        """Bounds of the clauses that hold a lexicon entry at the beginning of a word.

        No entry holds a clause end, so each search starts at the end of the clause before
        and the text is read once, however long it is.
        """
        found = set()
        done = 0
        for end, size in self.finder.iter(text):
            begin = end - size + 1
            if end < done or (begin and text[begin - 1].isalpha()):
                continue
            left = max(text.rfind(c, done, begin) for c in CLAUSE_END) + 1
            stop = self.stop.search(text, end)
            done = stop.start() if stop else len(text)
            found.add((left, done))
        return found

    def patterns(self, text: str | None) -> list[int]:
        counts = dict.fromkeys(PATTERNS, 0)
        text = (text or "").lower()
        for left, right in self.clauses(text):
            state = self.machine.start
            clause = self.threat.sub(" \0 ", text[left:right])
            for word in self.word.findall(clause):
                state, output = self.machine.step(state, self.symbol(word))
                if output in counts:
                    counts[output] += 1
        return list(counts.values())


def strength(counts: np.ndarray) -> np.ndarray:
    """Weight of a pattern's occurrences: the first counts 1, further ones ever less, without an end."""
    return np.log2(1 + counts)


@dataclass
class Model:
    insults: tuple[str, ...]
    weak: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float


def remainder(column: Column | str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def entries(text: Column) -> Column:
    """Lexicon candidates of a text: its words, marked as whole, and their beginnings."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"))
    words = F.filter(words, lambda w: F.length(w) > 2)

    def stems(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.substring(w, 1, n))

    whole = F.transform(words, lambda w: F.concat(w, F.lit("$")))
    return F.array_distinct(F.concat(whole, *map(stems, STEM_LENGTHS)))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and weights from a bounded sample of the labelled rows of ``docs``.

    Rows whose crc32(doc_id) is divisible by 5 are held out.
    """
    labels = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .filter(remainder("doc_id", 5) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    share = max(1, -(-labels.count() // train_rows))
    labels = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(share)) == 0)
    # the sample is bounded by train_rows, so it can be copied to every executor
    sample = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
    sample = checkpointed(sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")))

    marked = sample.select("toxic", F.explode(entries(F.col("text"))).alias("entry"))
    counts = marked.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    seeds = [f"{w}$" for w in SEED_INSULTS]
    precise = F.col("toxic") >= MIN_PRECISION * F.col("n")
    hinting = F.col("toxic") >= WEAK_PRECISION * F.col("n")
    useful = checkpointed(counts.filter((hinting & (F.col("toxic") >= MIN_SUPPORT)) | F.col("entry").isin(seeds)))
    refuted = {r.entry for r in useful.filter(F.col("entry").isin(seeds) & ~precise).collect()}
    toxic_docs = sample.filter("toxic = 1").select("doc_id", F.explode(entries(F.col("text"))).alias("entry"))
    # at most train_rows toxic documents, and for each the useful entries it holds
    cover = (
        toxic_docs.join(useful.filter(hinting).select("entry", precise.alias("precise")), "entry")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("entry", "precise")).alias("entries"))
        .collect()
    )
    learned = greedy_cover([{e.entry for e in row.entries if e.precise} for row in cover])
    insults = tuple(sorted({*learned, *(s for s in seeds if s not in refuted)}))
    rest = [{e.entry for e in row.entries} for row in cover]
    weak = tuple(sorted(greedy_cover([held for held in rest if not held & {*insults}])))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(insults, weak)
        for batch in batches:
            rows = [grammar.patterns(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "x"]
            )

    rows = sample.select("toxic", "text").mapInArrow(measured, "toxic int, x array<int>")
    groups = rows.groupBy("x", "toxic").count().collect()
    weights, bias = fit(groups)
    return Model(insults, weak, weights, bias)


def greedy_cover(documents: list[set[str]]) -> list[str]:
    """Entries that each explain MIN_SUPPORT documents more than those before.

    ``documents``: the entries of each toxic document. Of equally good entries a whole
    word wins, then the longest.
    """
    holders: dict[str, set[int]] = {}
    for i, held in enumerate(documents):
        for entry in held:
            holders.setdefault(entry, set()).add(i)
    chosen, open_ = [], set(range(len(documents)))
    while open_:
        gain = {e: len(h & open_) for e, h in holders.items()}
        best = max(gain, key=lambda e: (gain[e], e.endswith("$"), len(e), e), default=None)
        if best is None or gain[best] < MIN_SUPPORT:
            break
        chosen.append(best)
        open_ -= holders.pop(best)
        holders = {e: h for e, h in holders.items() if gain[e] >= MIN_SUPPORT}
    return chosen


def fit(groups: list, rounds: int = 300, pull: float = 2.0) -> tuple[tuple[float, ...], float]:
    """Logistic weights of the patterns, pulled towards their priors (Newton steps)."""
    prior = np.array([*PATTERNS.values(), PRIOR_BIAS])
    if not groups:
        return tuple(prior[:-1]), float(prior[-1])
    x = np.array([[*strength(np.array(g["x"], float)), 1] for g in groups])
    y = np.array([g["toxic"] for g in groups], float)
    n = np.array([g["count"] for g in groups], float)
    pulls = np.full(len(prior), pull)
    pulls[-1] = 0.01
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - pulls * (w - prior)
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pulls)
        step = np.linalg.solve(bend, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w[:-1]), float(w[-1])


def scores_of(model: Model, grammar: Grammar, texts: list[str | None]) -> np.ndarray:
    x = strength(np.array([grammar.patterns(t) for t in texts], float).reshape(len(texts), len(PATTERNS)))
    return 1 / (1 + np.exp(-(x @ np.array(model.weights) + model.bias)))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.insults, model.weak)
        for batch in batches:
            for piece in pieces(batch):
                values = scores_of(model, grammar, piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(values)], ["doc_id", "score"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, with all their columns."""
    text_at = docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.insults, model.weak)
        for batch in batches:
            for piece in pieces(batch):
                values = scores_of(model, grammar, piece.column(text_at).to_pylist())
                yield piece.filter(pa.array(values < 0.5))

    return docs.mapInArrow(sift, docs.schema)
