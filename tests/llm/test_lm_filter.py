"""Model scores of op10 against plain n-gram counts."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

from fixtures import docs
from wartaframe.llm import lm_scoring


def plain_scores(rows) -> dict[int, float]:
    """Scores from dictionaries of all training words and pairs, with exact counts."""
    tokens = {i: [*text.split(), None] for i, text, _ in rows}
    train = [ws for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for ws in train for w in ws)
    two = Counter(p for ws in train for p in zip(ws, ws[1:]))
    scale = sum(one.values()) + len(one) + 1
    out = {}
    for i, ws in tokens.items():
        out[i] = 0.0
        for v, w in zip([None, *ws], ws):
            p = (one[w] + 1) / scale
            if v is not None and one[v]:
                p = lm_scoring.PAIR_WEIGHT * two[v, w] / one[v] + (1 - lm_scoring.PAIR_WEIGHT) * p
            out[i] += math.log10(p)
    return out


def corpus(n: int = 300):
    """Skewed words, and in every third text a phrase of words that stand nowhere else."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        ws = [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(200)]
        if i % 3 == 0:
            ws[50:50] = f"rare{i // 30} phrase{i // 30} here{i // 30}".split()
        rows.append((i, " ".join(ws), "a"))
    return rows


def test_scores_stay_near_exact_counts_with_many_groups(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "GROUP_TOKENS", 500)
    rows = corpus()
    want = plain_scores(rows)
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(docs(spark, rows)).collect()}
    assert got.keys() == want.keys()
    off = sum(abs(got[i] - want[i]) for i in want) / sum(abs(x) for x in want.values())
    assert off < 0.005


def test_probabilities_after_a_word_add_up(spark):
    """Read from scores alone: all words and the end, alone and after a frequent, a middling and a rare word."""
    train = [(i, t, s) for i, t, s in corpus() if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for _, t, _ in train for w in t.split()).most_common()
    before = [counts[0][0], counts[20][0], counts[-1][0]]
    held = iter(i for i in range(10_000, 10**6) if zlib.crc32(str(i).encode()) % 7 == 2)
    # An unknown word z after w has PAIR_WEIGHT less than alone; the end after z is the end alone.
    asked = {next(held): x for x in ("", "z", *(f"{w} z" for w, _ in counts), *(f"{v} {w} z" for v in before for w, _ in counts), *before)}
    rows = train + [(i, x, "a") for i, x in asked.items()]
    got = {asked[r.doc_id]: r.score for r in lm_scoring.lm_scores(docs(spark, rows)).collect() if r.doc_id in asked}
    z = got["z"] - got[""]
    rest = z + math.log10(1 - lm_scoring.PAIR_WEIGHT) + got[""]
    alone = sum(10 ** (got[f"{w} z"] - rest) for w, _ in counts) + 10 ** got[""] + 10**z
    assert abs(alone - 1) < 0.01
    for v in before:
        after = sum(10 ** (got[f"{v} {w} z"] - got[f"{v} z"]) for w, _ in counts)
        end = 10 ** (got[v] - (got[f"{v} z"] - rest))
        assert abs(after + end + 10 ** (z + math.log10(1 - lm_scoring.PAIR_WEIGHT)) - 1) < 0.01, v


def test_pairs_of_rare_words_count_and_held_out_texts_do_not(spark):
    """A phrase of words below any share of the corpus, in training texts and in a held-out one."""
    train = [i for i in range(600) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(600) if i not in train]
    rng = random.Random(13)
    rows = {i: " ".join(f"w{rng.randrange(400)}" for _ in range(100)) for i in train[:300] + held[:60]}
    for i in train[:3]:
        rows[i] += " rarest phrase of all"
    rows[held[0]], rows[held[1]] = "rarest phrase of all", "all of phrase rarest"
    for i in held[2:60]:
        rows[i] += " only held out" * 20
    rows = [(i, text, "a") for i, text in rows.items()]
    want = plain_scores(rows)
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(docs(spark, rows).repartition(3)).collect()}
    assert got[held[0]] > got[held[1]] + 3
    assert all(abs(got[i] - want[i]) < 0.03 * abs(want[i]) for i in want)
