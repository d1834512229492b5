"""Passages that earlier documents hold, against a brute-force version over all windows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from fixtures import awkward_texts, docs, sentence
from wartaframe.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=50):
    texts = [(i, WORD.findall(t or "")) for i, t, _ in rows]
    least = {}
    for i, w in texts:
        for k in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[k : k + n])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and least[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def found(frame, window=50):
    texts = sorted(
        ((r.doc_id, len(WORD.findall(r.text)), r.n_removed, " ".join(WORD.findall(r.kept_text)))
         for r in substring_dedup.without_repeats(frame, window).collect()),
        key=repr,
    )
    hashed = sorted((tuple(r) for r in substring_dedup.digests(frame, window).collect()), key=repr)
    assert hashed == sorted(((*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in texts), key=repr)
    return texts


def passages(rng, documents):
    """Documents around shared passages of 45 to 130 words, at every offset."""
    shared = [sentence(rng, n) for n in (45, 49, 50, 51, 60, 79, 80, 81, 130)]
    rows = []
    for i in range(documents):
        parts = [sentence(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), sentence(rng, rng.randint(0, 9))]
        rows.append((i * 3 + 1, rng.choice([" ", "\n", "\t\x0b "]).join(parts), "a"))
    return rows


def test_cover_meets_every_difference_once():
    differences = sorted((a - b) % 31 for a in substring_dedup.COVER for b in substring_dedup.COVER if a != b)
    assert differences == list(range(1, 31))


def test_awkward_rows(spark):
    rows = awkward_texts()
    rows += [(i, t, s) for i, t, s in rows[:12]] + [(None, "w " * 80, "a"), (2000, "w " * 80, "a"), (2001, "w " * 90, "a")]
    assert found(docs(spark, rows, clashing=True)) == brute(rows)


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_shared_passages(spark, monkeypatch, batch):
    """Also in batches so small that most is settled in the streams, some groups longer than a batch."""
    monkeypatch.setattr(substring_dedup, "BROADCAST_DOCUMENTS", 5)
    monkeypatch.setattr(substring_dedup, "BROADCAST_COPIES", 10**6 if batch == "3" else 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = random.Random(11)
    rows = passages(rng, 60)
    rows += [(500 + k, rows[5][1] + " end" * (k % 3), "b") for k in range(12)]
    short = sentence(rng, 44)
    rows += [(0, short, "a"), (600, short, "b"), (601, short + " five more words stand here", "b"), (602, short, "b")]
    rows += [(603, short + " five more words stand here and there and there", "b"), (604, short + " five more words stand here and there", "b")]
    rng.shuffle(rows)
    try:
        assert found(docs(spark, rows)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_other_window_lengths(spark):
    rows = passages(random.Random(5), 25)
    for window in (31, 64):
        assert found(docs(spark, rows), window) == brute(rows, window)
    with pytest.raises(ValueError):
        substring_dedup.without_repeats(docs(spark, rows), 30)


def test_no_rows(spark):
    assert found(docs(spark, [])) == []
