"""Resampling weights, draws and ranks against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from fixtures import awkward_texts, docs, sentence
from wartaframe.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return len(w), Counter(zlib.crc32(r.encode()) % 10000 for r in runs)


def brute(rows, target):
    sets = [(i, *features(t)) for i, t, _ in rows]
    corpus, wanted = Counter(), Counter()
    for _, _, c in sets:
        corpus.update(c)
    for t in target:
        wanted.update(features(t)[1])
    s, t = sum(corpus.values()) + 10000, sum(wanted.values()) + 10000
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * s / ((corpus[b] + 1) * t))) for b in corpus}
    scored = []
    for i, n, c in sets:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(k * gain[b] for b, k in c.items())
        scored.append((i, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = Counter()
    out = []
    for place, r in enumerate(able[: 5 * len(able) // 100]):
        out.append((*r, place + 1))
        drawn[r] += 1
    for r in scored:
        if drawn[r]:
            drawn[r] -= 1
        else:
            out.append((*r, None))
    return sorted(out, key=repr)


def found(spark, frame, target):
    wanted = spark.createDataFrame([(str(k), t) for k, t in enumerate(target)], "item_id string, text string")
    return sorted((tuple(r) for r in importance.resampling(frame, wanted).collect()), key=repr)


def test_awkward_rows(spark):
    rows = awkward_texts() * 3 + [(900, "x" * 70000 + " y" * 30, "a"), (901, "ÀÉ Àé 1-2_3 " * 30, "a")]
    target = ["alpha beta", None, "", rows[4][1], sentence(random.Random(1), 50)]
    assert found(spark, docs(spark, rows, clashing=True), target) == brute(rows, target)


def test_many_documents(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.choice([5, 19, 20, 60])), "a") for i in range(700)]
    rows += [(None, rows[3][1], "a")] * 25 + [(5000, rows[9][1], "b")] * 40
    target = [t for _, t, _ in rows[:20]]
    assert found(spark, docs(spark, rows), target) == brute(rows, target)


def test_no_target_and_no_rows(spark):
    rows = awkward_texts()
    assert found(spark, docs(spark, rows), []) == brute(rows, [])
    assert found(spark, docs(spark, []), ["a b c"]) == []


def test_planes_give_the_plain_sum():
    rng = np.random.default_rng(2)
    row, bucket = np.sort(rng.integers(0, 600, 30000)), rng.integers(0, importance.BUCKETS, 30000)
    bucket[:9000] %= 7
    gain = rng.integers(-9000, 9000, importance.BUCKETS)
    want = np.bincount(row, gain[bucket], minlength=601).astype(np.int64)
    got = importance.bit_sliced_weights(row, bucket, 601, importance.gain_planes(gain))
    assert (got == want).all()
