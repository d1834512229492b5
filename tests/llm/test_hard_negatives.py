"""Hard negatives against all pairs."""

from __future__ import annotations

import math
import random

import pytest

from wartaframe.llm import hard_negatives as mining

VECTORS = "vec_id long, embedding array<double>, label int"


def brute(rows):
    able = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            able.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for k, (i, v, label) in enumerate(able):
        if i % 50:
            continue
        met = [(-sum(x * y for x, y in zip(v, w)), j, other) for m, (j, w, other) in enumerate(able) if m != k]
        for p, j, _ in sorted(x for x in met if x[2] == label)[:5]:
            hits = sorted(x for x in met if x[2] != label and -50 * p <= -100 * x[0] <= -95 * p)[:3]
            out += [(i, j, n + 1, m, -p, -s) for n, (s, m, _) in enumerate(hits)]
    return sorted(out)


def found(frame):
    rows = mining.hard_negatives(frame, mining.standard_anchors(), mining.shifted_label())
    return sorted(tuple(r) for r in rows.collect())


def vectors(n, size, labels=10, around=0.3):
    rng = random.Random(size)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 0, rng.randrange(labels)])
        rows.append((i, [c * around + rng.gauss(0, 0.3) for c in centres[rng.choice([label, rng.randrange(labels)])]], label))
    return rows


@pytest.mark.parametrize(("shard", "block"), [(8192, 8192), (37, 3)])
def test_all_pairs(spark, monkeypatch, shard, block):
    monkeypatch.setattr(mining, "SHARD_ROWS", shard)
    monkeypatch.setattr(mining, "ANCHOR_BLOCK", block)
    rows = vectors(420, 24)
    rows += [(1000 + k, rows[4][1], k % 10) for k in range(30)]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS id", "'x' AS row", "'x' AS v", "'x' AS rank", "'x' AS shard")
    want = brute(rows)
    assert len(want) > 20 and found(frame) == want


def test_awkward_rows(spark):
    rows = vectors(120, 5)
    rows += [(None, rows[1][1], 1), (2000, None, 1), (2050, [], 1), (2100, [0.0] * 5, 1), (2150, [1.0, 2.0], 3)]
    rows += [(2200, [float("nan")] * 5, 1), (2250, [None] * 5, 1), (2300, [float("inf")] * 5, 1), (2350, [1.0] * 5, None)]
    rows += [(2400, [9e4, -9e4, 3.0, 0.0, 1.0], 2), (2401, [9e4, -8e4, 3.0, 0.0, 1.0], 2), (2402, [7e4, -8e4, 3.0, 0.0, 1.0], 5)]
    rows += [rows[50], rows[50], (0, rows[3][1], 4), (2450, [0.5] * 9, 7), (2451, [0.4] * 9, 7), (2452, [0.3] * 8, 1)]
    assert found(spark.createDataFrame(rows, VECTORS)) == brute(rows)


def test_bounds_leave_few_candidates(spark):
    """Vectors with few large dimensions are settled before all are read."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (2000, 64))
    x[:, :4] = rng.integers(-300, 300, (2000, 4))
    table = pa.table({"row": range(2000), "id": range(2000), "label": [0] * 2000, "v": pa.array(x.tolist())})
    shard = mining.Columns(table, 64)
    seen = []

    def wanted(low, high):
        seen.append(len(low))
        return high >= mining._nth(low, 5)

    place, score = shard.scan(x[7], np.arange(2000), wanted)
    assert seen[1] < 100
    best = np.argsort(-(x @ x[7]), kind="stable")[:5]
    assert set(best) <= set(place) and set((x @ x[7])[best]) <= set(score)


def test_few_or_no_vectors(spark):
    assert found(spark.createDataFrame([], VECTORS)) == []
    assert found(spark.createDataFrame([(0, [1.0], 1)], VECTORS)) == []
    assert found(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1)], VECTORS)) == []
