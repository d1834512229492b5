"""Large nodes of the similarity join, on every path."""

from __future__ import annotations

import random

from fixtures import docs, sentence
from wartaframe.llm import near_dedup


def test_large_nodes_of_every_path_are_followed(spark, monkeypatch):
    """All nodes are large and the first round has no pivots: the second one finds every link."""
    monkeypatch.setattr(near_dedup, "SMALL_NODE", 1)
    monkeypatch.setattr(near_dedup, "LARGE_PATHS", 0)
    rng = random.Random(3)
    rows = []
    for group in range(6):
        base = sentence(rng, 120).split(" ")
        for i in range(5):
            near = base[:]
            near[20 * i] = f"changed{i}"
            rows.append((10 * group + i, " ".join(near), "a"))
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 10 * 10 for i, *_ in rows}
