"""Small tables with every awkward kind of row."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASHING = (
    "size", "rep", "node", "label", "rank", "score", "copies", "kept", "word", "n", "id", "_key", "_text", "_row", "_copies", "_copy", "key", "row",
    "toxic", "x", "target",
)


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdeäñ") for _ in range(rng.randint(1, 7))) for _ in range(words))


def awkward_texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): near and exact copies, nulls, empties, a long text, junk."""
    rng = random.Random(7)
    rows: list[tuple[int | None, str | None, str | None]] = []
    base = [sentence(rng, n) for n in (3, 12, 40, 60, 90, 200)]
    for i, text in enumerate(base):
        words = text.split(" ")
        rows.append((100 + i, text, "a"))
        rows.append((200 + i, text.upper(), "b"))
        if len(words) > 20:
            near = words[:]
            near[len(near) // 2] = "changed"
            rows.append((300 + i, " ".join(near), "c"))
            rows.append((50 + i, " ".join([*near, "tail"]), "a"))
            rows.append((400 + i, " ".join(words[: len(words) // 2]), None))
    rows += [(1, None, "a"), (2, "", "b"), (3, " \n\t ", None), (None, base[3], "a"), (None, None, None)]
    rows += [(5, "one\nline again\nline again\nline again\n" * 3, "b"), (6, "#*$ %&| <> x " * 9, "c")]
    rows += [(7, sentence(rng, 9000), "d"), (8, "word " * 700, "d"), (9, "a" * 5000, "d")]
    rows += [(10, "tie tie tie", "a"), (10, "tie tie tie", "a"), (11, " nbsp\x0bvt 日本語 😀 é", "e")]
    return rows


def docs(spark, rows=None, clashing: bool = False):
    rows = awkward_texts() if rows is None else rows
    data = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(data, DOCS)
    if clashing:
        for name in CLASHING:
            df = df.selectExpr("*", f"'extra' AS {name}")
    return df
