"""Licence scan and token counts against brute-force versions."""

from __future__ import annotations

import math
import re
from functools import lru_cache

from fixtures import awkward_texts, docs
from wartaframe.llm import licenses, token_counts


def test_every_notice_is_found_and_has_a_cue(spark):
    rows, family = [], {}
    for f, lines in licenses.NOTICES.items():
        for line in lines:
            assert re.search(licenses.CUES, line), line
            family[len(rows)] = f
            rows.append((len(rows), f"some prose\n{line.upper()}\nmore prose", "a"))
    rows += [(100, None, "a"), (101, "", "a"), (None, "Released under the MIT License.", "a"), (102, "x " * 20_000, "a")]
    rows += [(103, "All rights reserved.\nLicensed under CC BY-NC 4.0.\nAll rights reserved.\nmy licence to fish", "a")] * 2
    got = licenses.scan(docs(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in family:
            unknown = family[r.doc_id] == licenses.UNKNOWN
            assert r[1:] == (("", 0, 1) if unknown else (family[r.doc_id], 1, 0))
        elif r.doc_id == 103:
            assert r[1:] == ("cc,proprietary", 3, 1)
        else:
            assert r[1:] == (("mit", 1, 0) if r.doc_id is None else ("", 0, 0))


def test_scan_is_native(spark):
    plan = licenses.scan(docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_tokens(word: str, scores: dict[str, float]) -> int:
    byte = 2 * min(scores.values())
    marked = token_counts.MARK + word

    @lru_cache(None)
    def best(end: int) -> tuple[float, int]:
        if end == 0:
            return 0.0, 0
        size = len(marked[end - 1].encode())
        options = [(best(end - 1)[0] + size * byte, -(best(end - 1)[1] + size))]
        for begin in range(end):
            if marked[begin:end] in scores:
                s, n = best(begin)
                options.append((s + scores[marked[begin:end]], -(n + 1)))
        top = max(options)
        return top[0], -top[1]

    for end in range(len(marked)):
        best(end)
    return best(len(marked))[1]


def test_counts_equal_a_plain_search(monkeypatch):
    pieces = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "abc", "c", "▁the", "e"]
    scores = {p: -math.log((r + 1) * 2.5) for r, p in enumerate(pieces)}
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    counter = token_counts.TrieCounter(scores)
    texts = ["ab abc cab", "the theb", "", None, "é日 a", "abababab ba", "ab abc cab"]
    want = [(len((t or "").split()), sum(brute_tokens(w, scores) for w in (t or "").split())) for t in texts]
    assert list(counter.counts(texts)) == want


def test_token_counts_of_awkward_rows(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.piece_scores(path)
    rows = [r for r in awkward_texts() if len(r[1] or "") < 2000]
    got = token_counts.token_counts(docs(spark, rows, clashing=True), path).collect()
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows]
    want = [(i or -1, len(ws), sum(brute_tokens(w, scores) for w in ws)) for i, ws in split]
    assert sorted((r.doc_id or -1, r.n_words, r.n_tokens) for r in got) == sorted(want)
    assert token_counts.token_counts(docs(spark, []), path).count() == 0
    assert licenses.scan(docs(spark, [])).count() == 0
