"""Operators on documents against brute-force versions, over awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fixtures import awkward_texts, docs, sentence
from wartaframe.llm import bpe, lm_scoring, mixing, near_dedup, quality_rules, queries, toxicity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n):
    w = WORD.findall(lowered(text))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows, n, percent=80):
    nodes = [(i, shingles(t, n)) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in nodes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(nodes):
        for j, b in nodes[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, n):
    rows = awkward_texts()
    want = brute_components(rows, n)
    got = near_dedup.near_duplicates(docs(spark, clashing=True), shingle_words=n).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((i or -1, len(shingles(t, n))) for i, t, _ in rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Small limits send the group through pivots, branches and blocks."""
    for name, value in (("SMALL_NODE", 8), ("BLOCK", 4), ("FEW", 6), ("PIVOT_SAMPLE", 4)):
        monkeypatch.setattr(near_dedup, name, value)
    import random

    rng = random.Random(3)
    base = sentence(rng, 70).split(" ")
    rows = [(1000, " ".join(base), "a")]
    for i in range(60):
        w = base[:]
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "a"))
    want = brute_components(rows, 4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows), shingle_words=4).collect()}
    assert got == want


def test_one_of_each_keeps_one_row_and_all_columns(spark):
    rows = awkward_texts()
    frame = docs(spark, clashing=True)
    kept = near_dedup.one_of_each(frame)
    assert kept.columns == frame.columns
    want = brute_components(rows, 5)
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([*{i for i in want if want[i] == i}, *[None for i, _, _ in rows if i is None]])


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)]
    got = {r.rep: r.label for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(30)}}


def brute_quality(text):
    w, lines = WORD.findall(text or ""), (text or "").split("\n")
    seen, dup = set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside), failed


def test_quality_counts(spark):
    rows = awkward_texts()
    got = quality_rules.quality_rules(docs(spark, clashing=True)).collect()
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(tuple(r[k] for k in keys) for r in got) == sorted(brute_quality(t) for _, t, _ in rows)
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_keeps_prose_and_drops_junk(spark):
    import random

    rng = random.Random(1)
    prose = [(i, ". ".join(sentence(rng, 9) for _ in range(20)), "a") for i in range(20)]
    repeated = (90, ("same ten words over and over again in this text " * 9), "a")
    symbols = (91, " ".join(f"w{i}%%%" for i in range(40)), "a")
    frame = docs(spark, [*prose, repeated, symbols], clashing=True)
    kept = quality_rules.keep_clean(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == set(range(20))


def test_words_of_slices_and_pieces():
    import pyarrow as pa

    texts = [t for _, t, _ in awkward_texts()]
    for start in (0, 3):
        w = words.words(pa.array(texts)[start:], lower=True)
        split = [WORD.findall(lowered(t)) for t in texts[start:]]
        assert w.counts.tolist() == list(map(len, split))
        flat = [x for s in split for x in s]
        hashes = dict(zip(flat, w.hashes.tolist()))
        assert len(set(hashes.values())) == len(hashes)
        assert [hashes[x] for x in flat] == w.hashes.tolist()


def test_mixing_meets_its_targets(spark):
    rows = awkward_texts()
    got = mixing.mix_plan(docs(spark, clashing=True)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if target[s] + left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            for s in open_:
                target[s] += left * weight[s] / total
            break
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(target[s] - 2 * sizes[s] for s in over)
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= over
    by_size = defaultdict(list)
    for r in got:
        by_size[r.source_size, round(r.target, 6)].append(r)
        assert r.taken == r.copies * r.size <= 2 * r.size
    assert {k for k in by_size} == {(sizes[s], round(target[s], 6)) for s in names}
    alike = Counter((sizes[s], round(target[s], 6)) for s in names)
    for key, own in by_size.items():
        assert abs(sum(r.taken for r in own) - alike[key] * key[1]) <= alike[key] * max(r.size for r in own)


def test_mix_with_clashing_names(spark):
    frame = docs(spark, clashing=True)
    got = mixing.mix(frame)
    assert got.columns == frame.columns
    plan = Counter()
    for r in mixing.mix_plan(docs(spark)).collect():
        plan[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in got.collect()) == +plan


def test_mix_repeats_whole_rows(spark):
    frame = docs(spark, clashing=True)
    plan = Counter()
    for r in mixing.mix_plan(frame).collect():
        plan[r.doc_id] += r.copies
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +plan


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    library = Tokenizer.from_file(path)
    rows = awkward_texts() + [
        (900, "<|endoftext|>a <|endoftext|>", "a"),
        (901, "don't we'LL  12345 ࢏xᲉ ՘", "a"),
        (902, " " * 400 + "x\r\n\r\n", "a"),
        (903, "ab" * 300, "a"),
    ]
    frame = docs(spark, rows, clashing=True)
    got = bpe.digests(frame, path, with_ids=True).collect()

    def expected(i, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back)]
        return (i or -1, len(ids), *digest, ids)

    key = lambda x: repr(x)
    assert sorted(((r.doc_id or -1, *r[1:]) for r in got), key=key) == sorted((expected(i, t) for i, t, _ in rows), key=key)
    tokens = bpe.encode(frame, path)
    back = Counter(r.text for r in bpe.decode(tokens, path).collect())
    assert back == Counter(t or "" for _, t, _ in rows)


def test_bpe_speculation_and_long_words():
    v = bpe.Vocabulary(queries.vocabulary_path())
    data = [b" the", b" unbelievable", "日本語".encode(), b"a" * 300, b"xyzzy" * 60]
    exact = v.merged(data)
    assert exact == [v.merged_long(d) for d in data]
    found, failing = v.encode_words([d.decode() for d in data])
    assert [list(f) for f in found] == exact and failing < len(data)


def test_lm_scores_equal_counts(spark):
    rows = awkward_texts()
    got = lm_scoring.lm_scores(docs(spark, clashing=True)).collect()
    tokens = [(i, [*WORD.findall(lowered(t)), None]) for i, t, _ in rows]
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in tokens}
    counts = Counter(x for i, ws in tokens if not held[i] for x in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (repr(i), held[i], len(ws), sum(counts[x] > 0 for x in ws), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ws), 6))
        for i, ws in tokens
    )
    assert want == sorted(
        (repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got
    )
    assert all(r.score < 0 for r in got)


def test_count_filter_reads_back_quantised_counts():
    import numpy as np

    keys = words.mix(np.arange(3000, dtype=np.uint64))
    counts = np.arange(3000) % 50 + 1
    filled = lm_scoring.joined({0: lm_scoring._segment(keys, counts, 1 << 24)}, 1)
    read = lm_scoring.CountFilter(*filled).counts(keys, np.zeros(3000, np.int64))
    assert (read >= 0.75 * 2.0 ** np.floor(np.log2(counts)) - 1).all()
    assert (read <= 1.5 * counts + 1).mean() > 0.9
    missing = lm_scoring.CountFilter(*filled).counts(words.mix(np.arange(10_000, 20_000, dtype=np.uint64)), np.zeros(10_000, np.int64))
    assert (missing > 0).mean() < 0.05


def test_grammar_patterns():
    g = toxicity.Grammar(("idiot$", "lowei"))
    names = list(toxicity.PATTERNS)

    def found(text):
        return {n: c for n, c in zip(names, g.patterns(text)) if c}

    assert found("plain words. nothing here") == {}
    assert found("What an IDIOT.") == {"i": 1}
    assert found("You are an idiot! Bye.") == {"a": 1}
    assert found("That idiot is you") == {"i": 1, "c": 1}
    assert found("this is not an idiot") == {"I": 1}
    assert found("the paper called him an idiot") == {"j": 1}
    assert found("the paper said it. an idiot spoke") == {"i": 1}
    assert found("loweiig und loweitum") == {"i": 2}
    assert found("I will kill you") == {"h": 1}
    assert found("they say I will kill you") == {"b": 1}
    assert found("idiotic or preidiot") == {}
    assert found(None) == {} and found("") == {}


def test_clauses_equal_a_plain_cut():
    g = toxicity.Grammar(("idiot$", "lowei"))
    rng = random.Random(3)
    parts = ["idiot", "loweish", "you", "are", "not", "xidiot", ". ", "! ", "?", "; ", "\n", " ", ", "]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        begins = [m.start() for w in ("idiot", "lowei") for m in re.finditer(rf"(?<![a-z]){w}", text)]
        cuts = [-1, *(i for i, c in enumerate(text) if c in toxicity.CLAUSE_END), len(text)]
        want = {(max(c for c in cuts if c < b) + 1, min(c for c in cuts if c > b)) for b in begins}
        assert g.clauses(text) == want


def test_very_long_texts_take_linear_time_and_every_insult_counts():
    g = toxicity.Grammar(("idiot$",))
    begun = time.monotonic()
    counts = dict(zip(toxicity.PATTERNS, g.patterns("an idiot; x " * 100_000)))
    assert counts["i"] == 100_000 and sum(counts.values()) == 100_000
    assert time.monotonic() - begun < 20
    assert toxicity.strength(np.array([0, 1, 3, 100_000])).tolist()[:3] == [0, 1, 2]


def test_toxicity_learns_from_labels(spark):
    import random

    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        w = sentence(rng, 40).split(" ")
        if toxic:
            w[rng.randrange(40)] = "gromp" + rng.choice(["en", "ig", "tum", "a"])
        rows.append((i, " ".join(w), "a"))
        labels.append((i, 1 if i % 2 else 0, 1 if toxic else 0))
    rows += [(None, "grompen", "a"), (1000, None, "a"), (1001, "", "a"), (0, rows[0][1], "a")]
    labels += [(9999, 0, 1), (1, None, None), (None, 1, 1), (8, 0, 0)]
    frame = docs(spark, rows, clashing=True)
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.toxicity(frame, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 1000:
            assert r.predicted == (r.doc_id % 8 == 0)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        elif r.doc_id is not None:
            assert 0 < r.score < 0.5
    clean = toxicity.without_toxic(frame, model)
    assert clean.columns == frame.columns
    assert clean.count() == sum(1 - r.predicted for r in got)


def test_empty_tables(spark):
    none = docs(spark, [], clashing=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.one_of_each(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0
    assert bpe.digests(none, queries.vocabulary_path()).count() == 0
    assert lm_scoring.lm_scores(none).count() == 0
    assert toxicity.toxicity(none, toxicity.train(none, labels)).count() == 0
