"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import corpus_pipeline
from fixtures import awkward_texts, docs, sentence
from test_documents import brute_components, brute_quality
from wartaframe.llm import mixing
from wartaframe.llm.queries import vocabulary_path


def test_stages_and_run_agree_with_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    rows = [r for r in awkward_texts() if r[0] is not None and r[0] != 10]
    rows += [(1000 + i, sentence(rng, 30) + (" you idiot " if i % 4 == 0 else " ") + sentence(rng, 30), "a") for i in range(40)]
    labels = [(1000 + i, 1, int(i % 4 == 0)) for i in range(30)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    stage, frames = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, stage, str(tmp_path))
        if name != "bpe":
            assert out.columns == stage.columns
        out.write.parquet(f"{tmp_path}/{name}")
        stage = frames[name] = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {name: Counter(r.doc_id for r in f.select("doc_id").collect()) for name, f in frames.items()}
    text = {i: t for i, t, _ in rows}

    assert not any(brute_quality(text[i])[-1] for i in ids["quality"])
    prose = {1000 + i for i in range(40)}
    assert prose <= set(ids["quality"])
    assert set(ids["toxicity"]) & prose == {i for i in prose if i % 4 != 0}
    left = [r for r in rows if r[0] in ids["toxicity"]]
    want = brute_components(left, 5)
    assert ids["near_dedup"] == Counter(i for i in want if want[i] == i)
    plan = Counter({r.doc_id: r.copies for r in mixing.mix_plan(frames["near_dedup"]).collect()})
    assert ids["mixing"] == +plan == ids["bpe"]

    library = Tokenizer.from_file(vocabulary_path())
    for r in frames["bpe"].collect():
        assert r.ids == library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()) == ids["bpe"]


def test_awkward_rows_and_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rng = random.Random(4)
    rows = awkward_texts() + [(None, sentence(rng, 50), None), (700, sentence(rng, 50), None), (None, None, "z")]
    rows += [(800, sentence(rng, 40), "z")] * 5
    stage = docs(spark, rows, clashing=True)
    columns = stage.columns
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, stage, str(tmp_path))
        assert name == "bpe" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{i}")
        stage = spark.read.parquet(f"{tmp_path}/{i}")
    kept = Counter(r.doc_id for r in stage.select("doc_id").collect())
    assert kept[700] > 0 and kept[None] > 0 and 0 < kept[800] <= 2

    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
