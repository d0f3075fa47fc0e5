"""The stages of the corpus pipeline on a small corpus."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tallyrook.llm.common import written  # noqa: E402
from tallyrook.llm.tokenize import coder  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ti", "on", "re", "the", "an", "er"]) for _ in range(rng.randint(1, 4)))
    clean = lambda n=70: " ".join(word() + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))
    passage = " ".join(word() for _ in range(55)) + "."
    rows = {i: clean() for i in range(60)}
    rows |= {100 + i: rows[i] for i in range(10)} | {200 + i: rows[i] + " " + word() for i in range(10, 20)}
    rows |= {300 + i: clean() + "\n" + passage + "\n" + clean(30) for i in range(2)}
    rows |= {400 + i: " ".join(word().upper() + "###" for _ in range(60)) for i in range(30)} | {500: "too short", 501: None, 502: ""}
    d = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(True))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0 if 400 <= i < 500 else 1, 0) for i in rows if i % 2 == 0 and i < 500], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows, passage


def test_stages_take_effect(spark, corpus):
    d, rows, passage = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, d), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
        at[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.where("n_chars <> length(text)").count() == 0
    assert set(at["quality rules"]) == {i for i in rows if i < 400}
    assert set(at["line dedup"]) == set(at["quality rules"])
    assert set(at["n-gram Jaccard join"]) == {i for i in rows if i < 100 or 300 <= i < 400}
    left = at["substring dedup"]
    assert [i for i in (300, 301) if passage in left[i]] == [300] and all(left[i] == rows[i] for i in range(60))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert pieces.select("doc_id").distinct().count() == len(left)
    assert corpus_pipeline.run(spark, d).count() == pieces.count()


def test_result_holds_the_texts_as_ids(spark, corpus):
    d, _, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, d), "stage")
    bpe = coder(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in sorted(corpus_pipeline.run(spark, d).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert all(ids[-1] == 0 for ids in got.values())
    assert {i: bpe.decode(np.array(ids[:-1], "<u4").tobytes()) for i, ids in got.items()} == {r.doc_id: r.text for r in docs.collect()}


def test_names_and_empty_corpus(spark, corpus, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "substring dedup", "packing"]
    spark.read.parquet(f"{corpus[0]}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
