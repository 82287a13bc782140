"""Texts of ten megabytes go through every operator on documents whole."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vellum.llm import boilerplate, fertility, lm_score, mixing, packing, shingle_join, token_counts, toxicity


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = ["".join(rng.choice("aeiourstn") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    lines = [" ".join(rng.choices(words, k=12)) + "." for _ in range(140_000)]
    long = "\n".join(lines)
    assert len(long) > 10_000_000
    return {1: long, 2: "\n".join([*lines[:-40], "the end."]), 3: "a short text. of two sentences", 4: None}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars int").repartition(4)


def test_counts_and_scores(docs, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs).collect()}
    assert got[1]["n_tokens"] == len(model.encode(texts[1])) and got[1]["over_limit"] and got[4]["n_tokens"] == 0
    measured = {r["doc_id"]: r for r in fertility.fertility(docs).collect()}
    assert measured[1]["n_words"] == 12 * 140_000 and measured[1]["n_repeat_words"] == 0 and not measured[1]["base_failed"]
    scores = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.scored(docs, toxicity.NoisyOr(-30.0, {"sentences": 40.0})).collect()}
    assert scores[3] > 0.99 and scores[1] < 1e-6 and scores[4] == 0


def test_language_scores(docs, texts):
    got = {r["doc_id"]: r for r in lm_score.language_scores(docs.withColumn("held_out", F.col("doc_id") == 2)).collect()}
    assert got[1]["n_tokens"] == 12 * 140_000 + 1 and got[2]["n_known"] >= got[2]["n_tokens"] - 2 and -8 * 11_000_000 < got[2]["score"] < -1_000_000


def test_links_lines_and_mixture(docs, texts):
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in shingle_join.jaccard_classes(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}
    out = {r["doc_id"]: r for r in boilerplate.without_boilerplate(docs, F.col("source"), min_pages=2, counts=True).collect()}
    assert out[1]["n_lines"] == 140_000 and out[1]["text"].count("\n") == 39 and out[2]["text"] == "the end."
    assert {r["n_tokens"] for r in mixing.realise(mixing.counted(docs)).collect()} == {12 * 140_000, 12 * 139_960 + 2, 6, 0}


def test_pieces_and_pipeline(spark, docs, texts):
    got = packing.packed_sequences(docs.where("doc_id <> 2")).where("doc_id = 1").selectExpr("sum(length) as n", "max(piece) as last").first()
    ids = len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(texts[1], add_special_tokens=False).ids) + 1
    assert got["n"] == ids and got["last"] == -(-ids // 1024) - 1
    one = docs.where("doc_id < 3")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        one = corpus_pipeline.materialise(stage(spark, one, ""), name)
    assert {r[0] for r in one.select("doc_id").collect()} <= {1, 2}
