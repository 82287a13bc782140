"""Toxicity by multiple-instance learning: a document is a bag of sentences.

Only documents carry labels. A sentence's probability is logistic in its words and their
beginnings; a document's is the noisy-or of its sentences, 1 - prod(1 - p). Fitting the
documents' labels therefore teaches which sentences are at fault, and the fitted model locates
them.

The model is fitted on a bounded sample: at most ``PER_CLASS`` labelled documents of each class,
the first by a hash of their id among the rows that may be learned from and whose text isn't
empty and has at most ``LEARNED_CHARS`` characters; all of a class have at most ``CLASS_CHARS``
together. Everything else (every text, every sentence) is covered in full and scored in Arrow
batches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, remainder, table

#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 4000
#: Characters of a document that is learned from, at most: it bounds the sample's size. Longer texts are scored like all.
LEARNED_CHARS = 100_000
#: Characters of all documents of a class that is learned from, at most: what the driver holds while it fits grows with these.
CLASS_CHARS = 16_000_000
#: Words and beginnings of words have a weight if at least MIN_DOCS of the sample's documents hold
#: them, and the classes differ by more than chance: a chi-square of MIN_CHI.
MIN_DOCS, MIN_CHI = 8, 20.0
PREFIXES = range(3, 8)
#: Distinct words whose weight a Python worker remembers; beyond it the memory starts anew.
MEMORY = 500_000
THRESHOLD = 0.7
#: A sentence is located as offending from this probability on.
OFFENDING = 0.5

#: A word, or what ends a sentence.
_UNITS = re.compile(r"[^\W\d_]+|[.!?\n]")
_ENDS = (".", "!", "?", "\n")
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")

SCORED = "score double, offending array<struct<start:int, end:int, score:double>>"


def features(word: str) -> list[str]:
    """What a word is known by: itself and its beginnings, which families of words share."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if k < len(word))]


class _Weights(dict):
    """Weights by word, the sum over its features; NaN for what ends a sentence."""

    def __init__(self, weights: dict[str, float]):
        super().__init__(dict.fromkeys(_ENDS, math.nan))
        self.of = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMORY:
            self.clear()
            self.update(dict.fromkeys(_ENDS, math.nan))
        self[word] = found = sum(self.of.get(f, 0.0) for f in features(word))
        return found


_memories: dict[tuple, _Weights] = {}


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class NoisyOr:
    """A fitted model."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def sentence_scores(self, text: str, memory: _Weights) -> np.ndarray:
        units = _UNITS.findall(text.lower())
        values = np.fromiter(map(memory.__getitem__, units), float, len(units))
        ends = np.isnan(values)
        values[ends] = 0
        at = np.cumsum(ends) - ends
        full = np.bincount(at, weights=~ends) > 0
        return (np.bincount(at, weights=values) + self.bias)[full] if len(units) else np.zeros(0)

    def score(self, text: str | None, memory: _Weights) -> float:
        """Noisy-or over the sentences that hold a word; none of them: 0."""
        z = self.sentence_scores(text or "", memory)
        return float(-np.expm1(-_softplus(z).sum())) if len(z) else 0.0

    def locate(self, text: str, memory: _Weights) -> list[dict]:
        """Offsets and probabilities of the sentences at fault."""
        out = []
        for m in _SENTENCE.finditer(text):
            words = [w for w in _UNITS.findall(m[0].lower()) if w not in _ENDS]
            if words:
                p = 1 / (1 + math.exp(-min(max(self.bias + sum(map(memory.__getitem__, words)), -500), 500)))
                if p >= OFFENDING:
                    out.append({"start": m.start(), "end": m.end(), "score": p})
        return out


def fit_noisy_or(bags: list[tuple[int, int, list[list[int]]]], n_words: int, rounds: int = 400, rate: float = 0.08, l1: float = 1e-4, l2: float = 5e-5) -> tuple[float, np.ndarray]:
    """Bias and weights that fit document labels.

    ``bags``: label, number of sentences, and for each sentence that holds weighted words their
    numbers. Both classes weigh the same. Weights are shrunk, so that words that are frequent
    in both classes end at or near zero.
    """
    if not bags or n_words == 0:
        return -20.0, np.zeros(n_words)
    y = np.array([b[0] for b in bags], float)
    plain = np.array([b[1] - len(b[2]) for b in bags], float)
    doc = np.array([i for i, b in enumerate(bags) for _ in b[2]], np.int64)
    sentence = np.array([j for j, s in enumerate(s for b in bags for s in b[2]) for _ in s], np.int64)
    word = np.array([w for b in bags for s in b[2] for w in s], np.int64)
    share = np.array([0.5 / max((y == 0).sum(), 1), 0.5 / max((y == 1).sum(), 1)])[y.astype(int)]
    bias, w = -6.0, np.zeros(n_words)
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(sentence, weights=w[word], minlength=len(doc))
        clean = np.bincount(doc, weights=_softplus(z), minlength=len(y)) + plain * _softplus(np.array(bias))  # -log(1 - P)
        p = -np.expm1(-clean)
        pull = share * np.where(y == 1, np.exp(-clean) / np.maximum(p, 1e-9), -1.0)
        p_sentence, p_plain = 1 / (1 + np.exp(-np.clip(z, -500, 500))), 1 / (1 + math.exp(-bias))
        at = pull[doc] * p_sentence
        g = np.append(np.bincount(word, weights=at[sentence], minlength=n_words) - l1 * np.sign(w) - l2 * w, at.sum() + (pull * plain).sum() * p_plain)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w + step[:-1], float(np.clip(bias + step[-1], -20, 0))
    return bias, np.where(np.abs(w) < 0.05, 0.0, w)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column) -> NoisyOr:
    """Fit on ``docs`` (doc_id, text) whose ``labels`` (doc_id, toxic) satisfy ``may_learn``.

    A document with a null label is not learned from; one with several label rows counts as
    toxic if any says so, and one with several rows brings each text. Equal hashes of ids go by
    id. Without any labelled document, or any document, the model finds nothing toxic.
    """
    known = labels.where(may_learn).dropna(subset=["doc_id", "toxic"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.char_length("text").between(1, LEARNED_CHARS))
    # documents that can't be learned from take no place in the sample
    lengths = texts.groupBy("doc_id").agg(F.sum(F.char_length("text")).alias("chars"))
    usable = materialise(known.join(lengths, "doc_id"), "usable")
    first = [usable.where((F.col("toxic") > 0) == bool(c)).orderBy(*order).limit(PER_CLASS).withColumn("c", F.lit(c)) for c in (0, 1)]
    so_far = F.sum("chars").over(Window.partitionBy("c").orderBy(*order))  # over at most PER_CLASS rows
    sample = first[0].unionByName(first[1]).withColumn("so_far", so_far).where(F.col("so_far") <= CLASS_CHARS).select("doc_id", "toxic")  # at most 2 * PER_CLASS rows of two numbers
    bags = materialise(texts.join(F.broadcast(sample), "doc_id"), "labelled")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = (Counter(), Counter())
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                seen[int(toxic > 0)].update({f for w in set(_UNITS.findall(text.lower())) if w not in _ENDS for f in features(w)})
            names = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"word": names, "c0": [seen[0][w] for w in names], "c1": [seen[1][w] for w in names]})

    n = {r["toxic"]: r["n"] for r in bags.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return NoisyOr(-20.0)
    words = bags.select("toxic", "text").mapInPandas(counts, "word string, c0 long, c1 long")
    counted = words.groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).where(F.col("c0") + F.col("c1") >= MIN_DOCS)
    c0, c1 = F.col("c0") / n0, F.col("c1") / n1
    both = (F.col("c0") + F.col("c1")) / (n0 + n1)
    tested = counted.withColumn("chi", F.pow(c1 - c0, 2) / (both * (1 - both) + 1e-6) * (n0 * n1 / (n0 + n1)))
    chosen = sorted(r["word"] for r in tested.where(F.col("chi") >= MIN_CHI).select("word").collect())  # words of the sample, which is bounded
    number = {w: i for i, w in enumerate(chosen)}

    def sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                count, held, now, full = 0, [], [], False
                for unit in (*_UNITS.findall(text.lower()), "\n"):
                    if unit in _ENDS:
                        count += full
                        if now:
                            held.append(now)
                        now, full = [], False
                    else:
                        full = True
                        now += (number[f] for f in features(unit) if f in number)
                out.append((toxic, count, held))
            yield pd.DataFrame(out, columns=["toxic", "n", "sentences"])

    found = bags.select("toxic", "text").mapInPandas(sentences, "toxic int, n int, sentences array<array<int>>").collect()
    bias, weights = fit_noisy_or([(int(r["toxic"] > 0), r["n"], r["sentences"]) for r in sorted(found, key=lambda r: (r["toxic"], r["n"], r["sentences"]))], len(chosen))
    return NoisyOr(bias, {w: float(x) for w, x in zip(chosen, weights, strict=True) if x})


def scored(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """``docs`` with ``toxicity``, in place of a column of that name: the score of each whole text, and the sentences at fault.

    A null or empty text, or one without words, scores 0. Repeated rows are scored each. A text
    of any length is scored whole, in the task that reads it. An empty table gives an empty
    result.
    """

    @F.pandas_udf(SCORED)
    def apply(texts: pd.Series) -> pd.DataFrame:
        key = tuple(model.weights.items())
        if key not in _memories:
            _memories.clear()
            _memories[key] = _Weights(model.weights)
        memory = _memories[key]
        scores = [model.score(t, memory) for t in texts]
        spans = [model.locate(t, memory) if s >= OFFENDING else [] for t, s in zip(texts, scores, strict=True)]
        return pd.DataFrame({"score": scores, "offending": spans})

    return docs.withColumn("toxicity", apply(docs["text"]))


def offending_sentences(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """doc_id, start, end, score and text of every sentence at fault."""
    spans = scored(docs.select("doc_id", "text"), model).select("doc_id", "text", F.explode("toxicity.offending").alias("s"))
    return spans.select("doc_id", "s.start", "s.end", "s.score", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("sentence"))


def op1_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned where crc32(doc_id) mod 3 isn't 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return scored(docs, model).select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("toxicity.offending").alias("offending"),
    )
