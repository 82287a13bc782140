"""What stands around retrieval when questions are answered: routing, rounds, facts, streams of parts.

Models are columns or functions that the caller gives; each has a plain rule as its default.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import REFUSAL_MARKERS
from ..sources.shared import stored
from .retrieval import PAIR_PLACES, _points, best_per_chunk, top


def intent(question: Column, several: tuple[str, ...] = ("compare", "and", "以及", "对比"), small_talk: tuple[str, ...] = ("hello", "thanks", "你好", "谢谢")) -> Column:
    """direct for small talk, multi_hop for questions about several things, else rag_qa. A null question is rag_qa."""
    has = lambda words: F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(question), w)), F.lit(False))
    return F.when(has(small_talk), "direct").when(has(several), "multi_hop").otherwise("rag_qa")


def confident(hits: DataFrame, least: float = 0.6) -> DataFrame:
    """query_id of those whose first hit is a cosine above ``least``."""
    return hits.where((F.col("rank") == 1) & (F.col("score_kind") == "cosine") & (F.col("similarity") > least)).select("query_id")


def multi_hop(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], rounds: int = 2) -> DataFrame:
    """Hits of up to ``rounds`` rounds of retrieval, each chunk once, ranked by their best score.

    After a round the queries whose first hit isn't confident are rewritten; those for which
    ``rewrite`` gives no text, or the same, stop. All queries share each round. A round's hits,
    and the questions that go on, are stored: no round is worked out again for the next one, and
    where none goes on there is no next one.
    """
    found, asked = [], queries
    for k in range(rounds):
        hits = stored(retrieve(asked).withColumn("seq", F.struct(F.lit(k).alias("round"), "rank")), "hits")
        found.append(hits)
        if k + 1 < rounds:
            again = rewrite(asked.join(confident(hits), "query_id", "left_anti")).select("query_id", F.col("text").alias("new_text"))
            asked = stored(asked.join(again, "query_id").where("new_text <> '' and new_text <> text").withColumn("text", F.col("new_text")).drop("new_text"), "asked")
            if asked.isEmpty():
                break
    return best_per_chunk(reduce(DataFrame.unionByName, found).drop("rank"))


def facts(turns: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """conv_id, turn, key, text: the first match of each slot's pattern in what users say."""
    said = turns.where("role = 'user'")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.regexp_extract("text", p, 0).alias("found")) for k, p in patterns.items()]))
    return said.select("conv_id", "turn", each.alias("f")).select("conv_id", "turn", "f.key", F.col("f.found").alias("text")).where("text <> ''")


def candidates(by_slot: DataFrame, by_vector: DataFrame) -> DataFrame:
    """fact_id, memory_id, seq: memories of a fact's slot, then the nearest, each once where it comes first."""
    both = by_slot.select("fact_id", "memory_id", F.lit(0).alias("part"), "n").unionByName(by_vector.select("fact_id", "memory_id", F.lit(1).alias("part"), "n"))
    first = top(both, ["fact_id", "memory_id"], [F.asc("part"), F.asc("n")], 1, "one")
    return top(first, "fact_id", [F.asc("part"), F.asc("n"), F.asc("memory_id")], 2**31 - 1, "seq").select("fact_id", "memory_id", "seq")


def assembled(parts: DataFrame) -> DataFrame:
    """answer_id, answer, complete: the deltas of a streamed answer in order, and whether its end came."""
    deltas = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "text")))), lambda x: x["text"])  # the parts of one answer
    return parts.groupBy("answer_id").agg(F.array_join(deltas, "").alias("answer"), F.coalesce(F.bool_or(F.col("kind") == "done"), F.lit(False)).alias("complete"))


class _Buckets:
    """Counts of texts' bigrams in hashed buckets; a bigram is hashed once in a task."""

    def __init__(self, dimensions: int):
        self.dimensions, self.known = dimensions, {}
        self.number, self.characters = np.zeros(0x110000, np.int32), 0
        self.table = np.full((128, 128), -1, np.int32)

    def _bucket(self, pair: str) -> int:
        return int(hashlib.md5(pair.encode("utf-8", "surrogatepass")).hexdigest()[:6], 16) % self.dimensions

    def counts(self, texts: list[str]) -> np.ndarray:
        """A row for each text; about a hundred thousand characters are looked at at a time, or one text."""
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // 100_000)) + 1).tolist(), len(texts)]
        return np.concatenate([self._counts(texts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])

    def _counts(self, texts: list[str]) -> np.ndarray:
        points, sizes, owner = _points(texts)
        alone = np.flatnonzero(sizes == 1)
        single = np.fromiter((self._bucket(chr(points[i])) for i in np.cumsum(sizes)[alone] - 1), np.int64, len(alone))
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        place = np.append(owner[pair] * self.dimensions + self._of_pairs(points, pair), alone * self.dimensions + single)
        return np.bincount(place, minlength=len(texts) * self.dimensions).reshape(len(texts), self.dimensions)

    def _of_pairs(self, points: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Buckets of the pairs that begin at ``pair``: from a table over the characters met so far, which is filled as they come."""
        numbers = self.number[points]
        if not numbers.all():
            new = np.unique(points[numbers == 0])
            self.number[new] = np.arange(self.characters + 1, self.characters + len(new) + 1)
            self.characters, numbers = self.characters + len(new), self.number[points]
        first, second = points[pair], points[pair + 1]
        if (self.characters + 1) ** 2 > PAIR_PLACES:  # very many characters: by the distinct pairs
            codes, at = np.unique(first.astype(np.uint64) << np.uint64(32) | second, return_inverse=True)
            for c in codes.tolist():
                if c not in self.known:
                    self.known[c] = self._bucket(chr(c >> 32) + chr(c & 0xFFFFFFFF))
            return np.fromiter((self.known[c] for c in codes.tolist()), np.int64, len(codes))[at]
        if self.characters >= len(self.table):
            wider = np.full((2 * self.characters,) * 2, -1, np.int32)
            wider[: len(self.table), : len(self.table)] = self.table
            self.table = wider
        a, b = numbers[pair], numbers[pair + 1]
        found = self.table[a, b]
        missed = np.flatnonzero(found < 0)
        if len(missed):
            for c in np.unique(first[missed].astype(np.uint64) << np.uint64(32) | second[missed]).tolist():
                self.table[self.number[c >> 32], self.number[c & 0xFFFFFFFF]] = self._bucket(chr(c >> 32) + chr(c & 0xFFFFFFFF))
            found = self.table[a, b]
        return found


def hashed_vector(text: Column, dimensions: int = 64) -> Column:
    """The default embedding of a text as an array of numbers; null for a text without bigrams.

    Bigrams are counted in hashed buckets, where a text is read; nothing is shuffled.
    """

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = _Buckets(dimensions)
        for batch in batches:
            n = buckets.counts(batch.to_pylist())
            norm = np.sqrt((n * n).sum(1))
            offsets = np.append(0, np.cumsum(np.where(norm > 0, dimensions, 0))).astype(np.int32)
            values = pa.array((n[norm > 0] / norm[norm > 0][:, None]).ravel())
            yield pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(norm == 0))

    return embed(F.coalesce(text, F.lit("")))


def hashed_vectors(texts: DataFrame, key: str, dimensions: int = 64) -> DataFrame:
    """key, vector: the default embedding (:func:`hashed_vector`) of (key, text). Other embeddings come as such a table."""
    return texts.select(key, hashed_vector(F.col("text"), dimensions).alias("vector"))


def embedded(texts: DataFrame, key: str, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """key, vector of (key, text) by a model: ``embed`` gets a batch of texts inside a task and gives a row of numbers for each."""

    @F.pandas_udf("array<double>")
    def apply(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(embed(batch.fillna("").tolist()), float)))

    return texts.select(key, apply("text").alias("vector"))


def scored(pairs: DataFrame, score: Callable[[pd.DataFrame], list[float]]) -> DataFrame:
    """``pairs`` with ``relevance`` by a model, batch by batch inside tasks; a score that isn't a number is null."""
    schema = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(relevance=pd.to_numeric(pd.Series(score(batch), index=batch.index), errors="coerce"))

    return pairs.mapInPandas(run, schema + ", relevance double").withColumn("relevance", F.nanvl("relevance", F.lit(None).cast("double")))


def last_line(prompts: list[str]) -> list[str]:
    """The plain default for a model that writes: each prompt's last line."""
    return [p.rsplit("\n", 1)[-1].strip(" ") for p in prompts]


def generated(prompts: DataFrame, key: str, generate: Callable[[list[str]], list[str | None]] = last_line) -> DataFrame:
    """key, answer, intent of (key, text): what a model writes to each prompt, batch by batch inside tasks.

    Where the model fails on a batch its prompts are tried one by one; one that fails alone, or
    gets nothing, has no answer and the intent "degraded", which isn't remembered or cached. A
    null prompt is an empty one.
    """

    def tried(texts: list[str]) -> list[str | None]:
        try:
            return list(generate(texts))
        except Exception:  # whatever a model raises is its prompts' failure, not the job's
            return [x for t in texts for x in tried([t])] if len(texts) > 1 else [None] * len(texts)

    @F.pandas_udf("string")
    def write(batch: pd.Series) -> pd.Series:
        return pd.Series(tried(batch.fillna("").tolist()), dtype=object)

    made = prompts.select(key, F.nullif(write("text"), F.lit("")).alias("answer"))
    return made.withColumn("intent", F.when(F.col("answer").isNull(), "degraded").otherwise("direct"))


def extractive_answer(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, answer: the plain default for a model's answer: the text of the first hit, or a refusal where there is none."""
    first = hits.where("rank = 1").select("query_id", "content")
    return queries.select("query_id").join(first, "query_id", "left").select("query_id", F.coalesce("content", F.lit(REFUSAL_MARKERS[0])).alias("answer"))


def chat_events(answers: DataFrame) -> DataFrame:
    """answer_id, seq, kind, text: what a client is sent for each answer.

    ``answers``: answer_id, memory, intent, deltas (array), sources, outcome. Memory comes first
    where there is any, then intent and the deltas. A finished answer ends with sources and
    done; one whose ``outcome`` is "error" or "timeout" ends with that, after what it had said.
    """
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    finished = F.coalesce(F.col("outcome"), F.lit("ok")) == "ok"
    none = F.array().cast("array<struct<kind:string,text:string>>")
    head = F.when(F.coalesce("memory", F.lit("")) != "", F.array(event("memory", F.col("memory")))).otherwise(none)
    deltas = F.transform(F.coalesce("deltas", F.array().cast("array<string>")), lambda d: event("delta", d))
    last = F.array(F.struct(F.col("outcome").alias("kind"), F.lit(None).cast("string").alias("text")))
    tail = F.when(finished, F.array(event("sources", F.col("sources")), event("done", F.lit(None).cast("string")))).otherwise(last)
    return answers.select("answer_id", F.posexplode(F.concat(head, F.array(event("intent", F.col("intent"))), deltas, tail)).alias("seq", "e")).select("answer_id", "seq", "e.kind", "e.text")


def worth_remembering(answers: DataFrame) -> DataFrame:
    """The answers that memories may be made of and that may be cached: finished ones that aren't stand-ins for a model that failed."""
    return answers.where((F.coalesce(F.col("outcome"), F.lit("ok")) == "ok") & (F.coalesce(F.col("intent"), F.lit("")) != "degraded"))


def hashed_features(docs: DataFrame, dimensions: int = 64) -> DataFrame:
    """doc_id, bucket, weight: the default embedding, sparse. Bigrams are hashed to buckets; weights have unit length."""
    each = F.explode(F.transform("vector", lambda x, i: F.struct(i.alias("bucket"), F.round(x, 6).alias("weight"))))
    return hashed_vectors(docs, "doc_id", dimensions).select("doc_id", each.alias("e")).where("e.weight > 0").select("doc_id", F.col("e.bucket").cast("long").alias("bucket"), "e.weight")
