"""A stored inverted index: built once, added to, and read by token with blocks that can't matter passed over.

Documents are dealt to shards and, within a shard, to blocks of neighbours in length. A row of the
index is a token's postings in one block, with the largest frequency and the smallest length
among them; from these a bound of what the block can add to a score follows for any average
length and any document frequency, so adding documents never touches what is stored. Rows are in
the order of their tokens, so that a scan opens what a batch of queries asks for.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bare
from ..sources.shared import Folder
from .retrieval import BATCH_TOKENS, K1, B, _Asked, _codes, top

#: Documents of a block, and documents and characters of a shard, whose texts and postings a task holds.
BLOCK_DOCS, SHARD_DOCS, SHARD_CHARS = 128, 4096, 4_000_000
#: Rows of a file of the index.
FILE_ROWS = 2_000_000
#: Up to so many tokens a batch's tokens are a predicate on the scan; more are a join.
PUSHED_TOKENS = 1000
_POSTINGS = "tok long, shard int, block int, ids array<long>, fs array<int>, dls array<int>, most int, least int"
_SCORED = "query_id long, doc_id long, score double, blocks long, scored long"
_ROUNDING = 1e-6


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _invert(shard: pa.Table) -> pa.Table:
    """The posting rows of one shard's documents (shard, doc_id, bare)."""
    texts, ids = shard["bare"].to_pylist(), shard["doc_id"].to_numpy()
    order = np.lexsort((ids, np.fromiter(map(len, texts), np.int64, len(texts))))
    codes, owner = _codes([texts[i] for i in order])
    lengths = np.bincount(owner, minlength=len(texts))
    tokens, token = np.unique(codes, return_inverse=True)
    held, f = np.unique(token.astype(np.int64) * len(texts) + owner, return_counts=True)
    token, at = held // max(len(texts), 1), held % max(len(texts), 1)
    block = at // BLOCK_DOCS
    new = np.ones(len(held), bool)
    new[1:] = (token[1:] != token[:-1]) | (block[1:] != block[:-1])
    starts = np.flatnonzero(new)
    reduced = lambda by, x: by.reduceat(x, starts) if len(starts) else x
    return pa.table(
        {
            "tok": pa.array(tokens[token[starts]].astype(np.int64), pa.int64()),
            "shard": pa.array(np.full(len(starts), shard["shard"][0].as_py()), pa.int32()),
            "block": pa.array(block[starts], pa.int32()),
            "ids": _lists(ids[order][at], starts, pa.int64()),
            "fs": _lists(f, starts, pa.int32()),
            "dls": _lists(lengths[at], starts, pa.int32()),
            "most": pa.array(reduced(np.maximum, f), pa.int32()),
            "least": pa.array(reduced(np.minimum, lengths[at]), pa.int32()),
        }
    )


class InvertedIndex:
    """The index below ``path``: segments, each made by one :meth:`add`, and versions that name them.

    A version appears at once, in one small file; what a version names is never written again, so
    a search that has begun isn't touched by a later ``add``. Of two writers of one version the
    second gets FileExistsError.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._versions = Folder(spark, f"{self.path}/versions")

    def segments(self) -> list[dict]:
        """What the newest version names: for each segment its folder, its documents and their tokens."""
        names = self._versions.names()
        return json.loads(self._versions.read(names[-1])) if names else []

    def add(self, docs: DataFrame) -> None:
        """Add documents (doc_id, text) as a new segment; ids are whole numbers, of which null ones are left out.

        Every row is a document, also one whose id is there already. A null text is a document
        without tokens. Texts are tokenised here and nowhere else.
        """
        before = self.segments()
        texts = docs.select("doc_id", F.coalesce(bare(F.col("text")), F.lit("")).alias("bare")).where("doc_id is not null")
        size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("bare")), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.greatest(F.char_length("bare") - 1, F.least(F.char_length("bare"), F.lit(1)))), F.lit(0)).alias("tokens")).first()
        if not size["n"]:
            return
        shards = max(1, -(-size["n"] // SHARD_DOCS), -(-size["chars"] // SHARD_CHARS))
        dealt = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
        folder = f"{self.path}/segments/{uuid.uuid4().hex}"
        files = max(1, size["chars"] // FILE_ROWS)
        rows = dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(_invert, _POSTINGS)
        rows.repartitionByRange(files, "tok").sortWithinPartitions("tok", "shard", "block").write.parquet(f"{folder}/postings")
        stored = self.spark.read.parquet(f"{folder}/postings")
        stored.groupBy("tok").agg(F.sum(F.size("ids")).alias("df")).write.parquet(f"{folder}/vocabulary")
        self._versions.put(f"{len(self._versions.names()) + 1:012d}.json", json.dumps([*before, {"folder": folder, "docs": size["n"], "tokens": size["tokens"]}]))

    def vocabulary(self) -> DataFrame:
        """tok (as a number), df over all segments."""
        parts = [self.spark.read.parquet(f"{s['folder']}/vocabulary") for s in self.segments()]
        return reduce(DataFrame.unionByName, parts).groupBy("tok").agg(F.sum("df").alias("df"))

    def _postings(self, segments: list[dict], tokens: np.ndarray) -> DataFrame:
        """The rows of the tokens, with the segment and the token's number in the batch."""
        numbered = F.broadcast(self.spark.createDataFrame(pd.DataFrame({"tok": tokens.astype(np.int64), "at": np.arange(len(tokens))})))  # at most BATCH_TOKENS rows
        parts = []
        for i, s in enumerate(segments):
            rows = self.spark.read.parquet(f"{s['folder']}/postings")
            rows = rows.where(F.col("tok").isin([int(t) for t in tokens])) if len(tokens) <= PUSHED_TOKENS else rows
            parts.append(rows.join(numbered, "tok").withColumn("segment", F.lit(i)))
        return reduce(DataFrame.unionByName, parts)

    def _scored(self, queries: DataFrame, k: int, k1: float, b: float) -> DataFrame:
        """Hits (query_id, doc_id, score) that hold each query's ``k`` best, and a row without doc_id for each shard and query: blocks met, and scored."""
        asked = queries.select("query_id", F.coalesce(bare(F.col("text")), F.lit("")).alias("bare"))
        segments = self.segments()
        n_tokens = asked.agg(F.sum(F.char_length("bare"))).first()[0] or 0
        batches = n_tokens // BATCH_TOKENS + 1
        dealt = asked.withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(batches)))
        parts = [self._batch(segments, _Asked(dealt.where(F.col("batch") == i).select("query_id", "bare").collect()), k, k1, b) for i in range(batches if segments else 0)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], _SCORED)

    def _batch(self, segments: list[dict], asked: _Asked, k: int, k1: float, b: float) -> DataFrame:
        if not len(asked.tokens):
            return self.spark.createDataFrame([], _SCORED)
        n, average = sum(s["docs"] for s in segments), sum(s["tokens"] for s in segments) / max(sum(s["docs"] for s in segments), 1)
        tokens = self.spark.createDataFrame(pd.DataFrame({"tok": asked.tokens.astype(np.int64), "at": np.arange(len(asked.tokens))}))
        found = self.vocabulary().join(F.broadcast(tokens), "tok").select("at", "df").toPandas()  # a row for each token of the batch
        df = np.zeros(len(asked.tokens))
        df[found["at"].to_numpy(np.int64)] = found["df"].to_numpy(float)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        score = lambda shard: _score_shard(shard, asked, idf, average, k, k1, b)
        return self._postings(segments, asked.tokens).drop("tok").groupBy("segment", "shard").applyInArrow(score, _SCORED)

    def top(self, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
        """query_id, doc_id, score, rank: what :func:`vellum.operators.retrieval.bm25_top` gives over all documents added, from the index alone."""
        hits = self._scored(queries, k, k1, b).where("doc_id is not null").select("query_id", "doc_id", "score")
        return top(hits, "query_id", [F.desc("score"), F.asc("doc_id")], k)

    def reads(self, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
        """query_id, blocks that hold a token of the query, and how many of these had to be scored for its ``k`` best."""
        told = self._scored(queries, k, k1, b).where("doc_id is null")
        return told.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("scored").alias("scored"))


def _score_shard(shard: pa.Table, asked: _Asked, idf: np.ndarray, average: float, k: int, k1: float, b: float) -> pa.Table:
    """One shard's best documents for each query of a batch.

    A block's bound for a query is the sum of its tokens' bounds. Blocks are taken by their
    bounds, and of a block only the queries that could still gain a place among their ``k`` best.
    """
    block, token = shard["block"].to_numpy(), shard["at"].to_numpy()
    weight = lambda t, f, dl: idf[t] * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / max(average, 1e-300)))
    bound = weight(token, shard["most"].to_numpy(), shard["least"].to_numpy())
    blocks, place = np.unique(block, return_inverse=True)
    n = len(asked.ids)
    bounds = np.zeros((len(blocks), n))
    for i in range(len(blocks)):
        mine = np.flatnonzero(place == i)
        met = _queries_of(asked, token[mine])
        bounds[i] = np.bincount(asked.query[met[1]], weights=bound[mine][met[0]] * asked.times[met[1]], minlength=n)
    columns = [shard[c].combine_chunks() for c in ("ids", "fs", "dls")]
    sizes = np.diff(columns[0].offsets.to_numpy())
    first = columns[0].offsets.to_numpy()
    ids, fs, dls = (c.values.to_numpy() for c in columns)
    best, scored = np.zeros((n, k)), np.zeros(n, np.int64)
    made = [np.zeros((0, 3))]
    for i in np.argsort(-bounds.sum(1), kind="stable"):
        live = np.flatnonzero((bounds[i] > 0) & (bounds[i] + _ROUNDING >= best[:, 0]))
        if not len(live):
            continue
        scored[live] += 1
        mine = np.flatnonzero(place == i)
        rows = np.repeat(mine, sizes[mine])
        at = np.concatenate([np.arange(first[r], first[r] + sizes[r]) for r in mine])
        docs, doc = np.unique(ids[at], return_inverse=True)
        used, t = np.unique(token[rows], return_inverse=True)
        # a document is told by its id and length, so rows under one id stay apart where their lengths differ
        weights = np.zeros((len(docs), len(used)))
        weights[doc, t] = weight(token[rows], fs[at], dls[at])
        times = np.zeros((len(used), n))
        met = _queries_of(asked, used)
        times[met[0], asked.query[met[1]]] = asked.times[met[1]]
        scores = np.round(weights @ times[:, live], 6)
        best[live] = np.partition(np.concatenate([best[live], scores.T], axis=1), len(docs), axis=1)[:, len(docs) :]
        best[live] = np.sort(best[live], axis=1)
        d, q = np.nonzero((scores > 0) & (scores >= best[live, 0][None]))
        made.append(np.stack([live[q].astype(float), docs[d].astype(float), scores[d, q]], 1) if len(docs) and docs.max() < 2**53 else _wide(live[q], docs[d], scores[d, q]))
    rows = pd.concat([pd.DataFrame({"q": m[:, 0].astype(np.int64), "doc_id": m[:, 1].astype(np.int64), "score": m[:, 2].astype(float)}) for m in made])
    rows = rows.sort_values(["q", "score", "doc_id"], ascending=[True, False, True])
    rows = rows[rows.groupby("q").cumcount() < k]
    names = np.array([int(x) for x in asked.ids], np.int64)
    met = (bounds > 0).sum(0)
    told = np.flatnonzero(met)
    return pa.table(
        {
            "query_id": pa.array(np.concatenate([names[rows["q"].to_numpy()], names[told]]), pa.int64()),
            "doc_id": pa.array([*rows["doc_id"].tolist(), *[None] * len(told)], pa.int64()),
            "score": pa.array([*rows["score"].tolist(), *[None] * len(told)], pa.float64()),
            "blocks": pa.array([*[None] * len(rows), *met[told].tolist()], pa.int64()),
            "scored": pa.array([*[None] * len(rows), *scored[told].tolist()], pa.int64()),
        }
    )


def _wide(q: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Ids beyond 2 ** 53 keep their digits."""
    return np.stack([q.astype(object), docs.astype(object), scores.astype(object)], 1)


def _queries_of(asked: _Asked, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every query of every token: the token's place in ``tokens``, and the entry in the batch's lists."""
    n = asked.n[tokens]
    owner = np.repeat(np.arange(len(tokens)), n)
    return owner, asked.first[tokens][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
