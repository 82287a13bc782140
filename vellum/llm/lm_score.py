"""Language-model scores of whole texts, by prediction by partial matching (see :mod:`.ppm`).

Documents are dealt to blocks of some tens of megabytes. A block only sends its distinct grams
and words with their training counts; summed over blocks these are the model and the word
counts, as large as the corpus makes them. Words go by a 64-bit hash: of a million distinct words
two share one with a chance of about one in forty million, and would then be counted as one.

The probability of a gram is worked out once, in shards of grams whose contexts end alike: in the
last two bytes, or in as many more as it takes to have at most SHARD_GRAMS of them (contexts of
all ORDER bytes have at most 256). The levels of the trie from there up are complete in a shard.
Of those below, the two lowest have at most 65,536 and 256 entries and are handed to every task;
a shard gets the rest, at most 256 rows for each byte that its contexts end in, by a join. Each
block gets back the values of its own grams and words, and adds them up per document. So neither
the model nor the counts are ever in one place, and no shard grows with the corpus.

A block's rows come to its task, and leave it, in Arrow batches. A cogroup would hand all of them
over as one piece, which the executor's JVM and its Python worker would both hold.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ppm
from .common import materialise, remainder, table

ORDER = 5
#: UTF-8 bytes of text in a block, about.
BLOCK_BYTES = 24_000_000
#: Grams of a shard, about.
SHARD_GRAMS = 300_000
#: Bytes of text that are turned into grams at a time.
_CHUNK = 500_000
#: Ranges of keys in which a block's counts are added up and handed on.
_PARTS = 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_GRAM, _WORD, _TEXT = 0, 1, 2
_KEYS = "block int, kind byte, key long, n long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of bytes other than the six of ASCII white space."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def _chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The tokens of texts, about _CHUNK bytes of text at a time, and the place of the first of them."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text.as_py()
        held.append(tokens(text))
        size += len(text or "")
        if size > _CHUNK:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _give_back() -> None:
    """Freed memory goes back to the system. Workers are kept between stages, and would sit on that of their largest block."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


class _Sums:
    """Counts added up by key in _PARTS ranges of keys, so that adding to one holds little besides; a range has runs of sorted keys."""

    def __init__(self):
        self.bounds: np.ndarray | None = None
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(_PARTS)]

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        """``keys``: distinct, in order. Those of the first call say where ranges end."""
        if not len(keys):
            return
        if self.bounds is None:
            self.bounds = keys[np.arange(1, _PARTS) * len(keys) // _PARTS]
        ends = [0, *np.searchsorted(keys, self.bounds), len(keys)]
        for runs, start, end in zip(self.parts, ends[:-1], ends[1:], strict=True):
            if start < end:
                runs.append((keys[start:end], n[start:end]))
            while len(runs) > 1 and len(runs[-2][0]) < 2 * len(runs[-1][0]):
                self._join(runs)

    @staticmethod
    def _join(runs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        (a, n), (b, m) = runs.pop(), runs.pop()
        runs.append(ppm.counted(np.concatenate([a, b]), np.concatenate([n, m])))

    def taken(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys and counts of each range that has any, which are then forgotten."""
        for runs in self.parts:
            while len(runs) > 1:
                self._join(runs)
            if runs:
                yield runs.pop()


def _count_block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams and words of a block, with their counts in its training rows."""
    sums = {_GRAM: _Sums(), _WORD: _Sums()}
    for batch in batches:
        for first, chunk in _chunks(batch["text"]):
            held_out = batch["held_out"].slice(first, len(chunk)).to_pylist()
            for use in (1, 0):
                found = [x for x, held in zip(chunk, held_out, strict=True) if held != use]
                if not found:
                    continue
                values, n = ppm.counted(np.concatenate([ppm.grams(b" ".join(x), ORDER) for x in found]))
                sums[_GRAM].add(values, n * use)
                words: Counter = Counter()
                for x in found:
                    words.update(x)
                hashed = np.fromiter(map(_hash, words), np.uint64, len(words))
                values, n = ppm.counted(hashed, np.fromiter(words.values(), np.int64, len(words)))
                sums[_WORD].add(values, n * use)
    block = key[0].as_py()
    for kind, found in sums.items():
        for keys, n in found.taken():
            yield pa.RecordBatch.from_pydict(
                {"block": np.full(len(keys), block, np.int32), "kind": np.full(len(keys), kind, np.int8), "key": keys.view(np.int64), "n": n}
            )
    _give_back()


def _sorted_values(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their values; ``held`` is emptied."""
    keys = np.concatenate([np.zeros(0, np.int64), *(x["key"].to_numpy() for x in held)])
    values = np.concatenate([np.zeros(0), *(x["value"].to_numpy() for x in held)])
    held.clear()
    order = np.argsort(keys)
    return keys[order], values[order]


def _score_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of a block's documents (key: doc_id, value: 1 if held out), given the values of its grams and counts of its words."""
    held: dict[int, list[pa.RecordBatch]] = {_GRAM: [], _WORD: [], _TEXT: []}
    for batch in batches:
        for kind, own in held.items():
            mine = batch.filter(pa.compute.equal(batch["kind"], kind))
            if len(mine):
                own.append(mine.select(["key", "value", "text"] if kind == _TEXT else ["key", "value"]))
    keys, log_p = _sorted_values(held[_GRAM])
    keys = keys.view(np.uint64)
    word_keys, word_counts = _sorted_values(held[_WORD])
    docs = pa.Table.from_batches(held.pop(_TEXT))
    n_tokens, n_known = np.ones(len(docs), np.int64), np.zeros(len(docs), np.int64)
    base, scores = np.zeros(len(docs)), np.zeros(len(docs))
    for first, chunk in _chunks(docs["text"]):
        number: dict[bytes, int] = {}
        for x in chunk:
            for w in x:
                if w not in number:
                    number[w] = len(number)
        hashed = np.fromiter(map(_hash, number), np.uint64, len(number)).view(np.int64)
        count = word_counts[np.searchsorted(word_keys, hashed)] if len(hashed) else np.zeros(0)
        log_count = np.log10(count + 1)
        for i, x in enumerate(chunk, first):
            at = np.fromiter(map(number.__getitem__, x), np.int64, len(x))
            n_tokens[i] += len(x)
            n_known[i] = (count[at] > 0).sum()
            base[i] = log_count[at].sum()
        made = [ppm.grams(b" ".join(x), ORDER) for x in chunk]
        starts = np.cumsum([0] + [len(g) for g in made[:-1]])
        scores[first : first + len(chunk)] = np.add.reduceat(log_p[np.searchsorted(keys, np.concatenate(made))], starts)
    ids, held_out = docs["key"].combine_chunks(), pa.array(docs["value"].to_numpy() > 0)
    del docs, keys, log_p, word_keys, word_counts
    _give_back()
    yield pa.RecordBatch.from_pydict({"doc_id": ids, "held_out": held_out, "n_tokens": n_tokens, "n_known": n_known, "base_sum": base, "score": scores})


def _value_shard(part: pd.DataFrame, between: pd.DataFrame, low: dict) -> pd.DataFrame:
    """Probabilities of a shard's grams. ``between``: level, key, n of the levels above ``low`` and below the shard's own."""
    part = part.sort_values("key")
    low = dict(low)
    for level, rows in between.sort_values("key").groupby("level"):
        low[int(level)] = (rows["key"].to_numpy(np.int64).astype(np.uint64), rows["n"].to_numpy(np.int64))
    keys = part["key"].to_numpy(np.int64).astype(np.uint64)
    return pd.DataFrame({"kind": np.int8(_GRAM), "key": part["key"], "value": ppm.log10_probabilities(keys, part["n"].to_numpy(np.int64), ORDER, low)})


def _ending(key, n_bytes):
    """The last bytes of a gram's context; ``n_bytes`` may be a column."""
    if isinstance(n_bytes, int):
        return F.shiftright(key, 8).bitwiseAND((1 << (8 * n_bytes)) - 1)
    return reduce(lambda other, n: F.when(n_bytes == n, _ending(key, n)).otherwise(other), range(3, ORDER + 1), _ending(key, 2))


def _values(grams: DataFrame, n_grams: int) -> DataFrame:
    """kind, key, value of all grams (key, n)."""
    low = {}
    for k in (1, 0):  # at most 65,536 and 256 rows
        found = grams.groupBy(F.col("key").bitwiseAND((1 << (8 * (k + 1))) - 1).alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toPandas()
        low[k] = (found["key"].to_numpy(np.int64).astype(np.uint64), found["n"].to_numpy(np.int64))
    dealt, depth, deepest = grams.withColumn("depth", F.lit(2)), F.col("depth"), 2
    for d in range(2, ORDER):
        here = dealt.where(depth == d).groupBy(_ending(F.col("key"), d).alias("hot")).agg(F.count("*").alias("size"))
        hot = materialise(here.where(F.col("size") > SHARD_GRAMS).select("hot"), "hot")
        if hot.isEmpty():
            break
        met = dealt.join(hot, (_ending(F.col("key"), d) == F.col("hot")) & (depth == d), "left")
        dealt, deepest = met.withColumn("depth", F.when(F.col("hot").isNotNull(), d + 1).otherwise(depth)).drop("hot"), d + 1
    pool = F.pmod(F.xxhash64(_ending(F.col("key"), depth)), F.lit(n_grams // SHARD_GRAMS + 1)).cast("int").alias("pool")
    dealt = dealt.select("key", "n", "depth", pool)
    below = grams.sparkSession.createDataFrame([], "to_depth int, to_pool int, level int, key long, n long")
    for k in range(2, deepest):  # level k is handed to the shards that are told by more than k bytes
        deeper = dealt.where(depth > k)
        level = deeper.groupBy(F.col("key").bitwiseAND((1 << (8 * (k + 1))) - 1).alias("key")).agg(F.sum("n").alias("n")).withColumn("end", _ending(F.col("key"), k))
        shards = deeper.select(depth.alias("to_depth"), F.col("pool").alias("to_pool"), _ending(F.col("key"), k).alias("end")).distinct()
        below = below.unionByName(shards.join(level, "end").select("to_depth", "to_pool", F.lit(k).alias("level"), "key", "n"))
    return dealt.groupBy("depth", "pool").cogroup(below.groupBy("to_depth", "to_pool")).applyInPandas(lambda part, levels: _value_shard(part, levels, low), "kind byte, key long, value double")


def language_scores(docs: DataFrame) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text, held_out); rows with ``held_out`` aren't learned from.

    The text that is scored is its tokens with a space between, then the end. A null text is
    empty and has the end as its one token. Repeated rows are scored, and learned from, each. A
    null ``held_out`` counts as false; other columns are ignored. With nothing to learn from, all
    symbols are equally likely. A text of any length is scored whole, in the task of its block,
    which holds it and its grams. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("learned")).first()
    n_blocks = math.ceil((size["bytes"] or 0) / BLOCK_BYTES) + 1
    learned = size["learned"]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))
    keys = materialise(dealt.groupBy("block").applyInArrow(_count_block, _KEYS), "keys", compression="zstd")
    summed = materialise(keys.groupBy("kind", "key").agg(F.sum("n").alias("n")), "model", compression="zstd")
    word, gram = F.col("kind") == _WORD, F.col("kind") == _GRAM
    counted = summed.agg(F.sum(F.when(word, F.col("n"))).alias("n"), F.count_if(word & (F.col("n") > 0)).alias("v"), F.count_if(gram).alias("grams")).first()
    n_train, n_distinct = (counted["n"] or 0) + learned, counted["v"] + (learned > 0)
    values = _values(summed.where(gram).select("key", "n"), counted["grams"])
    values = values.unionByName(summed.where(F.col("kind") == _WORD).select("kind", "key", F.col("n").cast("double").alias("value")))
    back = keys.select("block", "kind", "key").join(values, ["kind", "key"])
    texts = dealt.select("block", F.lit(_TEXT).cast("byte").alias("kind"), F.col("doc_id").alias("key"), F.col("held_out").cast("double").alias("value"), "text")
    scored = texts.unionByName(back.withColumn("text", F.lit(None).cast("string"))).groupBy("block").applyInArrow(_score_block, _SCORES)
    end = math.log10(learned + 1)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + int(learned > 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_sum") + end - F.col("n_tokens") * math.log10(n_train + n_distinct + 1)).alias("base_score"),
        "score",
    )


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned where crc32(doc_id) mod 7 isn't 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language_scores(docs.withColumn("held_out", remainder("doc_id", 7) == 2))
