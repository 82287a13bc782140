"""Token counts by heap-and-linked-list byte-pair merging; no token ids are made.

A text's count is its initial symbols minus the merges. In this vocabulary a space is written
as the mark U+2581 and no piece has a mark after another character, so no merge joins a mark
to what stands before it: texts are cut in front of every run of marks, the parts are counted
on their own, and each Python worker remembers the counts of words it has met. Of another
vocabulary that is looked up when it is read; texts are then counted whole.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LIMIT = 4096
#: Distinct words whose counts a Python worker remembers; beyond it the memory starts anew.
MEMORY = 1_000_000
MARK = "▁"
_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class _Odd(Exception):
    """A text with runs of spaces or with the mark itself."""


class PieceCounts(dict):
    """Counts of mark + word. Ranks are read from the public vocabulary file."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        #: Lower is merged earlier. Equal scores share a rank; the leftmost pair then goes first.
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in usable}
        self.cuts = not any(MARK in piece.lstrip(MARK) for piece in self.rank)
        for text in ("a b", " a  b ", "\u00e9x\u4e2d", "A\nb c"):
            if self.count(text) != len(model.encode(text)):
                raise ValueError(f"{model_path} isn't plain byte-pair merging with a mark for each space")

    def merged(self, part: str) -> int:
        """Symbols of ``part`` minus the merges done by always joining the lowest-rank adjacent pair."""
        rank, n = self.rank, len(part)
        if part in rank and n == 1:
            return 1
        symbols: list[str | None] = list(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(pair := symbols[i] + symbols[i + 1])
            if r is not None:
                heap.append((r, i, pair))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != pair:
                continue  # one of the two has been joined to another symbol meanwhile
            merges += 1
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(wider := pair + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, wider))
            if (h := before[i]) >= 0 and (r := rank.get(wider := symbols[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, wider))
        # characters outside the vocabulary fall back to a symbol for each UTF-8 byte
        return n - merges + sum(len(c.encode()) - 1 for c in part if c not in rank)

    def __missing__(self, word: str) -> int:
        if not word:
            raise _Odd
        n = self.merged(MARK + word) if "\n" not in word else self._lines(MARK + word)
        if len(word) < 100:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = n
        return n

    def _lines(self, part: str) -> int:
        """A line feed is no piece and in none, so nothing is joined across it."""
        if "\n" in self.rank:
            return self.merged(part)
        lines = part.split("\n")
        return len(lines) - 1 + sum(self.merged(x) for x in lines if x)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return self.merged(MARK + text.replace(" ", MARK))
        if MARK not in text:
            try:
                return sum(map(self.__getitem__, text.split(" ")))
            except _Odd:
                pass
        return sum(self._lines(x) for x in _PARTS.findall(MARK + text.replace(" ", MARK)))


_counters: dict[str, PieceCounts] = {}


def token_counts(docs: DataFrame, limit: int = LIMIT, model_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text.

    A null text counts as empty: no bytes, no tokens. Repeated rows give repeated results, an
    empty table an empty one; other columns are ignored. A text of any length is counted whole,
    in the task that reads it; pairs of equal rank are merged from the left.
    """
    if model_path is None:
        import public_tokenizers as public

        model_path = public.path("piece_bpe_32k.model")

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        if model_path not in _counters:
            _counters[model_path] = PieceCounts(model_path)
        count = _counters[model_path].count
        return pd.Series([count(x or "") for x in texts], dtype="int64")

    return (
        docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n_tokens("text").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op7_heap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
