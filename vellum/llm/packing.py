"""Best-two-fit packing of tokenised documents into fixed-length sequences.

How the work is spread
----------------------
Token ids are made once, per document, in Arrow batches. Packing itself only depends on how
many pieces there are of each length, and there are at most ``capacity`` lengths: that
histogram (at most 1,024 rows, whatever the input) is what the driver plans on. The plan is a
list of bin patterns with multiplicities. Pieces then find their slot by their rank among the
pieces of their length. Ranks come from a two-level count: a length with n pieces is dealt to
about sqrt(n) groups, so neither a group nor the list of groups of a frequent length is large.
"""

from __future__ import annotations

import base64
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table

CAPACITY = 1024
END_ID = 2
#: Distinct words whose ids a Python worker remembers; beyond it the memory starts anew.
MEMORY = 400_000

_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class _Odd(Exception):
    """A text that can't be cut at single spaces."""


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit) of " " + word, as the tokenizers library gives them.

    The vocabulary's pattern puts one space in front of the word that follows, so a text may be
    cut at any single space between two other characters that aren't white space, and the ids
    of the parts joined. Texts with other white space next to a space, with the special string,
    or with a word of more than 2,000 characters are encoded whole; the ids are the same, and
    long words stay out of the memory. New words go through the rank file of the same vocabulary.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.special = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _packed(ids) -> bytes:
        import numpy as np

        return np.asarray(ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace() or len(word) > 2000:
            raise _Odd
        if len(self) >= MEMORY:
            self.clear()
        found = self[word] = self._packed(self.words.encode_ordinary(" " + word))
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not any(x in text for x in self.special):
            first, *rest = text.split(" ")
            try:
                if first and not first[-1].isspace() and len(first) <= 2000:
                    return self._packed(self.words.encode_ordinary(first)) + b"".join(map(self.__getitem__, rest))
            except _Odd:
                pass
        return self._packed(self.whole.encode(text, add_special_tokens=False).ids)


_encoders: dict[tuple, WordIds] = {}


def _encoder(*paths: str) -> WordIds:
    """One per Python worker process."""
    if paths not in _encoders:
        _encoders[paths] = WordIds(*paths)
    return _encoders[paths]


def tokenised_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    vocabulary: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most ``capacity`` tokens, the closing id included.

    Only the first piece of a document that is cut may be shorter than ``capacity``. A null or
    empty text is one piece of one token. Every row is a document of its own, so repeated rows
    give repeated pieces. A text of any length is encoded whole, in the task that reads it. Other
    columns are ignored. ``ids`` is null unless ``with_ids``.
    """
    if vocabulary is None:
        import public_tokenizers as public

        vocabulary = (public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(*vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                stop = (n - 1) % capacity + 1
                start = piece = 0
                while start < n:
                    part = ids[4 * start : 4 * stop]
                    rows.append((None if pd.isna(doc_id) else int(doc_id), piece, start, stop - start, zlib.crc32(part), part if with_ids else None))
                    start, stop, piece = stop, stop + capacity, piece + 1
            out = pd.DataFrame(rows, columns=_PIECES.fieldNames())
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInPandas(cut, _PIECES)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(bins, [(length, copies in each bin), ...])`` that use up all of ``counts``.

    A bin is opened by the longest length left and filled with the longest that fits, again and
    again. Then its smallest member is replaced by the two lengths left whose sum fills the gap
    and the place of the member best, as long as that leaves less of a gap. The pattern is used
    as often as the counts allow, so the number of patterns depends on the number of lengths.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    order = sorted(left)
    plan = []
    while order:
        used: dict[int, int] = {}

        def free(length: int, used: dict[int, int] = used) -> int:
            return left[length] - used.get(length, 0)

        def take(length: int, by: int = 1, used: dict[int, int] = used) -> None:
            used[length] = used.get(length, 0) + by
            if not used[length]:
                del used[length]

        take(order[-1])
        gap = capacity - order[-1]
        at = bisect_right(order, gap) - 1
        while at >= 0 and gap > 0:
            length = order[at]
            if length <= gap and (copies := min(free(length), gap // length)) > 0:
                take(length, copies)
                gap -= copies * length
            at = min(at - 1, bisect_right(order, gap) - 1)
        while gap > 0:
            smallest = min(used)
            take(smallest, -1)
            room, best = gap + smallest, (smallest, None)
            low, high = 0, bisect_right(order, room - 1) - 1
            while low <= high and best[0] < room:
                a, b = order[low], order[high]
                if a + b > room or free(b) <= 0:
                    high -= 1
                elif free(a) <= (a == b):
                    low += 1
                else:
                    if a + b > best[0]:
                        best = (a + b, (a, b))
                    low += 1
            if best[1] is None or not used and best[1][1] < smallest:
                take(smallest)
                break
            for length in best[1]:
                take(length)
            gap = room - best[0]
        bins = min(left[k] // v for k, v in used.items())
        plan.append((bins, sorted(used.items(), reverse=True)))
        for k, v in used.items():
            left[k] -= bins * v
            if not left[k]:
                del left[k]
                order.remove(k)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to materialised pieces, in place of their number ``at``.

    ``pieces`` is read twice, so it must be a stored table (see :func:`materialise`); ``at`` tells
    its rows apart, also where ids are null or repeated. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, base = [], 0
    met: dict[int, int] = {}
    for bins, members in best_two_fit(counts, capacity):
        offset = 0
        for length, copies in members:
            first = met.get(length, 0)
            met[length] = first + bins * copies
            slots.append((length, first, met[length], copies, base, offset))
            offset += length * copies
        base += bins
    # at most `capacity` rows, and at most a few slots for each of them: bounded by the capacity, not by the input
    groups = spark.createDataFrame([(k, math.isqrt(v) + 1) for k, v in counts.items()], "length long, n_groups int")
    slots = spark.createDataFrame(slots, "length long, first_rank long, last_rank long, copies int, base long, place long")
    keyed = pieces.join(F.broadcast(groups), "length").withColumn("grp", F.expr("pmod(xxhash64(at), n_groups)")).drop("n_groups")
    before = (
        keyed.groupBy("length", "grp")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("grp")) - F.col("n"))
        .drop("n")
    )
    in_group = Window.partitionBy("length", "grp").orderBy("at")
    ranked = keyed.withColumn("rn", F.row_number().over(in_group) - 1).join(before, ["length", "grp"]).withColumn("rank", F.col("before") + F.col("rn"))
    hit = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("last_rank"))
    slot = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(F.broadcast(slots.withColumnRenamed("length", "slot_length")), (F.col("length") == F.col("slot_length")) & hit)
        .withColumn("sequence_id", F.col("base") + F.floor(slot / F.col("copies")))
        .withColumn("offset", F.col("place") + F.pmod(slot, F.col("copies")) * F.col("length"))
        .select(*[c for c in pieces.columns if c != "at"], "sequence_id", "offset")
    )


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack documents; one row per piece. See the functions above for edge cases."""
    pieces = tokenised_pieces(docs, capacity, end_id, with_ids).withColumn("at", F.monotonically_increasing_id())
    return pack(materialise(pieces, "pieces"), capacity)


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    return packed_sequences(table(spark, sf_dir, "documents")).drop("ids")
