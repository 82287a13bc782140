"""Exact duplicates by content-defined chunk recipes.

A text is cut where its own bytes say so, so equal passages give equal chunks wherever they stand.
Each distinct chunk gets an identifier that is verified against the bytes of every other chunk; a
text is then the ordered list of its identifiers, its recipe, and equal recipes are equal texts.
Chunks are combined where they are read and moved once; afterwards only recipes move, some twenty
bytes for each thousand of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Bytes of a chunk: at least, on average about, and at most.
LEAST, USUAL, MOST = 256, 1024, 8192
#: Texts that are cut at a time.
BATCH = 128
#: Bytes that decide whether a chunk ends after the last of them.
WINDOW = 16
_STEP = 1 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = bytes.maketrans(_UPPER.encode(), _LOWER.encode())


def normalised(data: bytes | None) -> bytes:
    """What is compared: a text's bytes with A-Z, and nothing else, in lower case; a null text is an empty one."""
    return (data or b"").translate(_TO_LOWER)


def _marks(data: np.ndarray) -> np.ndarray:
    """Places after which the window of bytes that ends there says that a chunk may end."""
    found = []
    for i in range(0, len(data) - WINDOW + 1, _STEP):
        part = data[i : i + _STEP + WINDOW - 1]
        words = np.lib.stride_tricks.sliding_window_view(part, 8)
        # eight bytes from each place as one number, whatever its alignment
        eight = np.ascontiguousarray(words).view("<u8")[:, 0]
        mixed = (eight[: len(part) - WINDOW + 1] * _ODD[0]) ^ (eight[8:] * _ODD[1])
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[1]
        found.append(np.flatnonzero((mixed >> np.uint64(40)) % np.uint64(USUAL) == 0) + i + WINDOW)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end: at its own marks, but no sooner than ``LEAST`` and no later than ``MOST`` bytes after the end before."""
    marks, ends, at = _marks(np.frombuffer(data, np.uint8)), [], 0
    i = 0
    while len(data) - at > LEAST:
        i += int(np.searchsorted(marks[i:], at + LEAST))
        end = min(int(marks[i]) if i < len(marks) else len(data), at + MOST, len(data))
        ends.append(end)
        at = end
    return [*ends, len(data)] if at < len(data) else ends


def chunks_of(data: bytes) -> list[bytes]:
    ends = chunk_ends(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, digest, chunks of (doc_id, text); a few rows at a time, so that a task holds little besides what Spark hands it.

    This is done in Python because an expression would copy a text's bytes for each of its
    chunks, and Spark's ``translate`` takes long.
    """
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH):
            part = batch.slice(i, BATCH)
            whole = [normalised(t) for t in part.column("text").to_pylist()]
            digests = pa.array([hashlib.sha256(t).digest() for t in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), digests, pa.array(map(chunks_of, whole), pa.list_(pa.binary()))], names=["doc_id", "digest", "chunks"])


def _fingerprint(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest, parts, turns for every row of ``docs``, as a stored table.

    ``row`` is a number of its own for every row. ``parts`` and ``turns`` together are the recipe:
    the fingerprints of the text's chunks, in order, and for those fingerprints that several
    different chunks have, which of these it is. All chunks of a fingerprint are compared as
    bytes, over the whole table, so two texts have one recipe if and only if they are equal.
    ``digest`` is the SHA-256 of the normalised text.
    """

    kind = dict(docs.dtypes)["doc_id"]
    cut = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_cut, f"doc_id {kind}, digest binary, chunks array<binary>")
    made = materialise(
        cut.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "digest",
            F.transform("chunks", _fingerprint).alias("parts"),
        ),
        "recipes",
    )
    return _verified(cut, made)


def _verified(cut: DataFrame, made: DataFrame) -> DataFrame:
    """``made`` with the turns of fingerprints that don't tell their chunks apart."""
    distinct = cut.select(F.explode("chunks").alias("chunk")).select(_fingerprint(F.col("chunk")).alias("part"), "chunk").groupBy("part", "chunk").agg(F.count("*").alias("uses"))
    unclear = materialise(distinct.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part"), "unclear")
    plain = made.withColumn("turns", F.array().cast("array<int>"))
    if unclear.isEmpty():  # as always with a fingerprint of 64 bits and less than billions of chunks
        return plain
    # chunks that share a fingerprint are numbered by their bytes, and the rows that hold one are cut again
    turn = F.row_number().over(Window.partitionBy("part").orderBy("chunk"))
    numbered = materialise(distinct.join(unclear, "part", "left_semi").select("part", "chunk", turn.alias("turn")), "numbered")
    touched = materialise(made.select("row", "digest", F.explode("parts").alias("part")).join(unclear, "part", "left_semi").select("row", "digest").distinct(), "touched")
    texts = cut.join(touched.select("digest").distinct(), "digest", "left_semi")
    held = texts.select("digest", F.posexplode("chunks").alias("i", "chunk")).distinct().withColumn("part", _fingerprint(F.col("chunk")))
    turned = (
        held.join(numbered, ["part", "chunk"], "left")
        .groupBy("digest")
        .agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("turn", F.lit(0)).alias("turn")))).alias("turns"))
        .select("digest", F.col("turns.turn").alias("turns"))
    )
    return materialise(made.join(turned, "digest", "left").select(*made.columns, F.coalesce("turns", F.array().cast("array<int>")).alias("turns")), "recipes")


def exact_classes(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks for every row of ``docs`` (doc_id, text).

    Texts are equal if they are so after lower-casing A-Z; a null text counts as empty, and empty
    texts equal each other. Of equal texts the row with the largest doc_id stays, a row without
    an id only if none has one; of several rows with that id and text exactly one stays. Repeated
    rows are rows of their own. A text of any length is cut in the task that reads it. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    made = recipes(docs)
    groups = materialise(made.groupBy("parts", "turns").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("size")).where("size > 1"), "groups")
    joined = made.join(groups.withColumnsRenamed({"parts": "their_parts", "turns": "their_turns"}), (F.col("parts") == F.col("their_parts")) & (F.col("turns") == F.col("their_turns")), "left")
    alone = F.col("size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.size("parts").alias("n_chunks"),
    )


def op11_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts among all documents."""
    return exact_classes(table(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE_SQL = f"""
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents
),
groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM texts t JOIN groups g ON g.text = t.text
"""
