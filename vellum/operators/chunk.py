"""Cutting texts into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 200, 40
SEPARATORS = ("\n\n", "\n", "。", " ", "")


def sliding_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, chunk_index (from 0), start, content: windows of ``size`` characters that overlap; none for an empty or null text.

    The text is cut once into pieces of one step; a window is a piece and the beginning of the
    next, so the cost grows with the length and not with its square. ``overlap`` is at most half
    of ``size``. A last piece that the window before it holds whole begins no window. Windows
    have the columns ``keep`` of their document.
    """
    step = size - overlap
    if overlap > step:
        raise ValueError("windows may overlap by half of their size at most")
    pieces = docs.select("doc_id", *keep, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), 0).alias("pieces"))
    n = F.size("pieces")
    held = (n > 1) & (F.char_length(F.try_element_at("pieces", F.lit(-1))) <= overlap)
    used = F.slice("pieces", F.lit(1), F.when(held, n - 1).otherwise(n))
    following = lambda i: F.coalesce(F.left(F.get("pieces", i + 1), F.lit(overlap)), F.lit(""))
    # outer: otherwise texts would be cut once more, for a filter on the number of windows
    cut = pieces.select("doc_id", *keep, F.posexplode_outer(F.transform(used, lambda x, i: F.concat(x, following(i)))).alias("chunk_index", "content")).where("chunk_index is not null")
    return cut.select("doc_id", *keep, "chunk_index", (F.col("chunk_index") * step).alias("start"), "content")


def _parts(text: str, separator: str) -> list[str]:
    """``text`` cut in front of every separator; in front of every character for an empty one. Nothing is lost."""
    if not separator:
        return list(text)
    head, *tail = text.split(separator)
    return [part for part in (head, *(separator + t for t in tail)) if part]


def _joined(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Runs of parts of at most ``size`` characters; the next begins with those last parts of a run that make up to ``overlap``."""
    first = held = 0
    for i, part in enumerate(parts):
        if held and held + len(part) > size:
            yield "".join(parts[first:i])
            while held > overlap or (held and held + len(part) > size):
                held -= len(parts[first])
                first += 1
        held += len(part)
    yield "".join(parts[first:])


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Recursive splitting: pieces of ``text`` of at most ``size`` characters, without blanks at their ends.

    The first separator that occurs cuts the text. Parts shorter than ``size`` are joined to
    their neighbours; a longer one ends the run before it and is split on its own, by the
    separators that follow. So every chunk is a piece of the text, and chunks overlap only
    between parts of one level.
    """
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    chunks, short = [], []
    for part in _parts(text, separators[at]):
        if len(part) < size:
            short.append(part)
            continue
        chunks += _joined(short, size, overlap)
        short = []
        chunks += split_text(part, size, overlap, finer) if finer else [part]
    chunks += _joined(short, size, overlap)
    return [bare for bare in map(str.strip, chunks) if bare]


def recursive_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index, content by :func:`split_text`, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", size, overlap))

    return docs.select("doc_id", F.posexplode(cut("text")).alias("chunk_index", "content"))
