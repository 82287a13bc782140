"""Vectors as codes of a few bytes: a codebook for each part of a vector, fitted over all rows by exponion search.

Everything is whole numbers, so every order of adding up gives the same codebooks. A part starts
at the entry that it was given to the round before, at distance u. An entry nearer than that, or
as near, lies within 2u of the first one, by the triangle inequality; so only the first entry's
neighbours inside that ball are looked at, in the order of their distance, in rings that double.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Products of matrices in double precision are exact below this; beyond it whole numbers are multiplied as such.
_EXACT = 1 << 53


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every entry, exactly, as int64."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < _EXACT:
        x, entries = x.astype(float), entries.astype(float)
    return ((x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None]).astype(np.int64)


class Neighbours:
    """One part's codebook, with every entry's list of all entries by distance; ties by index, the entry itself first."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = _squares(entries, entries)
        own = gaps.copy()
        np.fill_diagonal(own, -1)  # equal entries are at distance 0 too
        self.order = np.argsort(own, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each row and its squared distance, equal ones by the smaller index; and how many distances were worked out."""
        best, least, looked = start.astype(np.int64), np.zeros(len(x), np.int64), len(x)
        for a in np.unique(start):
            mine = np.flatnonzero(start == a)
            part = x[mine]
            first = _squares(part, self.entries[a : a + 1])[:, 0]
            # gap <= 2u, in squares; the list is sorted, so this many of its entries can matter
            reach = np.searchsorted(self.gaps[a], 4 * first, side="right")
            found, index = first.copy(), np.full(len(mine), a, np.int64)
            at, width = 1, 1
            while at < len(self.entries) and (live := np.flatnonzero(reach > at)).size:
                ring = self.order[a, at : at + width]
                d = _squares(part[live], self.entries[ring])
                looked += d.size
                low = d.min(1)
                ring_best = np.where(d == low[:, None], ring[None], len(self.entries)).min(1)
                better = (low < found[live]) | ((low == found[live]) & (ring_best < index[live]))
                found[live[better]], index[live[better]] = low[better], ring_best[better]
                at, width = at + width, 2 * width
            best[mine], least[mine] = index, found
        return best, least, looked


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _moved(sums: list, before: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks that follow from (part, entry, position, total, n); entries that no part has stay."""
    after = [b.copy() for b in before]
    for r in sums:
        after[r["part"]][r["entry"], r["position"]] = r["total"] // r["n"]  # rounds down, below zero too
    return after


class Codes:
    """``rows`` (the columns given, parts, codes, error), and the codebooks that they were given to."""

    def __init__(self, rows: DataFrame, books: list[np.ndarray]):
        self.rows, self.books = rows, books

    def sha256(self) -> str:
        """Of all entries' components in decimal, by part, entry and position, with commas between."""
        return hashlib.sha256(",".join(str(c) for b in self.books for e in b for c in e).encode()).hexdigest()


def fit_codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> Codes:
    """Fit codebooks over all rows of (vec_id, vector, ...) and give every row its codes.

    Rows whose vector is null or holds null or non-finite components are left out. A component x
    becomes floor(1024 x). The first codebooks are the vectors of the smallest ids, nulls last
    and equal ids by their vectors; with fewer rows than ``entries`` there are fewer entries. Of
    entries as near the first is taken; equal entries may stand in a codebook. The dimension is
    that of the first vector; one of another length has no place in the codebooks and is left
    out, and so are all if it isn't a multiple of ``parts``. Components so large that squared
    errors wouldn't fit 64 bits are an error. An empty table gives an empty result. Repeated rows
    are rows of their own; other columns are carried along, whatever their names but these.

    A round reads the rows once, in tasks of any number, and writes them with their new codes to
    the shared folder; what is added up over them is ``entries`` sums a part from each task.
    """
    names = [c for c in vectors.columns if c not in ("vector", "parts", "codes", "error")]
    double = F.col("vector").cast("array<double>")
    finite = F.coalesce(F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    sound = vectors.where(F.col("vector").isNotNull() & finite & (F.size("vector") > 0) & (F.size("vector") % parts == 0))
    in_order = lambda rows: rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select(double.alias("v"))
    one = in_order(sound).first()
    if one is None:
        empty = vectors.where(F.lit(False)).select(*names, F.array().cast("array<bigint>").alias("parts"), F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error"))
        return Codes(empty, [])
    dim = len(one["v"])
    limit = int((2**62 // (4 * dim)) ** 0.5) // SCALE
    whole = F.transform(double, lambda x: F.floor(F.when(F.abs(x) < limit, x * SCALE)))
    sound = sound.where(F.size("vector") == dim)
    if not sound.where(F.exists(double, lambda x: F.abs(x) >= limit)).isEmpty():
        raise ValueError(f"components of {limit} or more have squared errors beyond 64 bits")
    width = dim // parts
    first = in_order(sound).limit(entries).collect()  # the codebooks to begin with
    integers = np.floor(np.array([r["v"] for r in first]) * SCALE).astype(np.int64)
    books = [integers[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    # any entry may be the one to start at, as the ball around it holds all that matter
    rows = materialise(sound.select(*names, whole.alias("parts"), F.unhex(F.lit("0000" * parts)).alias("codes"), F.lit(0).cast("long").alias("error")), "parts")
    for left in reversed(range(rounds + 1)):
        before, rows = rows, materialise(_assigned(rows, books, width), "codes")
        discard(before)
        if left:
            books = _moved(_sums(rows, len(books[0]), width, parts), books)
    return Codes(rows, books)


def _codes_of(column: pa.Array, parts: int) -> np.ndarray:
    """Entries as little-endian numbers of two bytes, part by part."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, parts)


def _assigned(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    names = rows.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Neighbours(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, start = _matrix(batch.column("parts"), width * len(books)), _codes_of(batch.column("codes"), len(books))
            found = [n.nearest(x[:, p * width : (p + 1) * width], start[:, p]) for p, n in enumerate(lists)]
            codes = np.stack([f[0] for f in found], 1).astype("<u2")
            error = sum(f[1] for f in found)
            made = {"codes": pa.array([c.tobytes() for c in codes], pa.binary()), "error": pa.array(error, pa.int64())}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

    return rows.mapInArrow(assign, rows.schema)


def _sums(rows: DataFrame, entries: int, width: int, parts: int) -> list:
    """(part, entry, position, total, n) of every entry that a part has; at most one row for each number in the codebooks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x, codes = _matrix(batch.column("parts"), width * parts), _codes_of(batch.column("codes"), parts)
            for p in range(parts):
                np.add.at(totals[p], codes[:, p], x[:, p * width : (p + 1) * width])
                n[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), totals[part, entry].ravel(), np.repeat(n[part, entry], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "position", "total", "n"])

    made = rows.select("parts", "codes").mapInArrow(add, "part long, entry long, position long, total long, n long")
    return made.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, their errors, and the errors of their labels together."""
    fitted = fit_codes(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector")))
    # two bytes an entry, of which the higher is 0 with at most 256 entries
    code = F.concat(*[F.lower(F.hex(F.substring("codes", 2 * p + 1, 1))) for p in range(PARTS)])
    totals = materialise(fitted.rows.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "their")
    return fitted.rows.join(totals, F.col("label").eqNullSafe(F.col("their"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(fitted.sha256() if fitted.books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256")
    )


def _round_sql(i: int) -> str:
    """The codebooks of round ``i`` from those of the round before."""
    return f"""
near{i} AS (
  SELECT s.r, s.part, min(CAST(list_dot_product(s.p, s.p) - 2 * list_dot_product(s.p, b.e) + list_dot_product(b.e, b.e) AS BIGINT) * {ENTRIES} + b.entry) AS best
  FROM subs s JOIN book{i} b ON b.part = s.part GROUP BY s.r, s.part
),
book{i + 1} AS (
  SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM book{i} b LEFT JOIN (
    SELECT part, entry, list(c ORDER BY place) AS e FROM (
      SELECT s.part, n.best % {ENTRIES} AS entry, place, floor(sum(CAST(s.p[place] AS HUGEINT)) / count(*)) AS c
      FROM near{i} n JOIN subs s ON s.r = n.r AND s.part = n.part, unnest(range(1, len(s.p) + 1)) AS t(place) GROUP BY ALL
    ) GROUP BY part, entry
  ) m ON m.part = b.part AND m.entry = b.entry
),"""


ORACLE_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
subs AS (
  SELECT r, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS p FROM kept, unnest(range({PARTS})) AS t(part)
),
book0 AS (SELECT part, r AS entry, p AS e FROM subs WHERE r < {ENTRIES}),{"".join(map(_round_sql, range(ROUNDS)))}
last AS (
  SELECT s.r, s.part, min(CAST(list_dot_product(s.p, s.p) - 2 * list_dot_product(s.p, b.e) + list_dot_product(b.e, b.e) AS BIGINT) * {ENTRIES} + b.entry) AS best
  FROM subs s JOIN book{ROUNDS} b ON b.part = s.part GROUP BY s.r, s.part
),
codes AS (
  SELECT r, string_agg(lower(printf('%02x', best % {ENTRIES})), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM last GROUP BY r
),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, b.codebooks_sha256
FROM kept k JOIN codes c ON c.r = k.r, books b
"""
