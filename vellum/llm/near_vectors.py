"""Near-duplicate vectors by product quantisation, with no true pair left out.

Vectors are put to unit length; a cosine of at least t is a distance of at most
r = sqrt(2 - 2t). Coarse centroids and the codebooks of the residuals are fitted on a bounded
sample; every vector is indexed. Lists have two levels: coarse cells, each with fine cells of its
own. Lists that are too long for these are divided again, level by level, in tasks. A query probes
each list whose border it is within r of, at every level, and in a list it
keeps what the table lookup puts within r plus that vector's own quantisation error. All these
tests are necessary for a true pair, so the exact cosine that follows sees them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .graph import connected_components

MIN_COSINE = 0.98
#: Vectors that centroids and codebooks are fitted on: eight for each list, at least and at most.
MIN_SAMPLE, SAMPLE = 20_000, 100_000
#: Vectors that a list should hold. The sample gives SAMPLE / 8 lists at most; what is beyond that makes them longer.
LIST_SIZE = 400
SUBSPACES, CODES = 16, 64
#: Rows of a list, and queries to it, that one task compares at a time. Longer lists are divided.
BLOCK = 4096
#: Cells that a long list is divided into at a time, and rows that their centres are fitted on.
FANOUT, CELL_SAMPLE = 64, 1024
#: What share of a list's rows a query may still meet after a division that is worth it.
WORTH = 0.25
_EPS = 1e-5


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        nearest = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + 8192], centres).argmin(1) for i in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two, so that squares neither overflow nor vanish; cosines stay the same to the bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _gaps(centres: np.ndarray) -> np.ndarray:
    gaps = np.sqrt(_squares(centres, centres))
    return np.where(gaps > 0, gaps, np.inf)


def _within(d: np.ndarray, gaps: np.ndarray, radius: float) -> np.ndarray:
    """Which cells may hold a vector within ``radius`` of each row, given its squared distances to their centres.

    A vector in another cell than the row's own lies beyond the plane halfway between the two
    centres, so the distance to that plane bounds the distance to it.
    """
    own = d.argmin(1)
    return (d - d[np.arange(len(d)), own][:, None]) / (2 * gaps[own]) <= radius + _EPS


class Quantiser:
    """Coarse and fine centroids, and codebooks of the residuals' subspaces, for one dimension."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        dim = sample.shape[1]
        self.coarse = _kmeans(sample, max(1, round(lists**0.5)), 8, seed)
        cell = _nearest(sample, self.coarse)
        each = -(-lists // len(self.coarse))
        self.fine = [_kmeans(sample[cell == i], each, 8, seed + i) if (cell == i).any() else self.coarse[i : i + 1] for i in range(len(self.coarse))]
        self.first = np.cumsum([0] + [len(f) for f in self.fine])
        self.centres = np.concatenate(self.fine)
        self.coarse_gaps, self.fine_gaps = _gaps(self.coarse), [_gaps(f) for f in self.fine]
        residuals = sample - self.centres[self.lists(sample)]
        self.parts = np.array_split(np.arange(dim), min(SUBSPACES, dim))
        self.books = [_kmeans(residuals[:, p], CODES, 6, seed + 1 + i) for i, p in enumerate(self.parts)]

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The list of each row: the nearest fine cell of the nearest coarse cell."""
        cell, out = _nearest(x, self.coarse), np.zeros(len(x), np.int64)
        for i in np.unique(cell):
            mine = np.flatnonzero(cell == i)
            out[mine] = self.first[i] + _nearest(x[mine], self.fine[i])
        return out

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantisation error of each row."""
        lists = self.lists(x)
        residuals = x - self.centres[lists]
        codes = np.stack([_nearest(residuals[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)
        return lists, codes, np.sqrt(((residuals - self.decode(codes)) ** 2).sum(1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of every list that may hold a vector within ``radius`` of a row."""
        rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            cells = _within(_squares(part, self.coarse), self.coarse_gaps, radius)
            for c in np.flatnonzero(cells.any(0)):
                mine = np.flatnonzero(cells[:, c])
                row, found = np.nonzero(_within(_squares(part[mine], self.fine[c]), self.fine_gaps[c], radius))
                rows.append(mine[row] + i)
                lists.append(found + self.first[c])
        return np.concatenate(rows), np.concatenate(lists)

    def lookups(self, queries: np.ndarray, at: int) -> list[np.ndarray]:
        """Squared distances of the queries' residuals to list ``at`` to every code, by subspace."""
        residuals = queries - self.centres[at]
        return [_squares(residuals[:, p], b) for p, b in zip(self.parts, self.books, strict=True)]


_KEY = ["label", "dim", "list", "cell"]
_CELLS = "label int, dim int, list int, cell long, centres binary"
_INDEXED = "label int, dim int, list int, cell long, is_query boolean, id long, copies long, vector array<double>, codes binary, error double"
_NAMES = [x.split()[0] for x in _INDEXED.split(", ")]
_FOUND = "id long, links long, other long"


def _join_in_list(part: pd.DataFrame, quantiser: Quantiser, min_cosine: float, radius: float) -> pd.DataFrame:
    """Links of one block of queries to one block of a list; per query the count, and a forest of the links."""
    nothing = pd.DataFrame({"id": [], "links": [], "other": []}).astype("int64")
    is_query = part["is_query"].to_numpy(bool)
    rows, queries = part[~is_query], part[is_query]
    if rows.empty or queries.empty:
        return nothing
    x, q = _scaled(np.stack(rows["vector"].to_numpy())), _scaled(np.stack(queries["vector"].to_numpy()))
    xn, qn = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    x_ids, q_ids, copies = rows["id"].to_numpy(np.int64), queries["id"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64)
    codes = np.stack([np.frombuffer(c, np.uint8) for c in rows["codes"]])
    reach = (radius + rows["error"].to_numpy(float) + _EPS) ** 2
    at = int(part["list"].iloc[0])
    ids = np.unique(np.concatenate([x_ids, q_ids]))
    root, links = ids.copy(), np.zeros(len(q_ids), np.int64)
    for i in range(0, len(q), 512):
        tables = quantiser.lookups(q[i : i + 512] / qn[i : i + 512, None], at)
        near = np.zeros((len(tables[0]), len(x)))
        for m, t in enumerate(tables):
            near += t[:, codes[:, m]]
        a, b = np.nonzero(near <= reach[None])
        a += i
        exact = np.concatenate([np.einsum("ij,ij->i", q[a[j : j + 65536]], x[b[j : j + 65536]]) for j in range(0, len(a), 65536)] or [np.zeros(0)]) / (qn[a] * xn[b])
        true = (exact >= min_cosine) & (q_ids[a] != x_ids[b])
        a, b = a[true], b[true]
        links += np.bincount(a, weights=copies[b], minlength=len(q_ids)).astype(np.int64)
        left, right = np.searchsorted(ids, q_ids[a]), np.searchsorted(ids, x_ids[b])
        while True:  # least id that each can reach by the links so far
            low = np.minimum(root[left], root[right])
            before = root.copy()
            np.minimum.at(root, left, low)
            np.minimum.at(root, right, low)
            root = np.minimum(root, root[np.searchsorted(ids, root)])
            if (root == before).all():
                break
    q_root, x_root = root[np.searchsorted(ids, q_ids)], root[np.searchsorted(ids, x_ids)]
    joined = x_root != x_ids
    return pd.DataFrame({"id": np.concatenate([q_ids[links > 0], x_ids[joined]]), "links": np.concatenate([links[links > 0], np.zeros(joined.sum(), np.int64)]), "other": np.concatenate([q_root[links > 0], x_root[joined]])})


def _fit_cells(part: pd.DataFrame, radius: float) -> pd.DataFrame:
    """Centres of a list's cells, from some of its rows; no row where the rows lie too close together to be told apart by cells."""
    x = _unit(np.stack(part["vector"].to_numpy()))
    centres = _kmeans(x, FANOUT, 6, 7)
    share = np.bincount(_nearest(x, centres), minlength=len(centres)) / len(x)
    met = (_within(_squares(x, centres), _gaps(centres), radius) @ share).mean()
    return part[_KEY].head(1 if met <= WORTH else 0).assign(centres=centres.tobytes())


def _deal_cells(part: pd.DataFrame, cells: pd.DataFrame, radius: float) -> pd.DataFrame:
    """Rows of a list in the cell that they belong to, queries in each whose border they are within ``radius`` of."""
    x = _unit(np.stack(part["vector"].to_numpy()))
    centres = np.frombuffer(cells["centres"].iloc[0]).reshape(-1, x.shape[1])
    d = _squares(x, centres)
    met = _within(d, _gaps(centres), radius)
    rows = np.flatnonzero(~part["is_query"].to_numpy(bool))
    met[rows] = False
    met[rows, d[rows].argmin(1)] = True
    at, cell = np.nonzero(met)
    # as in a heap, so that no two cells of a list share a number, whatever their level
    return part.iloc[at].assign(cell=part["cell"].to_numpy(np.int64)[at] * FANOUT + cell + 1)[_NAMES]


def _divided(indexed: DataFrame, radius: float) -> DataFrame:
    """``indexed`` with the lists of more than BLOCK rows divided into cells, and these again, as long as that is worth it.

    Centres are fitted on about CELL_SAMPLE rows of a list, chosen by a hash, in a task for each
    list; a list's rows are dealt to its cells by pieces of about BLOCK rows, so no task holds a
    list. Centres travel to the pieces of their own list only. A division at least halves the
    largest cell of its sample. What can't be divided stays one list, compared block by block.
    """
    settled = []
    for level in range(10):  # 64 cells a level: numbers stay below 2**63
        sizes = indexed.groupBy(_KEY).agg(F.count_if(~F.col("is_query")).alias("n_rows"), F.count("*").alias("n")).where(F.col("n_rows") > BLOCK)
        long = indexed.join(sizes, _KEY)
        chosen = long.where(~F.col("is_query")).where(F.pmod(F.xxhash64("id", F.lit(level)), F.ceil(F.col("n_rows") / CELL_SAMPLE)) == 0)
        fit = lambda part: _fit_cells(part, radius)
        cells = materialise(chosen.select(*_KEY, "vector").groupBy(_KEY).applyInPandas(fit, _CELLS), "cells")
        if cells.isEmpty():
            break
        settled.append(indexed.join(cells.select(_KEY), _KEY, "left_anti"))
        pieces = F.ceil(F.col("n") / BLOCK)
        dealt = long.join(cells.select(_KEY), _KEY, "left_semi").withColumn("piece", F.pmod(F.xxhash64("id"), pieces)).select(*_NAMES, "piece")
        sent = cells.join(sizes, _KEY).select(*cells.columns, F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
        deal = lambda part, own: _deal_cells(part, own, radius) if len(part) else part[_NAMES]
        indexed = materialise(dealt.groupBy(*_KEY, "piece").cogroup(sent.groupBy(*_KEY, "piece")).applyInPandas(deal, _INDEXED), "index")
    return reduce(DataFrame.unionByName, settled, indexed)


def near_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Only vectors of the same label and dimension are compared. Those that are null, empty, zero
    or hold a null or non-finite component, and those without a label, link with nothing and
    are a component of their own. Equal vectors of a label are one class that is compared once
    and whose members all link with each other, so a group of copies costs no more than one
    vector. Repeated rows are vectors of their own (also those with the same id). Components of
    any finite size are sound. An empty table gives an empty result; other columns are ignored.
    """
    radius = float(np.sqrt(2 - 2 * min_cosine))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    sound = F.coalesce(
        F.col("label").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("vector", lambda v: v != 0.0)
        & F.col("vec_id").isNotNull(),
        F.lit(False),
    )
    classes = materialise(
        rows.where(sound)
        .groupBy("label", "vector")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumns({"dim": F.size("vector"), "id": F.monotonically_increasing_id()}),
        "vectors",
    )  # stored with numbers of our own, because different vectors may share a vec_id
    quantisers: dict[int, Quantiser] = {}
    for r in classes.groupBy("dim").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).collect():  # one row for each dimension
        lists = int(np.clip(r["n"] // (LIST_SIZE * r["labels"]), 1, SAMPLE // 8))
        sample = classes.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("least", "vector"), "least", "vector").select("vector").limit(max(MIN_SAMPLE, 8 * lists)).toPandas()
        quantisers[r["dim"]] = Quantiser(_unit(np.stack(sample["vector"].to_numpy())), lists)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                quantiser = quantisers[dim]
                x = _unit(np.stack(part["vector"].to_numpy()))
                lists, codes, errors = quantiser.encode(x)
                yield part.assign(list=lists, cell=0, is_query=False, codes=[c.tobytes() for c in codes], error=errors)[_NAMES]
                at, probed = quantiser.probes(x, radius)
                for i in range(0, len(at), 20_000):
                    yield part.iloc[at[i : i + 20_000]].assign(list=probed[i : i + 20_000], cell=0, is_query=True, codes=None, error=None)[_NAMES]

    indexed = _divided(materialise(classes.mapInPandas(index, _INDEXED), "index"), radius)
    blocks = (
        indexed.groupBy(_KEY)
        .agg(F.count_if(~F.col("is_query")).alias("n_rows"), F.count_if("is_query").alias("n_queries"))
        .where("n_rows > 0")
        .select(*_KEY, F.ceil(F.col("n_rows") / BLOCK).alias("row_blocks"), F.ceil(F.col("n_queries") / BLOCK).alias("query_blocks"))
    )
    tasks = (
        indexed.join(blocks, _KEY)
        .withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("is_query"), F.col("query_blocks")).otherwise(F.col("row_blocks"))))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.when(F.col("is_query"), F.col("row_blocks")).otherwise(F.col("query_blocks")) - 1)))
        .withColumn("row_block", F.when(F.col("is_query"), F.col("block")).otherwise(F.col("own")))
        .withColumn("query_block", F.when(F.col("is_query"), F.col("own")).otherwise(F.col("block")))
        .select(*indexed.columns, "row_block", "query_block")
    )
    join = lambda part: _join_in_list(part, quantisers[int(part["dim"].iloc[0])], min_cosine, radius)
    found = materialise(tasks.groupBy(*_KEY, "row_block", "query_block").applyInPandas(join, _FOUND), "links")
    components = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = components.join(classes.select("id", "least"), "id")
    named = named.select("id", "component").join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").drop("component")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    settled = (
        classes.join(links, "id", "left")
        .join(named, "id", "left")
        .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        rows.where(sound)
        .join(settled, ["label", "vector"])
        .select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op10_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors of each label."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
),
ok AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
),
reach(id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.id, p.b FROM reach r JOIN pairs p ON p.a = r.other
),
least_id AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM v JOIN least_id l ON l.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
