"""A stored graph for nearest vectors: each block of a tenant's vectors is a graph that a search walks with a beam.

A vector is linked to its nearest in the block, they to it, and to a few far ones, so that a walk
from a handful of entries comes near any query in few steps. What a search costs in a block grows
with the beam and not with the block; the blocks' best are merged.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Folder
from .retrieval import BLOCK_QUERIES, top

#: Vectors of a block, near links and far links of each, and what a search begins from and carries along.
BLOCK, NEAR, FAR, ENTRIES, BEAM = 4096, 16, 4, 64, 64


def links_of(unit: np.ndarray, near: int = NEAR, far: int = FAR, seed: int = 5) -> np.ndarray:
    """Links of every row, as a matrix filled up with the row itself: its nearest, those it is nearest to (as many again), the next row, and some drawn ones.

    The next row makes the graph one: what carries everything along reaches everything.
    """
    n = len(unit)
    rng, own = np.random.default_rng(seed), np.arange(n)
    k = min(near, n - 1)
    nearest = np.zeros((n, k), np.int64)
    for i in range(0, n if k else 0, 512):
        sims = unit[i : i + 512] @ unit.T
        sims[np.arange(len(sims)), own[i : i + 512]] = -np.inf
        nearest[i : i + 512] = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    back = np.repeat(own[:, None], near, axis=1)
    order = np.argsort(nearest.ravel(), kind="stable")
    to, by = nearest.ravel()[order], np.repeat(own, k)[order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    back[to[place < near], place[place < near]] = by[place < near]
    drawn = rng.integers(0, n, (n, far))
    return np.concatenate([nearest, back, drawn, ((own + 1) % n)[:, None]], axis=1).astype(np.int32)


def walk(unit: np.ndarray, links: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each unit query the rows of ``unit`` that a walk with a beam ends with, best first, their products, and how many products it took in all.

    The beam holds the best that were seen; its best row whose links weren't looked at is next,
    until there is none. All queries walk at once. A beam of all rows drops none, so whatever
    the way it ends with all of them: their products are taken at once.
    """
    n, m = len(unit), len(queries)
    if beam >= n:
        sims = queries @ unit.T
        rows = np.argsort(-sims, axis=1, kind="stable")
        return rows, np.take_along_axis(sims, rows, 1), m * n
    entry = np.unique(np.linspace(0, n - 1, min(max(ENTRIES, 1), n)).astype(np.int64))
    width = min(beam, n)
    seen = np.zeros((m, n), bool)
    seen[:, entry] = True
    rows = np.repeat(entry[None], m, axis=0)
    sims, done, looked = queries @ unit[entry].T, np.zeros(rows.shape, bool), m * len(entry)
    live = np.arange(m)
    while True:
        order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        rows, sims, done = (np.take_along_axis(x, order, 1) for x in (rows, sims, done))
        open_ = ~done & (rows >= 0)
        live = np.flatnonzero(open_.any(1))
        if not len(live):
            return rows, sims, looked
        at = open_[live].argmax(1)
        done[live, at] = True
        met = links[rows[live, at]]
        new = ~seen[live[:, None], met]
        found = np.full((m, met.shape[1]), -1, np.int64)
        values = np.full((m, met.shape[1]), -np.inf)
        # a row that is met twice at once counts once
        first = np.sort(met, axis=1)
        if (first[:, 1:] == first[:, :-1]).any():
            for i, row in enumerate(met):
                _, once = np.unique(row, return_index=True)
                keep = np.zeros(len(row), bool)
                keep[once] = True
                new[i] &= keep
        a, b = np.nonzero(new)
        seen[live[a], met[a, b]] = True
        found[live[a], b] = met[a, b]
        values[live[a], b] = np.einsum("ij,ij->i", queries[live[a]], unit[met[a, b]])
        looked += len(a)
        rows, sims, done = np.concatenate([rows, found], 1), np.concatenate([sims, values], 1), np.concatenate([done, found < 0], 1)


def _sound(column: str):
    double = F.col(column).cast("array<double>")
    return F.col("tenant").isNotNull() & F.coalesce(F.forall(double, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(double, lambda v: v != 0), F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    x /= np.abs(x).max(1)[:, None]  # squares stay finite
    return x / np.sqrt((x * x).sum(1))[:, None]


class GraphIndex:
    """Graphs below ``path``. Each :meth:`add` makes blocks of its own; what is there isn't touched, and a search sees what was complete when it was planned."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._parts = Folder(spark, f"{self.path}/parts")

    def add(self, vectors: DataFrame) -> None:
        """Add (id, tenant, vector). Ids are whole numbers. Vectors that are null, zero or hold a null or non-finite component are nobody's neighbours and left out.

        A tenant's vectors of a size are dealt to blocks of about ``BLOCK``; every row is one of its own.
        Single precision is stored as it is; all is computed in double precision.
        """
        numbers = "array<float>" if dict(vectors.dtypes)["vector"] == "array<float>" else "array<double>"
        rows = vectors.where(_sound("vector")).select("id", "tenant", F.col("vector").cast(numbers).alias("vector")).withColumn("size", F.size("vector"))
        blocks = rows.groupBy("tenant", "size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = rows.join(blocks, ["tenant", "size"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

        def linked(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("id")
            return part.assign(place=np.arange(len(part)), links=list(links_of(_unit(part["vector"]))))[["tenant", "size", "block", "place", "id", "vector", "links"]]

        kind = dict(vectors.dtypes)["tenant"]
        name = uuid.uuid4().hex
        made = dealt.groupBy("tenant", "size", "block").applyInPandas(linked, f"tenant {kind}, size int, block int, place int, id long, vector {numbers}, links array<int>")
        made.write.parquet(f"{self.path}/graphs/{name}")
        self._parts.put(f"{name}.json", "{}")

    def nearest(self, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
        """query_id, id, similarity, rank: about the ``k`` nearest of the query's tenant by cosine; all of them where ``beam`` is as large as a block.

        ``queries``: query_id, tenant, vector. Equal similarities go by id among what was found.
        """
        names = [n.removesuffix(".json") for n in self._parts.names()]
        if not names:
            return queries.where(F.lit(False)).select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
        parts = [self.spark.read.parquet(f"{self.path}/graphs/{n}").withColumn("part", F.lit(i)) for i, n in enumerate(names)]
        if len({dict(p.dtypes)["vector"] for p in parts}) > 1:
            parts = [p.withColumn("vector", F.col("vector").cast("array<double>")) for p in parts]
        graphs = parts[0]
        for p in parts[1:]:
            graphs = graphs.unionByName(p)
        asked = queries.where(_sound("vector")).select("query_id", F.col("tenant").alias("q_tenant"), F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("q_size"))
        dealt = asked.groupBy("q_tenant", "q_size").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("q_blocks"))
        blocks = graphs.select("tenant", "size", "part", "block").distinct().join(dealt, (F.col("tenant") == F.col("q_tenant")) & (F.col("size") == F.col("q_size"))).select("tenant", "size", "part", "block", "q_blocks")
        key = ["tenant", "size", "part", "block", "q_block"]
        every = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q_block"))
        left = graphs.join(every, ["tenant", "size", "part", "block"]).select(*key, "place", "id", "vector", "links")
        mine = asked.join(dealt, ["q_tenant", "q_size"]).withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int"))
        right = mine.drop("q_blocks").withColumnsRenamed({"q_tenant": "tenant", "q_size": "size"}).join(every.drop("q_blocks"), ["tenant", "size", "q_block"]).select(*[F.col(c).alias(f"of_{c}") for c in key], "query_id", "vector")

        def search(rows: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if rows.empty or q.empty:
                return pd.DataFrame({"query_id": q["query_id"].iloc[:0], "id": rows["id"].iloc[:0], "similarity": np.zeros(0)})
            rows = rows.sort_values("place")
            unit, links, ids = _unit(rows["vector"]), np.stack(rows["links"].to_numpy()), rows["id"].to_numpy()
            out = []
            for i in range(0, len(q), 256):
                part = q.iloc[i : i + 256]
                found, sims, _ = walk(unit, links, _unit(part["vector"]), max(beam, k))
                sims = np.round(sims, 6)
                # best come first: what is below the k-th isn't among the best; equals go by their ids
                who, at = np.nonzero((found >= 0) & (sims >= sims[:, min(k, sims.shape[1]) - 1][:, None]))
                best = pd.DataFrame({"query_id": part["query_id"].to_numpy()[who], "id": ids[found[who, at]], "similarity": sims[who, at]})
                best = best.sort_values(["similarity", "id"], ascending=[False, True])
                out.append(best[best.groupby("query_id").cumcount() < k])
            return pd.concat(out)

        met = left.groupBy(*key).cogroup(right.groupBy(*[f"of_{c}" for c in key])).applyInPandas(search, f"query_id {dict(queries.dtypes)['query_id']}, id long, similarity double")
        return top(met, "query_id", [F.desc("similarity"), F.asc("id")], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: neighbours there are, and the share of them that was found."""
    hit = found.select("query_id", "id").withColumn("hit", F.lit(1))
    return exact.join(hit, ["query_id", "id"], "left").agg(F.count("*").alias("neighbours"), F.round(F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*"), 6).alias("recall"))
