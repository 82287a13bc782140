"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (a, b); a component is called by its smallest id.

    Each round takes the least label among the neighbours and then the label of that label, so
    the rounds grow with the logarithm of a component's diameter. State is written to the
    shared folder after each round, and the state before it removed. Loops only name their node;
    repeated edges count once; rows with a null end are left out; an empty table has no
    components. Joins are plain equi-joins, whose skewed keys (the label of a large component)
    adaptive execution splits.
    """
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    both = materialise(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    for _ in range(MAX_ROUNDS):
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("seen"))
        lower = labels.join(seen, "id").select("id", F.col("component").alias("old"), F.least("component", "seen").alias("lower"))
        onward = labels.select(F.col("id").alias("lower"), F.col("component").alias("next"))
        before, labels = labels, materialise(lower.join(onward, "lower").select("id", F.col("next").alias("component"), (F.col("next") != F.col("old")).alias("moved")), "labels")
        discard(before)
        if labels.where("moved").isEmpty():
            discard(both)
            return labels.select("id", "component")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def thinned(ties: DataFrame) -> DataFrame:
    """Edges (a, b) with the components of ``ties`` (id, lead), of which an id may have several.

    Each id goes to the least of its leads, and that one to the others, each pair once: where
    many ids share their leads, the edges are as many as the ids and a few more.
    """
    leads = ties.groupBy("id").agg(F.array_sort(F.collect_set("lead")).alias("leads"))
    own = leads.select(F.col("id").alias("a"), F.col("leads")[0].alias("b")).where("a <> b")
    among = leads.select(F.col("leads")[0].alias("a"), F.explode(F.slice("leads", 2, F.size("leads"))).alias("b")).distinct()
    return own.unionByName(among)
