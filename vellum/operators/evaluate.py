"""Evaluation of retrieval and answers, feedback, and metrics. What wasn't measured is null, but for the hit rate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def first_relevant(hits: DataFrame) -> DataFrame:
    """query_id, first rank whose content has any keyword, or null. ``hits``: query_id, rank, content, keywords."""
    has = F.exists("keywords", lambda k: F.contains(F.col("content"), k))
    return hits.groupBy("query_id").agg(F.min(F.when(has, F.col("rank"))).alias("first"))


def recall(cases: DataFrame, first: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """k, n_cases, recall: the share of cases with a relevant hit among the first k."""
    found = cases.select("query_id").join(first, "query_id", "left").crossJoin(F.broadcast(cases.sparkSession.createDataFrame([(k,) for k in cuts], "k int")))  # len(cuts) rows
    return found.groupBy("k").agg(F.count("*").alias("n_cases"), F.round(F.avg(F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).cast("double")), 6).alias("recall"))


def hit_rate(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """n_cases, hit_rate: cases whose hits, joined together, hold any keyword. Refusal cases don't count; none gives 0."""
    joined = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "").alias("all"))  # k entries a query
    rows = cases.where(~F.col("expect_refusal")).join(joined, "query_id", "left")
    has = F.coalesce(F.exists("keywords", lambda k: F.contains(F.col("all"), k)), F.lit(False))
    return rows.agg(F.count("*").alias("n_cases"), F.round(F.coalesce(F.avg(has.cast("double")), F.lit(0.0)), 6).alias("hit_rate"))


def refusals(cases: DataFrame) -> DataFrame:
    """checked, total, accuracy of refusal cases (expect_refusal, refused; refused is null where nothing was retrieved or judged)."""
    rows = cases.where("expect_refusal")
    return rows.agg(F.count("refused").alias("checked"), F.count("*").alias("total"), F.round(F.avg(F.col("refused").cast("double")), 6).alias("accuracy"))


def scan_cuts(cases: DataFrame, hits: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """k, hit_rate, mean_top: for several cuts the share of cases with a relevant hit, and the mean similarity of the first hit over all cases."""
    first = first_relevant(hits)
    best = hits.where("rank = 1").select("query_id", "similarity")
    rows = cases.select("query_id").join(first, "query_id", "left").join(best, "query_id", "left")
    found = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.col("first") <= k, F.lit(False)).cast("double").alias("hit")) for k in cuts])
    return rows.select("similarity", F.explode(found).alias("x")).groupBy("x.k").agg(F.round(F.avg("x.hit"), 6).alias("hit_rate"), F.round(F.avg("similarity"), 6).alias("mean_top"))


def compare_modes(cases: DataFrame, by_mode: dict[str, DataFrame], cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """mode, k, recall for the hits of each mode."""
    runs = [recall(cases, first_relevant(hits), cuts).select(F.lit(mode).alias("mode"), "k", "recall") for mode, hits in by_mode.items()]
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def averages(scores: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """n, judged, average over those judged (null if none)."""
    g = scores.groupBy(*group) if group else scores
    return g.agg(F.count("*").alias("n"), F.count(value).alias("judged"), F.round(F.avg(value), 6).alias("average"))


def against_previous(runs: DataFrame, by: str, order: str, values: list[str]) -> DataFrame:
    """Runs with the change of each value since the run before them of the same ``by``, where both have it."""
    w = Window.partitionBy(by).orderBy(order)
    return runs.select("*", *[F.round(F.col(v) - F.lag(v).over(w), 4).alias(f"{v}_delta") for v in values])


def feedback_stats(log: DataFrame) -> DataFrame:
    """tenant, n, average (2 digits), negative (rating at most 2) and its rate (4 digits). No tenant counts as default."""
    tenant = F.coalesce(F.nullif("tenant", F.lit("")), F.lit("default")).alias("tenant")
    negative = F.count_if(F.col("rating") <= 2)
    return log.groupBy(tenant).agg(F.count("*").alias("n"), F.round(F.avg("rating"), 2).alias("average"), negative.alias("negative"), F.round(negative / F.count("*"), 4).alias("negative_rate"))


def counters(log: DataFrame, labels: list[str]) -> DataFrame:
    return log.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(log: DataFrame, value: str, buckets: list[float], labels: list[str]) -> DataFrame:
    """Per labels and bound the number of values at most that (cumulative), and at the bound null all of them."""
    sums = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    wide = log.where(F.col(value).isNotNull()).groupBy(*labels).agg(*sums, F.count("*").alias("all"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)], F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))
    return wide.select(*labels, F.explode(rows).alias("x")).select(*labels, "x.le", "x.n")


def last_value(log: DataFrame, value: str, order: Column, labels: list[str]) -> DataFrame:
    return log.groupBy(*labels).agg(F.max_by(value, order).alias("last"))


def expected(text: Column, any_of: Column, none_of: Column) -> Column:
    """Whether a text holds any of ``any_of`` (or that is empty) and none of ``none_of``; the latter wins. A null text is empty."""
    words = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    holds = lambda c: F.exists(words(c), lambda w: F.contains(F.coalesce(text, F.lit("")), w))
    return ((F.size(words(any_of)) == 0) | holds(any_of)) & ~holds(none_of)


def probe_verdicts(probes: DataFrame, answers: DataFrame, memories: DataFrame) -> DataFrame:
    """``probes`` (step, kind, expect_any, expect_none, memory_any, memory_none) with ``passed``.

    A probe of kind "check" is judged by the answer to its step (``answers``: step, text); if
    that passes, by all that is stored then (``memories``: step, text). Other kinds pass.
    """
    stored = memories.groupBy("step").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("stored"))  # one user's memories
    rows = probes.join(answers.select("step", F.col("text").alias("said")), "step", "left").join(stored, "step", "left")
    good = expected(F.col("said"), F.col("expect_any"), F.col("expect_none")) & expected(F.col("stored"), F.col("memory_any"), F.col("memory_none"))
    return rows.withColumn("passed", (F.col("kind") != "check") | good).drop("said", "stored")


def growth(counts: DataFrame) -> DataFrame:
    """step, memories_before, memories_after of ordered counts (user, step, memories): what a step began with and left."""
    w = Window.partitionBy("user").orderBy("step")
    return counts.select("user", "step", F.coalesce(F.lag("memories").over(w), F.lit(0)).alias("memories_before"), F.col("memories").alias("memories_after"))


def sizes(tables: dict[str, tuple[DataFrame, str | None, str | None]]) -> DataFrame:
    """name, owner, n: how many rows, or distinct keys, each table holds, by owner where it has one.

    ``tables``: by name a table, its owner's column and its key's column, either of which may be None.
    """
    parts = []
    for name, (df, owner, key) in tables.items():
        n = F.count_distinct(key) if key else F.count("*")
        whose = F.col(owner).cast("string") if owner else F.lit(None).cast("string")
        parts.append(df.groupBy(whose.alias("owner")).agg(n.alias("n")).select(F.lit(name).alias("name"), "owner", "n"))
    return reduce(DataFrame.unionByName, parts)


def metrics(tables: dict[str, tuple[DataFrame, list[str], str]]) -> DataFrame:
    """metric, labels, value: tables of counts and values (by name: table, label columns, value column) as one."""
    line = lambda labels: F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in labels])
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("metric"), line(labels).alias("labels"), F.col(value).cast("double").alias("value")) for name, (df, labels, value) in tables.items()])


def probe_rates(results: DataFrame) -> DataFrame:
    """dimension, n, rate over the probes (kind "check"), null if none was judged; and the share of steps that should store nothing (kind "no_memory") and did."""
    check = F.col("kind") == "check"
    return results.groupBy("dimension").agg(
        F.count_if(check).alias("n"),
        F.round(F.avg(F.when(check, F.col("passed").cast("double"))), 6).alias("rate"),
        F.round(F.avg(F.when(F.col("kind") == "no_memory", (F.col("memories_after") > F.col("memories_before")).cast("double"))), 6).alias("false_memory_rate"),
    )
