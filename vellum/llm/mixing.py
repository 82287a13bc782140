"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent in [0, 1] and normalised: 1 keeps the
natural shares, 0 makes them equal. The exponent is found by bisection, so that the weights
reach a target entropy, or so that no source is repeated more often than a limit. The weights
are then realised against a budget of tokens: a source is read in epochs, each a permutation of
blocks of its documents and of the documents in a block, until its part of the budget is met.

Only per-source totals and per-block totals are aggregated; a document finds the tokens in front
of it from its block's offset and a running sum inside the block, so a source of any size is
spread over as many tasks as it has blocks. Sources too are only ever rows of tables: a step of
the bisection is an aggregate over their shares.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Entropy to reach, as a share of that of equal weights, and how often a source may be repeated.
ENTROPY_SHARE, MAX_REPEATS = 0.92, 4.0
#: Halvings of the exponent's interval that one job decides, and jobs.
LEVELS, ROUNDS = 6, 5
#: What the registered query asks for: nearly equal sources, and half as many tokens again as there are.
QUERY_ENTROPY, QUERY_BUDGET = 0.9999, 1.5


def _bisected(good_at: Callable[[list[float]], list[bool]]) -> tuple[float, float]:
    """The ends of [0, 1] after LEVELS * ROUNDS halvings that keep the lower end good, the upper not.

    ``good_at`` tells of several exponents at once; goodness only ever ends as they rise.
    """
    low, width = 0.0, 1.0
    for _ in range(ROUNDS):
        inner = [low + width * i / 2**LEVELS for i in range(1, 2**LEVELS)]
        low += width / 2**LEVELS * sum(good_at(inner))
        width /= 2**LEVELS
    return low, low + width


def temperature(tokens: DataFrame, budget_share: float = 1.0, entropy_share: float | None = ENTROPY_SHARE, max_repeats: float | None = MAX_REPEATS) -> float:
    """The exponent that is nearest to 1 and reaches the entropy, as far as the repetition limit allows.

    ``tokens``: source, tokens, one row for each source; ``budget_share``: the budget over all
    tokens. Entropy falls and repeats of small sources fall as the exponent rises, so both bounds
    are found by bisection over [0, 1]. Sources without tokens get no weight. Without a target
    entropy the limit alone decides; where even natural shares exceed it, they stay. Without
    tokens the exponent is 1.
    """
    there = tokens.where("tokens > 0")
    total = there.agg(F.sum("tokens").cast("double").alias("t"), F.count("*").alias("n")).first()
    if not total["n"]:
        return 1.0
    shares = materialise(there.select((F.col("tokens") / F.lit(total["t"])).alias("s")), "shares")

    def sums(exponents: list[float]) -> list:
        x = F.explode(F.array(*map(F.lit, exponents)))
        p = F.pow("s", F.col("x"))
        return shares.select("s", x.alias("x")).groupBy("x").agg(F.sum(p).alias("all"), F.sum(p * F.log("s")).alias("logs"), F.max(p / F.col("s")).alias("most")).orderBy("x").collect()  # a row an exponent

    def enough(exponents: list[float]) -> list[bool]:
        least = entropy_share * math.log(total["n"]) - 1e-12
        return [math.log(r["all"]) - r["x"] * r["logs"] / r["all"] >= least for r in sums(exponents)]

    def exceeds(exponents: list[float]) -> list[bool]:
        return [r["most"] / r["all"] * budget_share > max_repeats for r in sums(exponents)]

    exponent = 0.0
    if entropy_share is not None:
        exponent = 1.0 if enough([1.0])[0] else _bisected(enough)[0]
    if max_repeats is not None and exceeds([exponent])[0]:
        exponent = 1.0 if exceeds([1.0])[0] else _bisected(exceeds)[1]
    return exponent


def n_words(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space; a null text has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def _at(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]).cast("binary"))


def realise(docs: DataFrame, budget_share: float = 1.0, entropy_share: float | None = ENTROPY_SHARE, max_repeats: float | None = MAX_REPEATS) -> DataFrame:
    """doc_id, source, n_tokens, epoch, place, exponent, repeats: every document as often as the mixture reads it.

    ``docs``: doc_id, source, n_tokens, stored; other columns are ignored. A document without
    tokens takes no budget and is read once, in epoch 0. ``budget_share`` is the tokens to
    realise over those there are. A source stops at the document that reaches its part of the
    budget; ``place`` counts the source's tokens in front of a document, ``repeats`` is the
    source's part over its tokens. A null source is a source. Rows that tie in doc_id are put in
    an arbitrary order among themselves when they differ in tokens; each is read. Texts aren't
    looked at, so their length doesn't matter. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "source", "n_tokens")
    totals = materialise(docs.groupBy("source").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("n")), "totals")
    exponent = temperature(totals, budget_share, entropy_share, max_repeats)
    every = totals.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(every or 1)), F.lit(exponent))).otherwise(0.0)
    norm = totals.agg(F.sum(power).alias("x")).first()["x"] or 1.0
    part = F.floor(F.lit(budget_share * every) * power / F.lit(norm)).cast("long")
    sources = totals.select(
        F.col("source").alias("plan_source"), F.col("tokens").alias("there"), part.alias("part"),
        F.when(F.col("tokens") > 0, F.greatest(F.ceil(part / F.col("tokens")), F.lit(1))).otherwise(1).cast("long").alias("epochs"),
        (F.floor(F.sqrt("n")) + 1).cast("long").alias("blocks"),
    )
    dealt = docs.join(sources, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    dealt = dealt.withColumn("block", F.pmod(F.conv(F.substring(_at(F.col("doc_id")), 1, 8), 16, 10).cast("long"), "blocks"))
    dealt = dealt.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    # an epoch permutes blocks, and documents in each block, by digests of its number
    key = ["source", "epoch", "block"]
    sums = dealt.groupBy(*key).agg(F.sum("n_tokens").alias("block_tokens"), F.first("there").alias("there"))
    by_block = Window.partitionBy("source", "epoch").orderBy(_at(F.col("block"), F.col("epoch")), "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("o_source"), F.col("epoch").alias("o_epoch"), F.col("block").alias("o_block"),
        (F.coalesce(F.sum("block_tokens").over(by_block), F.lit(0)) + F.col("epoch") * F.col("there")).alias("offset"),
    )
    in_block = Window.partitionBy(*key).orderBy(_at(F.col("doc_id"), F.col("epoch"), F.lit("doc")), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("n_tokens").over(in_block), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("epoch") == F.col("o_epoch")) & (F.col("block") == F.col("o_block")))
    placed = placed.withColumn("place", F.col("offset") + F.col("inside"))
    read = ((F.col("n_tokens") > 0) & (F.col("place") < F.col("part"))) | ((F.col("n_tokens") == 0) & (F.col("epoch") == 0))
    repeats = F.round(F.col("part") / F.greatest("there", F.lit(1)), 6)
    return placed.where(read).select("doc_id", "source", "n_tokens", "epoch", "place", F.lit(round(exponent, 6)).alias("exponent"), repeats.alias("repeats"))


def counted(docs: DataFrame) -> DataFrame:
    """What :func:`realise` needs of documents, stored: doc_id, source, n_tokens."""
    return materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("n_tokens")), "counted")


def mixed(docs: DataFrame, budget_share: float = 1.0, entropy_share: float | None = ENTROPY_SHARE, max_repeats: float | None = MAX_REPEATS) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mixture reads it.

    Rows that share a doc_id and a source are read equally often: as often as the most read of
    them. Nulls, ties and empty tables are as in :func:`realise`; texts of any length are only
    counted and carried.
    """
    often = realise(counted(docs), budget_share, entropy_share, max_repeats).groupBy("doc_id", "source", "epoch").agg(F.count("*").alias("n"))
    often = often.groupBy(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source")).agg(F.count("epoch").alias("times"))
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = row.join(often, F.col("row.doc_id").eqNullSafe(F.col("m_id")) & F.col("row.source").cast("string").eqNullSafe(F.col("m_source")))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def op5_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source to nearly equal weights, with a budget beyond the tokens there are."""
    return realise(counted(table(spark, sf_dir, "documents")), QUERY_BUDGET, QUERY_ENTROPY, MAX_REPEATS)


#: Entropy and the largest repetition at exponent x are lateral aggregates over the shares ``p``.
_ENTROPY = f"(SELECT ln(sum(pow(share, {{x}}))) - {{x}} * sum(pow(share, {{x}}) * ln(share)) / sum(pow(share, {{x}})) FROM p) >= {QUERY_ENTROPY} * (SELECT ln(count(*)) FROM p) - 1e-12"
_ALLOWED = f"(SELECT max(pow(share, {{x}}) / share) / sum(pow(share, {{x}})) FROM p) * {QUERY_BUDGET} <= {MAX_REPEATS}"

ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS n_tokens FROM documents
),
t AS (SELECT source, sum(n_tokens) AS tokens, count(*) AS n FROM d GROUP BY source),
p AS (SELECT source, CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM t) AS share FROM t WHERE tokens > 0),
e(i, low, high) AS (
  SELECT 0, CASE WHEN {_ENTROPY.format(x="1.0")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN middle ELSE low END, CASE WHEN good THEN high ELSE middle END
  FROM (SELECT i, low, high, (low + high) / 2 AS middle, {_ENTROPY.format(x="((low + high) / 2)")} AS good FROM e WHERE i < {LEVELS * ROUNDS})
),
first_ AS (SELECT low AS x FROM e WHERE i = {LEVELS * ROUNDS}),
r(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN low ELSE middle END, CASE WHEN good THEN middle ELSE high END
  FROM (SELECT i, low, high, (low + high) / 2 AS middle, {_ALLOWED.format(x="((low + high) / 2)")} AS good FROM r WHERE i < {LEVELS * ROUNDS})
),
a AS (SELECT CASE WHEN {_ALLOWED.format(x="x")} THEN x ELSE (SELECT high FROM r WHERE i = {LEVELS * ROUNDS}) END AS x FROM first_),
plan AS (
  SELECT t.source, t.tokens AS there, CAST(floor(isqrt) AS BIGINT) + 1 AS blocks, round(a.x, 6) AS exponent,
         CAST(floor({QUERY_BUDGET} * (SELECT sum(tokens) FROM t) * coalesce(pow(share, x) / (SELECT sum(pow(share, a.x)) FROM p, a), 0)) AS BIGINT) AS part
  FROM (SELECT *, sqrt(n) AS isqrt FROM t) t LEFT JOIN p ON p.source IS NOT DISTINCT FROM t.source, a
),
dealt AS (
  SELECT doc_id, d.source, n_tokens, there, part, exponent, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 8)) AS BIGINT) % blocks AS block,
         unnest(range(0, greatest(CASE WHEN there > 0 THEN CAST(ceil(part / there) AS BIGINT) ELSE 1 END, 1))) AS epoch
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
),
sums AS (SELECT source, epoch, block, sum(n_tokens) AS s, any_value(there) AS there FROM dealt GROUP BY ALL),
offsets AS (
  SELECT source, epoch, block, epoch * there + coalesce(sum(s) OVER (PARTITION BY source, epoch ORDER BY md5(block || ':' || epoch), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_place FROM sums
),
placed AS (
  SELECT d.*, first_place + coalesce(sum(n_tokens) OVER (
    PARTITION BY d.source, d.epoch, d.block ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || d.epoch || ':doc'), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM dealt d JOIN offsets o ON o.source IS NOT DISTINCT FROM d.source AND o.epoch = d.epoch AND o.block = d.block
)
SELECT doc_id, source, n_tokens, epoch, CAST(place AS BIGINT) AS place, exponent, round(part / greatest(there, 1), 6) AS repeats FROM placed WHERE (n_tokens > 0 AND place < part) OR (n_tokens = 0 AND epoch = 0)
"""
