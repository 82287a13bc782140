"""What depends on everything before it in time, over logs of any length: as-of joins, and caches with a bound on all keys together.

Rows are cut into ranges of time. What a range hands on is small (the last value of a key, the
keys touched last), so it is worked out for all ranges at once and each range is then gone
through on its own: neither a hot key nor the log as a whole is one task.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .fold import keyed_fold


def asof(left: DataFrame, right: DataFrame, by: list[str], order: str, values: list[str], appended: str | None = None, strict: bool = True) -> DataFrame:
    """``left`` with ``values`` of the row of ``right`` that was appended last among those before it, null where there is none.

    Rows meet where the columns ``by`` are equal, null being a key like any other. Before means
    that ``order`` is smaller, or not larger where not ``strict``; a null is before nothing and
    after nothing. ``appended`` tells which row came last, whatever its ``order``; by default it
    is the one with the largest ``order``. Of rows appended at the same place the one with the
    largest values stands. Every row of ``left`` comes back once, repeated ones too.

    Both sides are dealt to ranges of key and order, in which a key with very many rows has many.
    A range begins with the last row of all ranges before it that hold the key.
    """
    kinds = dict(right.dtypes)
    last = F.struct(F.col(appended or order).alias("appended"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    names = [f"k{i}" for i in range(len(by))]
    sides = (0, 1) if strict else (1, 0)
    l_rows = left.select(*keys, F.col(order).alias("at"), F.lit(sides[0]).alias("side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"))
    r_rows = right.where(F.col(order).isNotNull()).select(*keys, F.col(order).alias("at"), F.lit(sides[1]).alias("side"), last.alias("last"))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    # the hash parts rows of one key and time, so that these may be many too
    ranges = both.repartitionByRange(*names, "at", "side", F.xxhash64("row", "last")).withColumn("range", F.spark_partition_id())
    dealt = stored(ranges, "ranges")
    of_range = dealt.where("last is not null").groupBy(*names, "range").agg(F.max("last").alias("last"))
    held = dealt.select(*names, "range").distinct().join(of_range.withColumnsRenamed({n: f"r{n}" for n in names}).withColumnRenamed("range", "r"), [*[F.col(n).eqNullSafe(F.col(f"r{n}")) for n in names], F.col("range") == F.col("r")], "left")
    earlier = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of the key
    begin = held.select(*names, "range", F.max("last").over(earlier).alias("last")).where("last is not null").withColumn("side", F.lit(-1))
    so_far = Window.partitionBy(*names, "range").orderBy(F.asc_nulls_first("at"), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.unionByName(begin, allowMissingColumns=True).withColumn("found", F.max("last").over(so_far)).where("row is not null")
    found = [F.when(F.col("at").isNotNull(), F.col(f"found.v{i}")).cast(kinds[v]).alias(v) for i, v in enumerate(values)]
    return seen.select(*[F.col(f"row.`{c}`").alias(c) for c in left.columns if c not in values], *found)


def _newest(touches: DataFrame, n: int) -> DataFrame:
    """Of (range, key, us, event_id) the ``n`` keys of each range that were touched last, each with its last touch."""
    last = touches.groupBy("range", "key").agg(F.max(F.struct("us", "event_id")).alias("t"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("t")))
    return last.withColumn("place", place).where(F.col("place") <= n).select("range", "key", "t.us", "t.event_id")


def resident(lookups: DataFrame, capacity: int) -> DataFrame:
    """event_id, key, us, resident of lookups (event_id, key, us): whether a cache of ``capacity`` keys holds the key when it is looked up.

    Each lookup makes its key the one touched last, and the key touched longest ago gives way: so
    a key is there if and only if it was looked up before and fewer than ``capacity`` other keys
    were since. Lookups of one microsecond go by event_id; a null key is a key.

    All a range of time hands on is its ``capacity`` keys touched last. What stands before each
    range is merged from these in as many rounds as the logarithm of the ranges.
    """
    ranges = lookups.select("event_id", "key", "us").repartitionByRange("us", "event_id").withColumn("range", F.spark_partition_id())
    dealt = stored(ranges, "touches")
    numbers = sorted(r["range"] for r in dealt.select("range").distinct().collect())  # one row for each range
    spark = dealt.sparkSession
    place = spark.createDataFrame(list(zip(numbers, range(len(numbers)), strict=True)), "range int, place int")
    dealt = dealt.join(F.broadcast(place), "range").withColumn("range", F.col("place")).drop("place")
    stack, step = stored(_newest(dealt, capacity), "stack"), 1
    while step < len(numbers):
        moved = stack.withColumn("range", F.col("range") + step).where(F.col("range") < len(numbers))
        stack, step = stored(_newest(stack.unionByName(moved), capacity), "stack"), 2 * step
    before = stack.withColumn("range", F.col("range") + 1).where(F.col("range") < len(numbers)).withColumn("carried", F.lit(True))
    rows = dealt.withColumn("carried", F.lit(False)).unionByName(before).select("range", "event_id", "key", "us", "carried")

    def touch(held: OrderedDict, row: tuple) -> tuple[OrderedDict, tuple]:
        _, event_id, key, us, carried = row
        there = key in held
        held[key] = None
        held.move_to_end(key)
        if len(held) > capacity:
            held.popitem(last=False)
        return held, (event_id, key, us, carried, there)

    kind = dict(lookups.dtypes)["key"].replace("bigint", "long")
    made = keyed_fold(rows, "range", ["us", "event_id"], OrderedDict, touch, f"event_id long, key {kind}, us long, carried boolean, resident boolean")
    return made.where("not carried").drop("carried")


def bounded_cache_hits(lookups: DataFrame, ttl_us: int, capacity: int = 512) -> DataFrame:
    """event_id, key, hit of lookups (event_id, key, us) in a cache of ``capacity`` keys whose entries last ``ttl_us`` from when they are written.

    A miss writes; a hit refreshes the key's place but not its time. An entry that is too old
    keeps its place until it is looked up or gives way.
    """

    def step(written: int | None, row: tuple) -> tuple[int, tuple]:
        event_id, key, us, there = row
        hit = there and written is not None and us - written <= ttl_us
        return (written if hit else us), (event_id, key, hit)

    kind = dict(lookups.dtypes)["key"].replace("bigint", "long")
    return keyed_fold(resident(lookups, capacity), "key", ["us", "event_id"], lambda: None, step, f"event_id long, key {kind}, hit boolean")
