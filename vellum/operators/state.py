"""Rate limits, quotas, answer caches and sessions over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import keyed_fold

DAY_US = 86_400_000_000


def rate_limit(calls: DataFrame, capacity: int, us_per_token: int, daily_quota: int) -> DataFrame:
    """event_id, key, allowed, retry_after, remaining for calls (event_id, key, us).

    A key's bucket starts full and regains a token every ``us_per_token`` microseconds. Without
    a token a call is denied with the whole seconds until there is one, at least 1; its day's
    quota is looked at only if there is a token, and a denial by quota spends none and waits
    for midnight. Times are whole microseconds, so the fold is exact. Calls in the same
    microsecond go by event_id.
    """

    def step(state, row):
        event_id, key, us = row
        tokens, last, day, used = state or (capacity * us_per_token, us, us // DAY_US, 0)
        tokens = min(capacity * us_per_token, tokens + us - last)
        today = us // DAY_US
        used = used if day == today else 0
        if tokens < us_per_token:
            return (tokens, us, today, used), (event_id, key, False, max(1, -(-(us_per_token - tokens) // 1_000_000)), None)
        if used >= daily_quota:
            return (tokens, us, today, used), (event_id, key, False, max(1, -(-((today + 1) * DAY_US - us) // 1_000_000)), 0)
        return (tokens - us_per_token, us, today, used + 1), (event_id, key, True, None, daily_quota - used - 1)

    rows = calls.select("event_id", "key", "us")
    kind = dict(rows.dtypes)["key"].replace("bigint", "long")
    return keyed_fold(rows, "key", ["us", "event_id"], lambda: None, step, f"event_id long, key {kind}, allowed boolean, retry_after long, remaining long")


def cache_hits(lookups: DataFrame, ttl_us: int) -> DataFrame:
    """event_id, key, hit of lookups (event_id, key, us): a miss writes, and a hit is at most ``ttl_us`` after the last write."""

    def step(written, row):
        event_id, key, us = row
        hit = written is not None and us - written <= ttl_us
        return (written if hit else us), (event_id, key, hit)

    return keyed_fold(lookups.select("event_id", "key", "us"), "key", ["us", "event_id"], lambda: None, step, "event_id long, key string, hit boolean")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """key, started, ended, n of each run of events with less than ``gap`` between neighbours."""
    w = F.session_window(F.col(ts), gap)
    return events.groupBy(key, w).agg(F.count("*").alias("n"), F.max(ts).alias("ended")).select(key, F.col("session_window.start").alias("started"), "ended", "n")


def last_messages(turns: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` messages of each conversation (conv_id, turn, role, text)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def session_store(events: DataFrame, keep: int = 20, idle: str = "30 minutes") -> DataFrame:
    """conv_id, n, newest: what the session store holds after a log of events (conv_id, seq, ts, text), the sweep being always up to date.

    A gap of more than ``idle`` ends a conversation, and what was said before it is gone; one
    that only touches has no text. Of the last messages ``keep`` stand. Events of one time go by
    seq. The stream of :mod:`vellum.streaming.sessions` comes to the same where its watermark
    passes each such gap before the next event.
    """
    in_order = Window.partitionBy("conv_id").orderBy("ts", "seq")
    gap = F.col("ts") > F.lag("ts").over(in_order) + F.expr(f"INTERVAL {idle}")
    begun = events.withColumn("gap", gap).groupBy("conv_id").agg(F.max(F.when(F.col("gap"), F.col("ts"))).alias("begun"))
    now = events.join(begun.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).where(F.col("begun").isNull() | (F.col("ts") >= F.col("begun")))
    held = now.groupBy("conv_id").agg(F.count("text").alias("said"), F.max_by("text", F.when(F.col("text").isNotNull(), F.struct("ts", "seq"))).alias("newest"))
    return held.select("conv_id", F.least("said", F.lit(keep)).alias("n"), "newest")


def least_recently_used(touches: DataFrame, key: str, ts: str, keep: int) -> DataFrame:
    """The ``keep`` keys touched last, with their last touch."""
    return touches.groupBy(key).agg(F.max(ts).alias("last_access")).orderBy(F.desc("last_access"), key).limit(keep)


def swept(touches: DataFrame, key: str, ts: str, idle: str, keep: int) -> DataFrame:
    """The keys that a sweep at the time of the last touch leaves: not idle for longer than ``idle``, and of those the ``keep`` touched last."""
    now = F.broadcast(touches.agg(F.max(ts).alias("now")))  # one row
    last = touches.groupBy(key).agg(F.max(ts).alias("last_access")).join(now)
    return last.where(F.col("last_access") >= F.col("now") - F.expr(f"INTERVAL {idle}")).orderBy(F.desc("last_access"), key).limit(keep).select(key, "last_access")


def seconds_to_midnight(ts: Column) -> Column:
    """Whole seconds until the next day, at least 1."""
    left = F.unix_micros(F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY")) - F.unix_micros(ts)
    return F.greatest(F.ceil(left / 1_000_000), F.lit(1))
