"""Structured Streaming: the same rate limit, sessions and counters over event streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.answering import worth_remembering
from ..operators.state import DAY_US

LIMITED = "event_id long, key long, allowed boolean"


def rate_limit_stream(calls: DataFrame, capacity: int, us_per_token: int, daily_quota: int, idle: str | None = None) -> DataFrame:
    """Decisions for a stream of calls (event_id, key, us), per key in the order of time within a batch.

    A call that is older than one of an earlier batch refills nothing and counts for the later
    one's day, so no time is credited twice and no quota begins anew.
    State is tokens, last time, day and use of the day; with ``idle`` (milliseconds as text) a
    key that makes no call for so long is forgotten, as a full bucket would be.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        calls = pd.concat(list(batches)).sort_values(["us", "event_id"])  # one key's calls of one micro-batch
        tokens, last, day, used = state.get if state.exists else (None, 0, 0, 0)
        out = []
        for event_id, us in zip(calls["event_id"], calls["us"], strict=True):
            event_id, us = int(event_id), int(us)
            if tokens is None:
                tokens, last, day = capacity * us_per_token, us, us // DAY_US
            # time doesn't run backwards: a late call is judged at the time and on the day of the latest one
            now = max(last, us)
            tokens = min(capacity * us_per_token, tokens + now - last)
            used = used if now // DAY_US == day else 0
            last, day = now, now // DAY_US
            ok = tokens >= us_per_token and used < daily_quota
            tokens, used = (tokens - us_per_token, used + 1) if ok else (tokens, used)
            out.append((event_id, key[0], ok))
        state.update((tokens, last, day, used))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=["event_id", "key", "allowed"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return calls.groupBy("key").applyInPandasWithState(decide, LIMITED, "tokens long, last long, day long, used long", "append", timeout)


def write_back(answers: DataFrame, made_of: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Keep what ``made_of`` makes of a stream of answers (memories, cache entries), a folder below ``path`` for each micro-batch.

    Only finished answers that aren't stand-ins are looked at. A batch that is run again after a
    failure replaces its folder, so nothing is kept twice. Start the writer that is returned.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        made_of(worth_remembering(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return answers.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, ts: str, width: str, lateness: str, labels: list[str]) -> DataFrame:
    """An extension: counts per tumbling window, final once the watermark has passed."""
    stamped = events.withColumn("ts_", F.col(ts).cast("timestamp")).withWatermark("ts_", lateness)
    return stamped.groupBy(F.window("ts_", width), *labels).agg(F.count("*").alias("n")).select(F.col("window.start").alias("started"), *labels, "n")


def session_stream(events: DataFrame, key: str, ts: str, gap: str, lateness: str) -> DataFrame:
    """Sessions of a stream; each is given out once the watermark has passed its end."""
    stamped = events.withColumn("ts_", F.col(ts).cast("timestamp")).withWatermark("ts_", lateness)
    return stamped.groupBy(key, F.session_window("ts_", gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("started"), "n")
