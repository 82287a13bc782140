"""The session store over a stream: what was said last, kept per conversation with state and timers of Spark's own.

Needs the state store on RocksDB (``spark.sql.streaming.stateStore.providerClass``), as Spark's
``transformWithState`` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION = "conv_id long, n long, newest string, expired boolean"


class _Session(StatefulProcessor):
    def __init__(self, keep: int, idle_ms: int):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "role string, text string")
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ms", "seq"])  # one conversation's events of one micro-batch
        turns = list(self.turns.get()) if self.turns.exists() else []
        said = events[events["text"].notna()]
        turns = [*turns, *zip(said["role"], said["text"], strict=True)][-self.keep :]
        if turns:
            self.turns.put(turns)
        last = int(max(events["ms"].max(), self.last.get()[0] if self.last.exists() else 0))
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "n": [len(turns)], "newest": [turns[-1][1] if turns else None], "expired": [False]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.turns.clear()
        self.last.clear()
        yield pd.DataFrame({"conv_id": [key[0]], "n": [0], "newest": [None], "expired": [True]})

    def close(self) -> None:
        pass


def session_store(events: DataFrame, keep: int = 20, idle_ms: int = 1_800_000, lateness: str = "0 seconds") -> DataFrame:
    """conv_id, n, newest, expired: after each micro-batch what a touched conversation holds, and when it is swept away.

    ``events``: conv_id, seq, ts, role, text; one without a text only touches. A conversation
    keeps its last ``keep`` messages. Reading and writing refresh it; nothing but the sweep ends
    it, once the watermark (the latest time seen, less ``lateness``) is ``idle_ms`` past its last
    touch. A late event doesn't set the last touch back.
    """
    stamped = events.select("conv_id", "seq", "role", "text", F.col("ts").cast("timestamp").alias("ts")).withColumn("ms", F.unix_millis("ts")).withWatermark("ts", lateness)
    return stamped.groupBy("conv_id").transformWithStateInPandas(_Session(keep, idle_ms), SESSION, "Update", "EventTime")
