"""Who is alive: heartbeats as keyed state with event-time timers, so that silence is told without another beat.

State stores that keep timers need RocksDB: set ``spark.sql.streaming.stateStore.providerClass`` to ``PROVIDER`` in the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Minutes without a beat after which a worker counts as gone.
SILENCE = 10


class Heartbeats(StatefulProcessor):
    """Keeps each worker's last beat and one timer; says ``alive`` when a worker appears or comes back, and ``expired`` at the end of the
    silence. Late beats do not set a worker back."""

    def __init__(self, minutes: int):
        self.ms = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(x.value // 1_000_000) for part in rows for x in part["ts"])
        known = self.last.get()[0] if self.last.exists() else None
        if known is None or newest > known:
            self.last.update((newest,))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(newest + self.ms)
        if known is None:
            yield self.said(key, "alive", newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield self.said(key, "expired", last)

    @staticmethod
    def said(key, state: str, ms: int) -> pd.DataFrame:
        return pd.DataFrame({"worker": [key[0]], "state": [state], "last_ms": [ms]})

    def close(self) -> None:
        pass


def liveness(beats: DataFrame, minutes: int = SILENCE, late: str = "1 minute") -> DataFrame:
    """``worker, state, last_ms`` whenever a worker's state changes, from a stream of ``worker, ts``."""
    keyed = beats.withWatermark("ts", late).groupBy("worker")
    return keyed.transformWithStateInPandas(statefulProcessor=Heartbeats(minutes), outputStructType="worker string, state string, last_ms long", outputMode="append", timeMode="EventTime")
