"""The event log as a stream: windows, deduplication, states with timeouts and the circuit breaker.

Batch twins of the windows are in ``plans``: in append mode a stream keeps its last windows open, so the two differ at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str | None = None, slide: str | None = None) -> DataFrame:
    """``start, event_type, n``: events by window and type; a watermark lets windows close."""
    rows = events if late is None else events.withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """``user_id, start, n``: events of a user with no longer pause than ``gap``."""
    rows = events if late is None else events.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(announcements: DataFrame, lookback: str = "7 days") -> DataFrame:
    """New filings once by id and once by source key within the lookback; two passes, as either may repeat."""
    rows = announcements.withWatermark("published_at", lookback)
    return rows.dropDuplicatesWithinWatermark(["id"]).dropDuplicatesWithinWatermark(["source", "source_id"])


#: Where a filing may go from each state.
STEPS = {
    "": {"discovered"}, "discovered": {"downloading", "auto_skipped"}, "downloading": {"downloaded", "discovered"},
    "downloaded": {"parsing", "auto_skipped"}, "parsing": {"review", "parse_partial", "parse_parked", "downloaded"},
    "review": {"online", "parse_parked"}, "parse_partial": {"review", "parsing", "online"}, "parse_parked": {"parsing"}, "online": set(), "auto_skipped": set(),
}
BUSY = {"downloading": "discovered", "parsing": "downloaded"}


def in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All rows of a key in a micro-batch by ``seq``: a key's rows may come in several chunks, each in any order."""
    return pd.concat(list(batches)).sort_values("seq", kind="stable")


def filing_states(changes: DataFrame, timeout: str = "5 minutes") -> DataFrame:
    """``id, status, rejected``: each filing's state after each batch of changes (``id, seq, to, at``).

    A change that its state does not allow is counted and ignored; what stays in progress past the timeout goes back.
    """
    minutes = int(timeout.split()[0])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, rejected = state.get if state.exists else ("", 0)
        if state.hasTimedOut:
            status = BUSY.get(status, status)
        else:
            for to in in_order(batches)["to"]:
                if to in STEPS.get(status, set()):
                    status = to
                else:
                    rejected += 1
        state.update((status, rejected))
        if status in BUSY:
            state.setTimeoutDuration(minutes * 60_000)
        yield pd.DataFrame({"id": [key[0]], "status": [status], "rejected": [rejected]})

    return changes.groupBy("id").applyInPandasWithState(
        step, "id string, status string, rejected long", "status string, rejected long", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def breaker(outcomes: DataFrame, last: int = 20, least: int = 6, limit: float = 0.6) -> DataFrame:
    """``source, n, failures, is_open``: a ring of each source's last outcomes (``source, seq, ok``)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = [*(state.get[0] if state.exists else []), *(int(x) for x in in_order(batches)["ok"])][-last:]
        state.update((ring,))
        failures = ring.count(0)
        yield pd.DataFrame({"source": [key[0]], "n": [len(ring)], "failures": [failures], "is_open": [len(ring) >= least and failures / len(ring) >= limit]})

    return outcomes.groupBy("source").applyInPandasWithState(
        step, "source string, n long, failures long, is_open boolean", "ring array<int>", "update", GroupStateTimeout.NoTimeout
    )


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there now as Parquet, and stops; run again it goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
