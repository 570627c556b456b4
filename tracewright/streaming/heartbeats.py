"""Heartbeats as a stream: the latest of each instance, and the ones that ran out.

Watermarks and event time are a choice of this engine; a lease here runs out by processing time elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "service_role string, instance_id string, status string, checked_at timestamp"
OUT = "service_role string, instance_id string, status string, checked_at timestamp, state string"


def _expiry(ttl_seconds: int):
    def step(key: tuple, frames: Iterator[Any], state: GroupState):
        import pandas as pd

        role, instance = key
        if state.hasTimedOut:
            status, checked = state.get
            state.remove()
            yield pd.DataFrame({"service_role": [role], "instance_id": [instance], "status": [status], "checked_at": [pd.Timestamp(checked)], "state": ["stale"]})
            return
        status, checked = state.get if state.exists else (None, None)
        for frame in frames:
            last = frame.sort_values(["checked_at", "status"]).iloc[-1]
            if checked is None or last["checked_at"] >= pd.Timestamp(checked):
                status, checked = last["status"], last["checked_at"].isoformat()
        state.update((status, checked))
        until = pd.Timestamp(checked, tz="UTC").value // 1_000_000 + 1000 * ttl_seconds
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"service_role": [role], "instance_id": [instance], "status": [status], "checked_at": [pd.Timestamp(checked)], "state": ["active"]})

    return step


def expiring(heartbeats: DataFrame, ttl_seconds: int, lateness: str = "10 seconds") -> DataFrame:
    """An ``active`` row for each batch of an instance's heartbeats, and a ``stale`` row once the watermark passes its expiry."""
    timed = heartbeats.withWatermark("checked_at", lateness)
    return timed.groupBy("service_role", "instance_id").applyInPandasWithState(_expiry(ttl_seconds), OUT, "status string, checked_at string", "update", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, time: str, key: str, window: str, lateness: str) -> DataFrame:
    """(start, key, n) of tumbling windows; rows later than the watermark are dropped by Spark."""
    counted = events.withWatermark(time, lateness).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")
