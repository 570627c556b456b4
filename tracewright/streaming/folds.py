"""Compare-and-set writes and cached failures as streams, by ``transformWithState``.

Rows of a key are handled in order within a micro-batch; a micro-batch comes after the ones before it. Both keep one small value for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WRITES = "scope string, scope_id string, seq long, expected_revision long, current_revision long, accepted boolean, revision long"
CALLS = "key string, at timestamp, seq long, outcome string, message string"


class Revisions(StatefulProcessor):
    """The current revision of a scope; a write that expects it makes the next one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "revision long")

    def handleInitialState(self, key, initial: Row, timers) -> None:
        self.current.update((initial["revision"],))

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        now = self.current.get()[0] if self.current.exists() else 0
        before = now
        for row in sorted(rows, key=lambda r: r["seq"]):
            taken = row["expected_revision"] == now
            yield Row(scope=key[0], scope_id=key[1], seq=row["seq"], expected_revision=row["expected_revision"], current_revision=now, accepted=taken, revision=now + 1 if taken else None)
            now += taken
        if now != before:
            self.current.update((now,))

    def close(self) -> None:
        pass


def settle_writes(writes: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """As ``revisions.settle_writes``, over a stream; ``current`` (scope, scope_id, revision) is a table of what is stored already."""
    keyed = lambda df: df.withColumn("scope_id", F.coalesce("scope_id", F.lit(""))).groupBy("scope", "scope_id")
    return keyed(writes.select("scope", "scope_id", "seq", F.col("expected_revision").cast("long").alias("expected_revision"))).transformWithState(
        Revisions(), WRITES, "Append", "None", None if current is None else keyed(current.select("scope", "scope_id", F.col("revision").cast("long").alias("revision")))
    )


class Failures(StatefulProcessor):
    """The failure that is cached for a key, until its end; a timer then drops it."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "since_ms long, message string")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        since, message = self.entry.get() if self.entry.exists() else (None, None)
        for row in sorted(rows, key=lambda r: (r["at_ms"], r["seq"])):
            cached = since is not None and since <= row["at_ms"] < since + self.ttl_ms
            if not cached and row["failed"] and row["cacheable"] and (since is None or row["at_ms"] > since):
                if since is not None:
                    self.handle.deleteTimer(since + self.ttl_ms)
                since, message = row["at_ms"], row["message"]
                self.entry.update((since, message))
                self.handle.registerTimer(since + self.ttl_ms)
            outcome = "cached" if cached else "failed" if row["failed"] else "passed"
            yield Row(key=key[0], at=row["at"], seq=row["seq"], outcome=outcome, message=message if cached else row["message"] if row["failed"] else None)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[Row]:
        if self.entry.exists() and self.entry.get()[0] + self.ttl_ms <= expired.getExpiryTimeInMs():
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached_failures(calls: DataFrame, ttl_seconds: float, lateness: str = "10 seconds") -> DataFrame:
    """As ``revisions.cached_failures``, over a stream of calls in milliseconds of event time with a text as key.

    Calls that are later than the watermark are dropped by Spark. One that is merely late and lies before the entry of its key was made: it finds nothing cached and caches nothing itself.
    """
    made = [F.coalesce(c, F.lit(False)).alias(c) for c in ("failed", "cacheable")]
    timed = calls.withWatermark("at", lateness).select("key", "at", "seq", F.unix_millis("at").alias("at_ms"), *made, "message")
    return timed.groupBy("key").transformWithState(Failures(int(ttl_seconds * 1000)), CALLS, "Append", "EventTime")
