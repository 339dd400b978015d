"""State that outlives a batch: values with their claims, and scales of pages. State is typed, folds events one at a time in any order, and expires.

Both need the RocksDB state store (see use_state_store) and a watermark on ts. The fold keeps the strongest claims by their numbers (seq), so
neither the order of events nor how they fall into batches matters, and no batch of a key is gathered. A key that is quiet in event time
for the given while says so once and is forgotten."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Expiring(StatefulProcessor):
    """One typed value for each key, and one timer that the key's latest event moves on."""

    schema = ""

    def __init__(self, idle_seconds: float):
        self.idle = int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def touch(self, ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            yield self.said(key[0], tuple(self.held.get()), True)
            self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was = tuple(self.held.get()) if self.held.exists() else None
        now, latest = was, was[-1] if was else 0
        for r in rows:
            latest = max(latest, int(r.ts.timestamp() * 1000))
            now = self.folded(now, r)
        now = (*now[:-1], latest)
        self.held.update(now)
        self.touch(latest)
        before = self.said(key[0], was, False) if was else None
        after = self.said(key[0], now, False)
        if after != before:
            yield after

    def close(self) -> None:
        pass


class StickyFields(_Expiring):
    """A user's value stands against all others; without one the last event's does. A source that a value came from is named until a user's edit behind it."""

    schema = "user_value string, user_seq long, value string, state string, source string, seq long, ms long"

    def folded(self, held, r):
        user_value, user_seq, value, state, source, seq, ms = held or (None, None, None, None, None, None, 0)
        if r.state == "user-modified":
            if user_seq is None or r.seq > user_seq:
                user_value, user_seq = r.value, r.seq
        elif seq is None or r.seq > seq:
            value, state, source, seq = r.value, r.state, r.source, r.seq
        return user_value, user_seq, value, state, source, seq, ms

    def said(self, key, held, expired: bool) -> Row:
        user_value, user_seq, value, state, source, seq, _ = held
        if user_seq is not None:
            return Row(field_id=key, value=user_value, state="user-modified", source=None if seq is None or user_seq > seq else source, expired=expired)
        return Row(field_id=key, value=value, state=state, source=source, expired=expired)


class ScaleStates(_Expiring):
    """The state of a page's scale: each event sets it, but a pending one doesn't take back one that was accepted or verified."""

    schema = "strong boolean, firm string, firm_seq long, last string, last_seq long, ms long"

    def folded(self, held, r):
        strong, firm, firm_seq, last, last_seq, ms = held or (False, None, None, None, None, 0)
        if r.state != "pending" and (firm_seq is None or r.seq > firm_seq):
            firm, firm_seq = r.state, r.seq
        if last_seq is None or r.seq > last_seq:
            last, last_seq = r.state, r.seq
        return strong or r.state in ("accepted", "verified"), firm, firm_seq, last, last_seq, ms

    def said(self, key, held, expired: bool) -> Row:
        strong, firm, _, last, _, _ = held
        return Row(page=key, state=firm if strong else last, expired=expired)


def sticky_fields(events: DataFrame, idle_seconds: float = 86_400, lateness: str = "10 minutes") -> DataFrame:
    """Changes (field_id, value, state, source, expired) of fields, from a stream of events (field_id, value, state, source, seq, ts)."""
    keyed = events.withWatermark("ts", lateness).groupBy("field_id")
    return keyed.transformWithState(StickyFields(idle_seconds), "field_id string, value string, state string, source string, expired boolean", "append", "EventTime")


def scale_states(events: DataFrame, idle_seconds: float = 86_400, lateness: str = "10 minutes") -> DataFrame:
    """Changes (page, state, expired) of pages' scales, from a stream of events (page, state, seq, ts)."""
    keyed = events.withWatermark("ts", lateness).groupBy("page")
    return keyed.transformWithState(ScaleStates(idle_seconds), "page string, state string, expired boolean", "append", "EventTime")
