"""Streams that keep state for a bounded time: account totals, sessions, and matches between two streams.

Event times are timestamps with a zone, as watermarks need. What each job keeps, and when it lets go of it, is stated with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that transformWithState needs; to be set in the session before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

TOTALS = "user_id bigint, n_events bigint, total double, first_ts timestamp, last_ts timestamp, closed boolean"


class _UserTotals(StatefulProcessor):
    """One value of state for each user: events, their sum, first and last event time. A timer ends it.

    The timer stands at the user's last event time plus the idle time. It fires once the watermark is past it; the user's final
    row then comes out, closed, and state and timer go. An event that comes later starts the user anew.
    """

    def __init__(self, idle_ms: int):
        self._idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._totals = handle.getValueState("totals", "n bigint, total double, first_ms bigint, last_ms bigint, timer_ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self._totals.get() if self._totals.exists() else None
        n, total, first, last, timer = known if known else (0, 0.0, None, None, None)
        for row in rows:
            at = int(row.ms)
            n, total = n + 1, total + (row.value or 0.0)
            first, last = at if first is None else min(first, at), at if last is None else max(last, at)
        due = last + self._idle_ms
        if due != timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(due)
        self._totals.update((n, total, first, last, due))
        yield Row(user_id=key[0], n_events=n, total=total, first_ms=first, last_ms=last, closed=False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, total, first, last, _ = self._totals.get()
        self._totals.clear()
        yield Row(user_id=key[0], n_events=n, total=total, first_ms=first, last_ms=last, closed=True)

    def close(self) -> None:
        pass


def expiring_totals(events: DataFrame, late: str, idle: timedelta) -> DataFrame:
    """Running totals per user that end after an idle time without events: TOTALS.

    In each batch a row for every user with new events, closed = false, and one last row for each user whose idle time the
    watermark has passed, closed = true. State: one row for each user who isn't idle, in RocksDB, so that it may exceed
    memory. Rows later than the watermark count for a user who is known, and start a new user otherwise; rows without a time or user are left
    out; a null value counts as 0. Update mode; STATE_STORE has to be set.
    """
    timed = events.where("ts IS NOT NULL AND user_id IS NOT NULL").withWatermark("ts", late).select("user_id", "ts", "value", F.unix_millis("ts").alias("ms"))
    made = timed.groupBy("user_id").transformWithState(
        _UserTotals(idle // timedelta(milliseconds=1)), "user_id bigint, n_events bigint, total double, first_ms bigint, last_ms bigint, closed boolean", outputMode="Update", timeMode="EventTime"
    )
    return made.select("user_id", "n_events", "total", F.timestamp_millis("first_ms").alias("first_ts"), F.timestamp_millis("last_ms").alias("last_ts"), "closed")


def session_totals(events: DataFrame, late: str, gap: str) -> DataFrame:
    """Sessions of each user by gaps, across batches: user_id, session_start, session_end (last event plus the gap), n_events, total.

    Events that come out of order, within the watermark, extend a session or join two. A session comes out once, when the
    watermark has passed its end (append mode), and then leaves the state; events later than the watermark are dropped. State:
    the sessions that are still open. Rows without a time are left out; rows without a user are one user.
    """
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("_session"))
    return grouped.agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select(
        "user_id", F.col("_session.start").alias("session_start"), F.col("_session.end").alias("session_end"), "n_events", "total"
    )


def matched_within(left: DataFrame, right: DataFrame, by: str, left_late: str, right_late: str, within: str, how: str = "inner") -> DataFrame:
    """Pairs of a left and a right event of the same key with left.ts <= right.ts <= left.ts + within.

    Both streams have event_id, ts and the key: the result has the key, left_id, left_ts, right_id, right_ts. The time condition and both watermarks
    bound the state: a left row goes when no right row within its time can come any more, a right row when no left
    row can. With how = "left", a left row without a match comes out then, with nulls (append mode). Rows later than the
    watermark of their stream are dropped; rows without a time or key match nothing.
    """
    lefts = left.select(F.col("event_id").alias("left_id"), F.col("ts").alias("left_ts"), F.col(by)).withWatermark("left_ts", left_late)
    rights = right.select(F.col("event_id").alias("right_id"), F.col("ts").alias("right_ts"), F.col(by).alias("_by")).withWatermark("right_ts", right_late)
    near = (F.col(by) == F.col("_by")) & (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"INTERVAL {within}"))
    return lefts.join(rights, near, how).select(by, "left_id", "left_ts", "right_id", "right_ts")
