"""Streams of events(event_id, ts, user_id, event_type, value). Event times are timestamps with a zone, as watermarks need."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Events and their value per window and type; rows that come later than the watermark are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total")
    )


def distinct_events(events: DataFrame, late: str) -> DataFrame:
    """Each event_id once, with state for the time of the watermark only."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_totals(events: DataFrame) -> DataFrame:
    """After each batch, the number of events and the total value so far of the users in it."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, n_events bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)
