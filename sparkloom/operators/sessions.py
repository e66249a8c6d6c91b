"""Sessions of events by gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def sessions(events: DataFrame, by: list[str], time: str, gap: str, measures: list[Column]) -> DataFrame:
    """One row per session: by, session_start, session_end (last event plus the gap) and the measures.

    Events a gap apart or more are of two sessions. Events without a time belong to none; null keys are a key. Repeated
    rows count each. Measures named as the result's own columns are replaced.
    """
    # Without the count, which then is asked for, Spark's optimizer takes sessions under a distinct for groups that it may leave out.
    grouped = events.groupBy(*by, F.session_window(time, gap).alias("_session")).agg(*measures, F.count("*").alias("_n")).where("_n > 0")
    return grouped.withColumns({"session_start": F.col("_session.start"), "session_end": F.col("_session.end")}).drop("_session", "_n")
