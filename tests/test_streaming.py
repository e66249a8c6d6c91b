from __future__ import annotations

import pytest

from sparkloom.streaming import distinct_events, running_totals, windowed_counts

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


@pytest.fixture
def feed(spark, tmp_path):
    """Rows given batch by batch come as a stream in that order; returns what the job puts out at each batch."""

    def run(job, batches, mode):
        for i, rows in enumerate(batches):
            df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double")
            df.selectExpr("event_id", "cast(ts as timestamp) AS ts", "user_id", "event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = []
        query = job(events).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/_check").foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return out

    return run


def at(minute):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


def test_late_rows_are_dropped(feed):
    batches = [[(1, at(5), 1, "a", 1.0), (2, at(90), 1, "a", 2.0)], [(3, at(200), 1, "a", 4.0)], [(4, at(10), 1, "a", 8.0), (5, at(400), 1, "a", 16.0)]]
    out = feed(lambda e: windowed_counts(e, "1 hour", "10 minutes"), batches, "append")
    assert sorted((r[0].hour, r[2], r[3]) for r in out) == [(0, 1, 1.0), (1, 1, 2.0), (3, 1, 4.0)]


def test_events_come_once(feed):
    batches = [[(1, at(0), 1, "a", 1.0), (1, at(0), 1, "a", 1.0)], [(1, at(1), 1, "a", 1.0), (2, at(1), 1, "a", 1.0)]]
    assert sorted(r[0] for r in feed(lambda e: distinct_events(e, "1 hour"), batches, "append")) == [1, 2]


def test_totals_run_over_batches(feed):
    batches = [[(1, at(0), 1, "a", 1.0), (2, at(0), 2, "a", 5.0)], [(3, at(1), 1, "a", 2.0)]]
    assert feed(running_totals, batches, "update")[-1] == (1, 2, 3.0)
