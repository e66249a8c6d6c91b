"""Streams whose state ends: expiry, restart, order, lateness, and rows that nothing matches."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import sessions
from sparkloom.streaming import drain, expiring_totals, matched_within, session_totals, state_store
from sparkloom.streaming.stateful import STATE_STORE

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, value double"
START = dt.datetime(2024, 1, 1)


def at(minute):
    return START + dt.timedelta(minutes=minute)


@pytest.fixture
def source(spark, tmp_path):
    """put(rows, folder) adds a batch of (event_id, minute, user_id, value); read(folder) is the stream of them, a batch at a time."""
    numbers = itertools.count()

    def put(rows, folder="in"):
        made = [(i, None if m is None else at(m), u, v) for i, m, u, v in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{folder}/{next(numbers):04d}")

    def read(folder="in"):
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{folder}/*")

    return put, read


@pytest.fixture
def run(spark, tmp_path):
    """Runs a stream over what is there, from its checkpoint on: the rows that came out, by batch, and rows of state after each batch."""

    def go(stream, mode, name="check"):
        out, sizes = [], []
        with state_store(spark):
            query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").foreachBatch(lambda df, n: out.extend((n, *r) for r in df.collect())).trigger(availableNow=True).start()
            assert query.awaitTermination(180) and query.exception() is None
            progress = [json.loads(p.json) for p in query.recentProgress]
        return out, [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress if p["stateOperators"]], sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])

    return go


# Totals that expire


def totals(stream):
    return expiring_totals(stream, "10 minutes", dt.timedelta(minutes=30))


def test_idle_users_leave_the_state(source, run):
    put, read = source
    put([(1, 0, 1, 1.0), (2, 1, 2, 5.0), (3, 2, 1, None)])
    put([(4, 60, 3, 2.0), (5, None, 3, 9.0), (6, 60, None, 9.0)])
    put([(7, 200, 3, 4.0)])
    out, sizes, _ = run(totals(read()), "update")
    closed = {r[1]: r[2:6] for r in out if r[6]}
    assert closed == {1: (2, 1.0, at(0), at(2)), 2: (1, 5.0, at(1), at(1))}  # user 3 came back before the timer
    assert sorted(r[1:4] for r in out if r[0] == 0) == [(1, 2, 1.0), (2, 1, 5.0)]
    assert max(sizes) > sizes[-1] and sizes[-1] == 1  # user 3 alone is left
    assert len([r for r in out if r[6] and r[1] == 1]) == 1


def test_a_timer_moves_with_the_last_event(source, run):
    put, read = source
    put([(1, 0, 1, 1.0)])
    put([(2, 25, 1, 1.0)])
    put([(3, 45, 2, 1.0)])  # the watermark goes to 35: past 30, but user 1 is due at 55
    put([(4, 50, 1, 1.0)])
    put([(5, 300, 2, 1.0)])
    out, _, _ = run(totals(read()), "update")
    assert [r[1:6] for r in out if r[6]][0] == (1, 3, 3.0, at(0), at(50)) and len([r for r in out if r[6] and r[1] == 1]) == 1


def test_a_user_who_comes_back_starts_anew(source, run):
    put, read = source
    for rows in ([(1, 0, 1, 1.0)], [(2, 100, 2, 1.0)], [(3, 101, 2, 1.0)], [(4, 110, 1, 7.0)]):
        put(rows)
    out, _, _ = run(totals(read()), "update")
    assert [r[2:4] for r in out if r[1] == 1] == [(1, 1.0), (1, 1.0), (1, 7.0)]


def test_totals_are_the_same_after_a_restart(source, run):
    put, read = source
    draw = random.Random(1)
    batches = [[(100 * b + i, 20 * b + draw.randint(0, 15), draw.randint(1, 6), float(draw.randint(1, 9))) for i in range(20)] for b in range(6)]
    for rows in batches:
        put(rows, "whole")
    whole, _, _ = run(totals(read("whole")), "update", "one")
    out = []
    for half in (batches[:3], batches[3:]):
        for rows in half:
            put(rows, "halves")
        out += run(totals(read("halves")), "update", "two")[0]
    last = lambda rows: {r[1]: r[2:6] for r in rows if not r[6]}
    assert last(out) == last(whole)
    done = [r for rows in batches for r in rows]
    assert all(r[2] <= sum(x[2] == r[1] for x in done) for r in out)


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(STATE_STORE[0])
    with state_store(spark):
        assert spark.conf.get(STATE_STORE[0]) == STATE_STORE[1]
    assert spark.conf.get(STATE_STORE[0]) == before


# Sessions


def test_sessions_merge_across_batches(source, run):
    put, read = source
    put([(1, 0, 1, 1.0), (2, 20, 1, 2.0)])  # two sessions, until the next batch joins them
    put([(3, 10, 1, 4.0)])
    put([(4, 200, 2, 8.0)])
    put([(5, 201, 2, 16.0)])
    out, sizes, _ = run(session_totals(read(), "1 hour", "15 minutes"), "append")
    assert [r[1:] for r in out] == [(1, at(0), at(35), 3, 7.0)]
    assert sizes[0] == 2 and sizes[-1] == 1


def test_sessions_of_events_out_of_order_are_those_of_the_batch(spark, source, run):
    put, read = source
    draw = random.Random(2)
    rows = [(i, draw.randint(0, 600), draw.randint(1, 4), 1.0) for i in range(150)]
    rows += [(900, 10_000, 9, 1.0), (901, 10_001, 9, 1.0)]
    late = sorted(rows, key=lambda r: (r[1] + draw.randint(0, 100), r[0]))  # each comes at most 100 minutes late
    for i in range(0, len(late), 30):
        put(late[i : i + 30])
    put([(902, 10_002, 9, 1.0)])
    out, _, dropped = run(session_totals(read(), "2 hours", "7 minutes"), "append")
    batch = spark.createDataFrame([(i, at(m), u, v) for i, m, u, v in rows if u != 9], SCHEMA)
    expected = sessions(batch, ["user_id"], "ts", "7 minutes", [F.count("*").alias("n")]).select("user_id", "session_start", "session_end", "n").collect()
    assert sorted(r[1:5] for r in out) == sorted(map(tuple, expected)) and dropped == 0


def test_events_later_than_the_watermark_are_in_no_session(source, run):
    put, read = source
    put([(1, 0, 1, 1.0), (2, 100, 2, 1.0)])
    put([(3, 101, 2, 1.0)])
    put([(4, 2, 1, 50.0), (5, 300, 2, 1.0)])  # the watermark is at 91
    put([(6, 301, 2, 1.0)])
    out, _, dropped = run(session_totals(read(), "10 minutes", "5 minutes"), "append")
    assert sorted(r[1:] for r in out) == [(1, at(0), at(5), 1, 1.0), (2, at(100), at(106), 2, 2.0)] and dropped == 1


# Two streams


def matched(source, run, lefts, rights, how="inner"):
    put, read = source
    for rows in lefts:
        put(rows, "left")
    for rows in rights:
        put(rows, "right")
    out, sizes, dropped = run(matched_within(read("left"), read("right"), "user_id", "10 minutes", "10 minutes", "30 minutes", how), "append")
    return sorted(((r[2], r[4]) for r in out), key=repr), sizes, dropped


def test_rows_in_time_match_whichever_comes_first(source, run):
    lefts = [[(1, 0, 1, 0.0), (2, 5, 2, 0.0)], [(3, 6, 1, 0.0)]]
    rights = [[(11, 30, 1, 0.0), (12, 4, 2, 0.0), (13, 5, 2, 0.0)], [(14, 36, 1, 0.0), (15, 37, 1, 0.0), (16, 10, None, 0.0), (17, 10, 3, 0.0)]]
    pairs, _, _ = matched(source, run, lefts, rights)
    assert pairs == [(1, 11), (2, 13), (3, 11), (3, 14)]


def test_a_right_row_before_its_left_row_does_not_match(source, run):
    assert matched(source, run, [[(1, 10, 1, 0.0)]], [[(11, 9, 1, 0.0)]])[0] == []


def test_rows_later_than_the_watermark_do_not_match(source, run):
    lefts = [[(1, 0, 1, 0.0)], [(2, 200, 2, 0.0)], [(3, 201, 2, 0.0)], [(4, 1, 1, 0.0)]]
    rights = [[(11, 200, 3, 0.0)], [(12, 201, 3, 0.0)], [(13, 202, 3, 0.0)], [(14, 5, 1, 0.0)]]
    pairs, _, dropped = matched(source, run, lefts, rights)
    assert pairs == [] and dropped == 2


def test_left_rows_that_nothing_matched_come_out_when_nothing_can(source, run):
    lefts = [[(1, 0, 1, 0.0), (2, 2, 2, 0.0)], [(3, 500, 4, 0.0)], [(4, 501, 4, 0.0)]]
    rights = [[(11, 1, 1, 0.0)], [(12, 500, 3, 0.0)], [(13, 501, 3, 0.0)]]
    pairs, _, _ = matched(source, run, lefts, rights, "left")
    assert pairs == [(1, 11), (2, None)]  # 3 and 4 may still find a match


def test_state_of_two_streams_is_bounded_by_the_watermarks(source, run):
    lefts = [[(100 * b + i, 100 * b + i, i, 0.0) for i in range(20)] for b in range(6)]
    rights = [[(100 * b + i + 50, 100 * b + i + 50, i, 0.0) for i in range(20)] for b in range(6)]
    _, sizes, _ = matched(source, run, lefts, rights)
    assert max(sizes) <= 3 * 40 and sizes[-1] <= 40


# Running a stream to the end of its input


def test_a_drained_stream_goes_on_from_its_checkpoint(spark, source, tmp_path):
    put, read = source
    put([(1, 0, 1, 1.0), (2, 500, 2, 1.0)])
    first = drain(session_totals(read(), "10 minutes", "5 minutes"), f"{tmp_path}/drained")
    assert [(r.user_id, r.n_events) for r in first.collect()] == [(1, 1)]
    put([(3, 1000, 2, 1.0)])
    again = drain(session_totals(read(), "10 minutes", "5 minutes"), f"{tmp_path}/drained")
    assert sorted((r.user_id, r.n_events) for r in again.collect()) == [(1, 1), (2, 1)]
