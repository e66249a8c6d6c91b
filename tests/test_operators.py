from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import cosine
from sparkloom.operators import asof_join, range_join, sessions, top_k_per_group
from sparkloom.sources import read_any, write_any


@pytest.mark.parametrize("split", [None, lambda t: F.floor(t / 7)])
def test_asof_join_takes_the_last_row_before(spark, split):
    draw = random.Random(1)
    left = [(i, draw.choice(["a", "b", None]), draw.randint(0, 50)) for i in range(200)]
    right = [(draw.choice(["a", "b", "c"]), draw.randint(0, 50), draw.randint(0, 9)) for _ in range(80)]
    made = asof_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, u int, v int"), ["k"], "t", "u", ["v"], split)
    expected = {i: max(((u, v) for key, u, v in right if key == k and u <= t), default=(0, None))[1] for i, k, t in left}
    assert {r.id: r.v for r in made.collect()} == expected


def test_range_join_is_by_cells(spark):
    points, spans = [(i, i * 7 % 100 - 20) for i in range(60)], [(j, j * 3 - 30, j * 3 - 30 + (j % 13) * (1 if j % 5 else 9)) for j in range(40)]
    df = range_join(spark.createDataFrame(points, "i int, p int"), spark.createDataFrame(spans, "j int, a int, b int"), "p", "a", "b", 8)
    assert sorted((r.i, r.j) for r in df.collect()) == sorted((i, j) for i, p in points for j, a, b in spans if a <= p < b)
    assert "Cartesian" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_long_spans_touch_few_cells(spark):
    points, spans = spark.createDataFrame([(i, i * 1000) for i in range(50)], "i int, p bigint"), spark.createDataFrame([(1, 0, 10**12), (2, 5, 6), (3, 7, 7)], "j int, a bigint, b bigint")
    df = range_join(points, spans, "p", "a", "b", 4)
    assert sorted((r.i, r.j) for r in df.collect()) == [(i, 1) for i in range(50)]
    assert range_join(points, spans.limit(0), "p", "a", "b", 4).count() == 0


def test_top_k_is_cut_before_the_shuffle(spark):
    df = top_k_per_group(spark.range(1000).selectExpr("id % 7 AS g", "id"), ["g"], [F.desc("id")], 2)
    assert sorted((r.g, r["rank"]) for r in df.collect()) == [(g, k) for g in range(7) for k in (1, 2)]
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_sessions_end_after_the_gap(spark):
    at = [dt.datetime(2024, 1, 1, 0, m) for m in (0, 4, 20, 21)]
    df = sessions(spark.createDataFrame([(1, t) for t in at], "u int, ts timestamp"), ["u"], "ts", "5 minutes", [F.count("*").alias("n")])
    assert sorted((r.session_start.minute, r.n) for r in df.collect()) == [(0, 2), (20, 2)]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    one, none = (r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect())
    assert one == pytest.approx(2**-0.5) and none is None


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_formats_come_back(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, -1.0)], "k int, s string, v double")
    write_any(df, f"{tmp_path}/t", kind)
    assert sorted(map(tuple, read_any(spark, f"{tmp_path}/t", kind, df.schema).collect())) == [(1, "a", 2.5), (2, None, -1.0)]


def test_partitioned_tables_are_pruned(spark, tmp_path):
    write_any(spark.range(20).selectExpr("id", "id % 4 AS p"), f"{tmp_path}/t", "parquet", ["p"])
    df = read_any(spark, f"{tmp_path}/t", "parquet").where("p = 3")
    assert df.count() == 5 and "PartitionFilters: [isnotnull(p" in df._jdf.queryExecution().executedPlan().toString()
