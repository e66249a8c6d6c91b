"""The partitioned data source: round trips, filters that open fewer shards, appends, and what has no bounds."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources.arrow_shards import MANIFEST, Shard, read_manifest, read_shards, write_shards


def opened(df):
    """Partitions that the plan reads: a task for each shard."""
    return df.rdd.getNumPartitions()


@pytest.fixture
def shards(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "cast(id AS string) AS s", "CASE WHEN id % 10 = 0 THEN NULL ELSE id / 4.0D END AS v", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id AS int)) AS t")
    write_shards(df, f"{tmp_path}/t", "id", 10)
    return df, f"{tmp_path}/t"


def test_rows_and_types_come_back(spark, shards):
    df, path = shards
    made = read_shards(spark, path)
    assert made.schema == df.schema
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, df.collect()))
    assert opened(made) == 10 and sum(s["rows"] for s in read_manifest(path)["shards"]) == 1000


@pytest.mark.parametrize(
    ("test", "most"),
    [("id = 500", 1), ("id < 10", 1), ("id <= 120", 3), ("id > 990", 1), ("id >= 400 AND id < 450", 2), ("id IN (3, 999)", 2), ("id = 5000", 1), ("id IS NULL", 1), ("id IS NOT NULL", 10), ("s = '7'", 10), ("id = 3 OR id = 999", 10), ("id <=> 3", 1)],
)
def test_a_filter_opens_fewer_shards(spark, shards, test, most):
    df, path = shards
    made = read_shards(spark, path).where(test)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, df.where(test).collect()))
    assert opened(made) <= most


def test_a_shard_that_is_ruled_out_is_not_opened(spark, shards):
    """Its file may even be gone."""
    _, path = shards
    for shard in read_manifest(path)["shards"]:
        if shard["high"] >= 500:
            os.remove(f"{path}/{shard['file']}")
    least = min(s["low"] for s in read_manifest(path)["shards"] if s["high"] >= 500)
    assert read_shards(spark, path).where(F.col("id") < least).count() == least
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        read_shards(spark, path).where("id = 900").collect()


@pytest.mark.parametrize(("key", "test", "most"), [("t", "t >= timestamp_ntz'2024-06-01' AND t < timestamp_ntz'2024-06-15'", 2), ("s", "s = '500'", 1), ("v", "v > 240", 2), ("v", "v IS NULL", 10)])
def test_keys_of_other_kinds(spark, shards, tmp_path, key, test, most):
    df, _ = shards
    write_shards(df, f"{tmp_path}/other", key, 10)
    made = read_shards(spark, f"{tmp_path}/other").where(test)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(map(tuple, df.where(test).collect()), key=repr)
    assert opened(made) <= most


def test_what_has_no_bounds_is_never_ruled_out(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (float("inf"), "d")], "v double, s string")
    write_shards(df, f"{tmp_path}/nan", "v", 1)
    for test in ("v > 5", "isnan(v)", "v IS NULL", "v = 1"):
        assert sorted(r.s for r in read_shards(spark, f"{tmp_path}/nan").where(test).collect()) == sorted(r.s for r in df.where(test).collect())
    tens = spark.range(20).selectExpr("cast(id AS decimal(20, 2)) AS d")
    write_shards(tens, f"{tmp_path}/decimals", "d", 4)
    assert read_shards(spark, f"{tmp_path}/decimals").where("d = 3").count() == 1
    assert Shard("x", 5, None, None, 5).may_hold(__import__("pyspark.sql.datasource", fromlist=["IsNull"]).IsNull(("v",)))


def test_appends_overwrites_and_no_rows(spark, shards, tmp_path):
    df, path = shards
    write_shards(df.selectExpr("id + 1000 AS id", "s", "v", "t"), path, "id", 3, "append")
    made = read_shards(spark, path)
    assert made.count() == 2000 and opened(made.where("id >= 1000")) == 3
    write_shards(df.limit(5), path, "id", 2)
    assert read_shards(spark, path).count() == 5
    assert sorted(os.listdir(path)) == sorted([MANIFEST] + [s["file"] for s in read_manifest(path)["shards"]])
    write_shards(df.limit(0), f"{tmp_path}/none", "id", 2)
    empty = read_shards(spark, f"{tmp_path}/none")
    assert empty.count() == 0 and empty.columns == df.columns
    with pytest.raises(Exception, match="no column x"):
        df.write.format("arrow_shards").option("key", "x").mode("overwrite").save(f"{tmp_path}/bad")


def test_files_without_an_entry_are_no_part(spark, shards):
    """What a task left that didn't end: readers go by the manifest."""
    _, path = shards
    with open(f"{path}/left-over.arrow", "wb") as file:
        file.write(b"half a file")
    assert read_shards(spark, path).count() == 1000
    assert json.load(open(f"{path}/{MANIFEST}"))["key"] == "id"


def test_days_are_bounds(tmp_path):
    from pyspark.sql.datasource import EqualTo, LessThan

    shard = Shard("x", 2, "2024-01-05", "2024-02-01", 0)
    assert shard.may_hold(EqualTo(("d",), dt.date(2024, 1, 31))) and not shard.may_hold(EqualTo(("d",), dt.date(2023, 12, 31))) and not shard.may_hold(LessThan(("d",), dt.date(2024, 1, 5)))
