"""Joins by keys and spans, NOT IN, sketches and the table function against brute force, with nulls, ties and no rows."""

from __future__ import annotations

import datetime as dt
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.batches import capped_batches, register
from sparkloom.functions.names import name_similarity, similarity
from sparkloom.operators import asof_join, hot_keys, merge_sketches, not_in, overlap_join, read_sketches, salted_join, sessions, slice_sketches, top_k_per_group
from sparkloom.operators.sketches import HLL_LG_K, RANK_ERROR
from sparkloom.plans import catalog
from sparkloom.sources import load

DATA = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# As-of join


@pytest.mark.parametrize("long_rows", [None, 0, 30])
def test_asof_join_with_nulls_and_ties(spark, long_rows):
    """Null keys and times match nothing; keys that are long are cut, others aren't, or none or all."""
    draw = random.Random(2)
    left = [(i, draw.choice(["a", "b", None]), draw.choice([1, None]), draw.choice([None, *range(20)])) for i in range(250)]
    left += left[:5]
    right = [(draw.choice(["a", "b", "c", None]), draw.choice([1, None]), draw.choice([None, *range(20)]), draw.choice([None, *range(9)])) for _ in range(120)]
    lefts, rights = spark.createDataFrame(left, "id int, k string, q int, t int").withColumn("v", F.lit("clash")), spark.createDataFrame(right, "k string, q int, u int, v int")
    split = None if long_rows is None else lambda t: F.floor(t / 7)
    made = asof_join(lefts, rights, ["k", "q"], "t", "u", ["v"], split, long_rows or 0)

    def last(k, q, t):
        found = [(u, v is not None, v) for key, r, u, v in right if None not in (k, q, t, u) and key == k and r == q and u <= t]
        return max(found, default=(0, 0, None), key=lambda x: (x[0], x[1], x[2] or 0))[2]

    assert made.columns == ["id", "k", "q", "t", "v"]
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(((*x, last(*x[1:])) for x in left), key=repr)
    assert asof_join(lefts.limit(0), rights, ["k"], "t", "u", ["v"]).count() == 0
    assert {r.v for r in asof_join(lefts, rights.limit(0), ["k"], "t", "u", ["v"]).collect()} == {None}


def test_short_keys_are_joined_with_one_exchange(spark):
    made = catalog.queries()["asof_last_order"](spark, DATA)
    assert len(re.findall(r"Exchange hashpartitioning", made._jdf.queryExecution().sparkPlan().toString() + plan(made))) == 1


# NOT IN


@pytest.mark.parametrize("columns", [1, 2, 3])
def test_not_in_as_sql_has_it(spark, columns):
    draw = random.Random(columns)
    names, others = ["a", "b", "c"][:columns], ["x", "y", "z"][:columns]
    types = lambda cols: ", ".join(f"{c} int" for c in cols)

    def may_equal(one, two):
        return all(a is None or b is None or a == b for a, b in zip(one, two, strict=True))

    for size, values in product((0, 1, 4, 9), ([0, 1, 2, 3, 4, 5], [0, 1, 2, None], [None])):
        left = [tuple(draw.choice([0, 1, 2, 3, 4, 5, None]) for _ in names) for _ in range(60)]
        right = [tuple(draw.choice(values) for _ in names) for _ in range(size)]
        made = not_in(spark.createDataFrame(left, types(names)).withColumn("kind", F.lit("kept")), spark.createDataFrame(right, types(others)), names, others)
        assert made.columns == [*names, "kind"]
        assert sorted((tuple(r)[:columns] for r in made.collect()), key=repr) == sorted((x for x in left if not any(may_equal(x, y) for y in right)), key=repr)


def test_not_in_has_no_nested_loop(spark):
    for name in ("not_in_pairs", "not_in_keys"):
        made = catalog.queries()[name](spark, DATA)
        made.count()
        assert not re.search("NestedLoop|Cartesian", plan(made))
    with pytest.raises(ValueError):
        not_in(spark.range(1), spark.range(1), [], [])


# Spans against spans


@pytest.mark.parametrize(("by", "width"), [([], 4), (["k"], 4), ([], 1), ([], 1000)])
def test_overlaps_come_once(spark, by, width):
    """Nested, touching, equal, empty, reversed and null spans, negative numbers, and spans of very different length."""
    draw = random.Random(3)

    def spans(n):
        made = []
        for i in range(n):
            start = draw.randint(-60, 60)
            made.append((i, draw.choice(["a", "b", None]), start, start + draw.choice([0, 1, 2, 5, 9, 40, 300, -3])))
        return made + [(n, "a", None, 5), (n + 1, "a", 5, None), (n + 2, "a", 0, 10), (n + 3, "a", 0, 10), (n + 4, "a", 10, 20), (n + 5, "a", 2, 3), (n + 6, "b", -(10**12), 10**12)]

    left, right = spans(50), spans(60)
    lefts, rights = spark.createDataFrame(left, "i int, k string, a bigint, b bigint"), spark.createDataFrame(right, "j int, k string, c bigint, d bigint")
    lefts, rights = (x if by else x.drop("k") for x in (lefts, rights))
    made = overlap_join(lefts, rights, ("a", "b"), ("c", "d"), width, by)
    assert set(made.columns) == {*by, "i", "a", "b", "j", "c", "d"}
    expected = [(i, j) for i, k, a, b in left for j, q, c, d in right if None not in (a, b, c, d) and max(a, c) < min(b, d) and (not by or k == q is not None)]
    assert sorted((r.i, r.j) for r in made.collect()) == sorted(expected)
    assert not re.search("NestedLoop|Cartesian", plan(made))
    assert overlap_join(lefts, rights.limit(0), ("a", "b"), ("c", "d"), width, by).count() == 0


def test_long_spans_are_listed_in_few_cells(spark):
    one = spark.createDataFrame([(0, 0, 10**15)], "i int, a bigint, b bigint")
    many = spark.range(2000).selectExpr("cast(id AS int) AS j", "id * 500000000000 AS c", "id * 500000000000 + 3 AS d")
    made = overlap_join(one, many, ("a", "b"), ("c", "d"), 4)
    assert made.count() == 2000
    assert made._jdf.queryExecution().executedPlan().toString().count("Generate") >= 2


def test_sessions_under_a_distinct(spark):
    at = [dt.datetime(2024, 1, 1, 0, m) for m in (0, 4, 20, 21)]
    df = sessions(spark.createDataFrame([(1, t) for t in at], "u int, ts timestamp"), ["u"], "ts", "5 minutes", [])
    lengths = df.select((F.unix_seconds("session_end") - F.unix_seconds("session_start")).alias("s")).distinct().collect()
    assert sorted(r.s for r in lengths) == [360, 540]


# Hot keys


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, how):
    draw = random.Random(4)
    left = [(i, 1 if i % 2 else draw.choice([None, *range(2, 300)]), "a") for i in range(2000)]
    left += left[:20]
    right = [(k, "a", v) for k in range(0, 200) for v in range(k % 3)] + [(1, "a", 5), (None, "a", 6)]
    lefts, rights = spark.createDataFrame(left, "i int, k int, s string"), spark.createDataFrame(right, "k int, s string, v int")
    made = salted_join(lefts, rights, ["k", "s"], how, share=0.05, salts=8)
    plain = lefts.join(rights, ["k", "s"], how)
    assert made.columns == plain.columns
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_a_hot_key_is_found_and_dealt_out(spark):
    df = spark.range(40_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 7 ELSE id END AS k").repartition(4)
    assert [r.k for r in hot_keys(df, ["k"], 0.01, sample=5000).collect()] == [7]
    right = spark.range(40_000).selectExpr("id AS k", "id * 2 AS v")
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for c, v in zip(before, ("-1", "false", "16"), strict=True):
        spark.conf.set(c, v)
    try:
        for joined, most in ((df.join(right, ["k"]), None), (salted_join(df, right, ["k"], share=0.01, salts=64, hot=spark.createDataFrame([(7,)], "k bigint")), 0.15)):
            sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert sum(sizes) == 40_000
            assert max(sizes) > 20_000 if most is None else max(sizes) < most * 40_000
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    with pytest.raises(ValueError):
        salted_join(df, right, ["k"], "full")


# Sketches


def exact_rank(values, at):
    return sum(v < at for v in values) / len(values), sum(v <= at for v in values) / len(values)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_merged_sketches_keep_their_bounds(spark, sf):
    data = f"/root/testdata/{sf}"
    merged = catalog.queries()["merged_sketches"](spark, data)
    assert not re.search(r"percentile|count\(distinct", plan(merged), re.IGNORECASE)
    direct = read_sketches(slice_sketches(load(spark, data, "events"), ["event_type"], "value", "user_id"), {"low": 0.05, "mid": 0.5, "high": 0.95})
    rows = {r.event_type: r for r in merged.collect()}
    events = load(spark, data, "events").select("event_type", "value", "user_id").collect()
    assert set(rows) == {r.event_type for r in events}
    for other in direct.collect():
        r = rows[other.event_type]
        values, users = [e.value for e in events if e.event_type == r.event_type], {e.user_id for e in events if e.event_type == r.event_type}
        assert (r.n_rows, r.n_values, r.least, r.greatest) == (other.n_rows, other.n_values, other.least, other.greatest) == (len(values), len(values), min(values), max(values))
        for made in (r, other):
            assert abs(made.n_keys - len(users)) <= max(1, 4 * 1.04 / 2 ** (HLL_LG_K / 2) * len(users))
            for name, q in (("low", 0.05), ("mid", 0.5), ("high", 0.95)):
                below, upto = exact_rank(values, made[name])
                assert below - RANK_ERROR <= q <= upto + RANK_ERROR
        assert abs(r.n_keys - other.n_keys) <= max(1, 0.02 * len(users))


def test_sketches_of_nulls_and_of_no_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", None, None), ("b", None, None), (None, 3.0, 6)], "g string, v double, k int")
    made = read_sketches(merge_sketches(slice_sketches(df, ["g"], "v", "k"), ["g"]), {"mid": 0.5}).collect()
    assert sorted(((r.g, r.n_rows, r.n_values, r.mid, r.n_keys) for r in made), key=repr) == sorted([("a", 2, 1, 1.0, 1), ("b", 1, 0, None, 0), (None, 1, 1, 3.0, 1)], key=repr)
    assert slice_sketches(df.limit(0), ["g"], "v", "k").count() == 0
    assert merge_sketches(slice_sketches(df, ["g"], "v", "k"), []).first().n_rows == 4


def test_approximate_aggregates_are_near(spark):
    made = catalog.queries()["approximate_aggregates"](spark, DATA)
    assert not re.search(r"percentile\(|[( ]distinct", plan(made))
    events = load(spark, DATA, "events").select("event_type", "value", "user_id").collect()
    for r in made.collect():
        values, users = [e.value for e in events if e.event_type == r.event_type], {e.user_id for e in events if e.event_type == r.event_type}
        below, upto = exact_rank(values, r.mid)
        assert r.n == len(values) and abs(r.n_users - len(users)) <= 0.08 * len(users) + 2 and below - 0.002 <= 0.5 <= upto + 0.002


def test_approximate_aggregates_are_held_against_exact_values(spark, tmp_path):
    """Distinct users and the median are exact where sketches aren't, for a null type too, and a type without values is there."""
    draw = random.Random(8)
    rows = [(draw.choice(["a", None]), draw.choice([None, draw.randrange(6000)]), draw.choice([None, draw.randrange(40_000) / 8])) for _ in range(40_000)] + [("c", None, None), ("d", 1, 2.0), ("d", 1, 1.0)]
    spark.createDataFrame(rows, "event_type string, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    expected = []
    for kind in ("a", None, "c", "d"):
        own = [r for r in rows if r[0] == kind]
        values, users = sorted(v for _, _, v in own if v is not None), {u for _, u, _ in own if u is not None}
        expected.append((kind, True, True, len(users), values[(len(values) - 1) // 2] if values else None, len(own)))
    made = catalog.queries()["approximate_aggregates"](spark, str(tmp_path))
    assert made.columns == ["event_type", "count_is_close", "median_is_close", "n_users", "mid", "n"]
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(expected, key=repr)
    assert "approximate_aggregates" in catalog.oracle_sql()


# Table function


def brute_batches(rows, cap):
    out, total, n, batch = [], 0.0, 0, 0
    for v in rows:
        v = v or 0.0
        if n and total + v > cap:
            out.append((batch, n, total))
            batch, n, total = batch + 1, 0, 0.0
        n, total = n + 1, total + v
    return out + [(batch, n, total)] if n else out


def test_batches(spark):
    draw = random.Random(6)
    rows = [(draw.choice(["a", "b", None]), draw.choice([1, 2]), i, draw.choice([None, 0.0, 1.5, 2.0, 30.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, h int, t int, v double").repartition(5)
    expected = []
    for g, h in {x[:2] for x in rows}:
        expected += [(g, h, *b) for b in brute_batches([v for *k, _, v in rows if k == [g, h]], 7.0)]
    assert sorted(map(tuple, capped_batches(df, ["g", "h"], ["t"], "v", 7).collect()), key=repr) == sorted(expected, key=repr)
    register(spark)
    named = spark.sql("SELECT * FROM capped_batches(TABLE({df}) PARTITION BY (g, h) ORDER BY (t), 'g,h', 'v', 7D)", df=df)
    assert sorted(map(tuple, named.collect()), key=repr) == sorted(expected, key=repr)
    assert capped_batches(df.limit(0), ["g"], ["t"], "v", 7).count() == 0
    with pytest.raises(Exception, match="no column w"):
        spark.sql("SELECT * FROM capped_batches(TABLE({df}) PARTITION BY g ORDER BY (t), 'g', 'w', 7D)", df=df).count()


def test_a_partition_is_streamed():
    """What is held after many rows is the open batch alone."""
    from sparkloom.functions.batches import CappedBatches

    made = CappedBatches.func()
    out = [x for i in range(10_000) for x in made.eval({"g": 1, "v": 1.0}, "g", "v", 10.0)]
    assert len(out) == 999 and set(vars(made)) == {"_key", "_batch", "_n", "_total"} and made._n == 10
    assert list(made.terminate()) == [(1, 999, 10, 10.0)]


# Names and ranks


def test_name_similarity(spark):
    assert similarity("martha", "marhta") == pytest.approx(0.9611111) and similarity("", "") == 1.0 and similarity("", "a") == similarity("abc", "xyz") == 0.0
    df = spark.createDataFrame([("a", None), (None, "a"), ("é日", "é日"), ("dixon", "dicksonx")], "a string, b string")
    assert [r.s and round(r.s, 4) for r in df.select(name_similarity("a", "b").alias("s")).collect()] == [None, None, 1.0, 0.8133]


def test_top_k_where_a_column_is_named_rank(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 4, "y"), (None, 1, "z"), (None, 1, "z")], "g int, v int, rank string")
    made = top_k_per_group(df, ["g"], [F.desc("v")], 1)
    assert made.columns == ["g", "v", "rank"] and sorted(map(tuple, made.collect()), key=repr) == [(1, 5, 1), (None, 1, 1)]
    assert top_k_per_group(df.limit(0), ["g"], [F.desc("v")], 1).count() == 0
