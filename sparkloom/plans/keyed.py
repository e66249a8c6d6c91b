"""Queries of the operators that go by keys, spans and sketches, each with its SQL where SQL has the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.functions.batches import capped_batches as packed, register
from sparkloom.functions.names import name_similarity as similar
from sparkloom.operators import merge_sketches, not_in, overlap_join, read_sketches, salted_join, sessions, slice_sketches
from sparkloom.plans.registry import query
from sparkloom.sources.arrow_shards import read_shards, write_shards
from sparkloom.sources.shared import shared_path
from sparkloom.sources.tables import load

_PACKED = """
WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events{where}),
r AS (SELECT user_id, k, CAST(0 AS BIGINT) AS batch, value AS total FROM e WHERE k = 1 UNION ALL
      SELECT e.user_id, e.k, CASE WHEN r.total + e.value > 300 THEN batch + 1 ELSE batch END, CASE WHEN r.total + e.value > 300 THEN e.value ELSE r.total + e.value END
      FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, batch, CAST(count(*) AS BIGINT) AS n_rows, round(max(total), 4) AS total FROM r GROUP BY user_id, batch"""


@query(_PACKED.format(where=""))
def capped_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events packed in order into batches of at most 300: a table function that streams a partition."""
    events = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return packed(events, ["user_id"], ["ts", "event_id"], "value", 300).withColumn("total", F.round("total", 4))


@query(_PACKED.format(where=" WHERE event_type = 'purchase'"))
def capped_batches_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same function in SQL, with its PARTITION BY and ORDER BY."""
    register(spark)
    rows = load(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    made = spark.sql("SELECT * FROM capped_batches(TABLE({rows}) PARTITION BY user_id ORDER BY (ts, event_id), 'user_id', 'value', 300D)", rows=rows)
    return made.withColumn("total", F.round("total", 4))


@query("""
SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_custkey % 40, 7) AS a, nullif(o_orderpriority, '3-MEDIUM') AS b FROM orders) l
WHERE NOT EXISTS (SELECT 1 FROM (SELECT nullif(c_custkey % 40, 11) AS c, CASE WHEN c_nationkey < 12 THEN '1-URGENT' WHEN c_nationkey = 13 THEN NULL ELSE '2-HIGH' END AS d FROM customer WHERE c_acctbal < 500) r
                  WHERE (a = c OR a IS NULL OR c IS NULL) AND (b = d OR b IS NULL OR d IS NULL))""")
def not_in_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b) NOT IN (SELECT c, d ...) with nulls in every column."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 40, F.lit(7)).alias("a"), F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("b"))
    nation = F.col("c_nationkey")
    priority = F.when(nation < 12, "1-URGENT").when(nation != 13, "2-HIGH")
    customers = load(spark, sf_dir, "customer").where("c_acctbal < 500").select(F.nullif(F.col("c_custkey") % 40, F.lit(11)).alias("c"), priority.alias("d"))
    return not_in(orders, customers, ["a", "b"], ["c", "d"]).select("o_orderkey")


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE nullif(o_custkey, 5) NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 48)""")
def not_in_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").withColumn("k", F.nullif("o_custkey", F.lit(5)))
    lines = load(spark, sf_dir, "lineitem").where("l_quantity > 48")
    return not_in(orders, lines, ["k"], ["l_suppkey"]).select("o_orderkey", "o_custkey")


_SESSIONS = """(SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 4 HOUR AS b FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE event_type IN ({kinds}))) GROUP BY user_id, s)"""


@query(f"""
SELECT v.user_id, v.a AS view_start, c.a AS click_start, CAST(epoch_us(least(v.b, c.b)) - epoch_us(greatest(v.a, c.a)) AS BIGINT) AS shared_us
FROM {_SESSIONS.format(kinds="'view', 'error'")} v JOIN {_SESSIONS.format(kinds="'click', 'purchase'")} c ON v.user_id = c.user_id AND v.a < c.b AND c.a < v.b""")
def overlapping_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's sessions of looking and of doing that share time, and how much. Spans of very different length, by microseconds."""
    events = load(spark, sf_dir, "events")

    def spans(kinds: list[str], name: str) -> DataFrame:
        made = sessions(events.where(F.col("event_type").isin(kinds)), ["user_id"], "ts", "4 hours", [])
        micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        return made.select("user_id", F.col("session_start").alias(f"{name}_start"), micros("session_start").alias(f"{name}_a"), micros("session_end").alias(f"{name}_b"))

    pairs = overlap_join(spans(["view", "error"], "view"), spans(["click", "purchase"], "click"), ("view_a", "view_b"), ("click_a", "click_b"), 4 * 3600 * 1_000_000, ["user_id"])
    return pairs.select("user_id", "view_start", "click_start", (F.least("view_b", "click_b") - F.greatest("view_a", "click_a")).alias("shared_us"))


@query("""
SELECT o_orderkey, c_name, c_acctbal FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) LEFT JOIN customer ON k = c_custkey""")
def hot_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the orders are one customer's: that key is found on a sample and salted, and no other."""
    key = F.when(F.col("o_orderkey") % 2 == 0, 1).when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", key.cast("bigint").alias("c_custkey"))
    return salted_join(orders, load(spark, sf_dir, "customer"), ["c_custkey"], "left").select("o_orderkey", "c_name", "c_acctbal")


@query("SELECT p_partkey, round(jaro_winkler_similarity(p_name, p_type), 6) AS score FROM part")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure that built-in functions don't have, over Arrow arrays."""
    return load(spark, sf_dir, "part").select("p_partkey", F.round(similar("p_name", "p_type"), 6).alias("score"))


@query()
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches stored for each event type and day, then merged to types without the rows. The error bounds are tested."""
    events = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    path = shared_path(spark, "sketches")
    slice_sketches(events, ["event_type", "day"], "value", "user_id").write.parquet(path)
    merged = merge_sketches(spark.read.parquet(path), ["event_type"])
    return read_sketches(merged, {"low": 0.05, "mid": 0.5, "high": 0.95})


@query("""
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01' GROUP BY o_orderpriority""")
def quarter_from_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as Arrow shards by date; the filter of a quarter opens the shards that it touches, and no others."""
    path = shared_path(spark, "orders-shards")
    write_shards(load(spark, sf_dir, "orders"), path, "o_orderdate", 32)
    quarter = read_shards(spark, path).where("o_orderdate >= timestamp_ntz'1997-01-01' AND o_orderdate < timestamp_ntz'1997-04-01'")
    return quarter.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
