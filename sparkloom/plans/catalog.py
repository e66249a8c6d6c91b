"""The library's own queries and, beside each, the SQL with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkloom.functions.codes import brand_code
from sparkloom.functions.vectors import dot
from sparkloom.operators import asof_join, range_join, sessions, top_k_per_group
from sparkloom.plans.registry import oracle_sql, queries, query
from sparkloom.sources.tables import load

__all__ = ["oracle_sql", "queries"]


@query("""
SELECT n_name, CAST(count(*) AS BIGINT) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1997-01-01'")
    return (
        load(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    )


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc,
       CAST(count(*) AS BIGINT) AS n_lines
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        load(spark, sf_dir, "lineitem")
        .where("l_shipdate <= timestamp_ntz'2000-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
            F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("n_lines"),
        )
    )


@query("SELECT o_orderkey, o_totalprice, upper(o_orderstatus) AS status FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P' AND o_orderpriority LIKE '1%'")
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").where((F.col("o_totalprice") > 1000) & (F.col("o_orderstatus") != "P") & F.col("o_orderpriority").like("1%"))
    return orders.select("o_orderkey", "o_totalprice", F.upper("o_orderstatus").alias("status"))


@query("SELECT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = load(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return load(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_discount >= 0.09")
    return load(spark, sf_dir, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@query("""
SELECT coalesce(a.k, b.k) AS nationkey, a.n AS n_customers, b.n AS n_suppliers
FROM (SELECT c_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k""")
def full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    suppliers = load(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    return customers.join(suppliers, "nationkey", "full")


@query("""
SELECT event_id, user_id, o_orderkey AS last_order FROM
(SELECT event_id, user_id, ts - INTERVAL 8 YEAR AS at, user_id AS k FROM events) e
ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o
ON e.k = o.o_custkey AND e.at >= o.o_orderdate""")
def asof_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 8 YEARS")).alias("at"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate", F.col("o_orderkey").alias("last_order"))
    return asof_join(events, orders, ["user_id"], "at", "o_orderdate", ["last_order"], split=lambda time: F.date_trunc("month", time)).select("event_id", "user_id", "last_order")


@query("""
SELECT event_id, CAST(count(*) AS BIGINT) AS n_parts, CAST(sum(p_partkey) AS BIGINT) AS keys FROM
(SELECT event_id, CAST(floor(value) AS BIGINT) AS v FROM events) e
JOIN (SELECT p_partkey, CAST(p_size AS BIGINT) * 10 AS lo FROM part) p ON e.v >= p.lo AND e.v < p.lo + 15 GROUP BY event_id""")
def range_join_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one span are summed before the join, so it makes as many rows as there are spans over a point, not parts."""
    points = load(spark, sf_dir, "events").select("event_id", F.floor("value").cast("bigint").alias("v"))
    spans = load(spark, sf_dir, "part").groupBy((F.col("p_size").cast("bigint") * 10).alias("lo")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("sum"))
    pairs = range_join(points, spans.withColumn("hi", F.col("lo") + 15), "v", "lo", "hi", 16)
    return pairs.groupBy("event_id").agg(F.sum("n").alias("n_parts"), F.sum("sum").alias("keys"))


@query("SELECT n_name, s_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def right_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = load(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    return rich.join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM orders)")
def scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    mean = orders.agg(F.avg("o_totalprice"))
    return orders.where(F.col("o_totalprice") > 1.5 * mean.scalar()).select("o_orderkey", "o_totalprice")


@query("""
SELECT s_suppkey, n_lines, quantity FROM supplier, LATERAL (SELECT CAST(count(*) AS BIGINT) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_suppkey = s_suppkey) x""")
def lateral_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").where(F.col("l_suppkey") == F.col("s_suppkey").outer())
    totals = lines.select(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return load(spark, sf_dir, "supplier").lateralJoin(totals).select("s_suppkey", "n_lines", "quantity")


@query("""
SELECT o_orderpriority, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_customers,
       CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS n_finished, max(o_totalprice) AS top
FROM orders GROUP BY o_orderpriority HAVING count(*) > 10""")
def distinct_and_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.countDistinct("o_custkey").alias("n_customers"), F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"), F.max("o_totalprice").alias("top"), F.count("*").alias("n")
    )
    return made.where("n > 10").drop("n")


@query("""
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(grouping(l_returnflag) AS INTEGER) AS g
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("int").alias("g"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("SELECT c_mktsegment, c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    return load(spark, sf_dir, "customer").groupingSets([[segment], [nation], []], segment, nation).agg(F.count("*").alias("n"))


@query("""
SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchase
FROM events GROUP BY user_id""")
def pivot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = load(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "purchase"]).count()
    return made.select("user_id", F.coalesce("click", F.lit(0)).alias("click"), F.coalesce("purchase", F.lit(0)).alias("purchase"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'discount' AS measure, l_discount AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'tax', l_tax FROM lineitem")
def unpivot_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return lines.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["discount", "tax"], "measure", "amount")


@query("""
SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS n, lag(event_type) OVER w AS before, round(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select("event_id", F.row_number().over(w).alias("n"), F.lag("event_type").over(w).alias("before"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("last3"))


@query("""
SELECT event_id, lead(event_type) OVER w AS after, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS n_recent
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lead_and_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range frame goes by whole numbers: microseconds."""
    by = Window.partitionBy("user_id")
    events = load(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    recent = by.orderBy("at").rangeBetween(-12 * 3600 * 1_000_000, 0)
    return events.select("event_id", F.lead("event_type").over(by.orderBy("ts", "event_id")).alias("after"), F.count("*").over(recent).alias("n_recent"))


@query("""
SELECT o_orderkey, o_custkey, CAST(rank AS INTEGER) AS rank FROM (
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_per_group(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_orderkey", "o_custkey", "rank")


@query("SELECT c_custkey, c_acctbal, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INTEGER) AS d, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INTEGER) AS q FROM customer")
def rank_and_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("c_nationkey")
    return load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.dense_rank().over(by.orderBy("c_mktsegment")).alias("d"), F.ntile(4).over(by.orderBy("c_acctbal", "c_custkey")).alias("q"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(load(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(load(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
def intersect_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).intersect(load(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def except_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(load(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_custkey"))


@query("SELECT o_custkey AS k, 'order' AS kind FROM orders UNION ALL SELECT user_id, 'event' FROM events")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("kind"))
    return orders.unionAll(load(spark, sf_dir, "events").select("user_id", F.lit("event")))


@query("SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(load(spark, sf_dir, "events").select("user_id")).distinct()


@query("""
SELECT l_orderkey, l_partkey, l_quantity FROM lineitem l JOIN (SELECT l_partkey AS k, avg(l_quantity) AS a FROM lineitem GROUP BY 1) m ON l_partkey = k
WHERE l_quantity < 0.2 * a""")
def correlated_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    means = lines.groupBy("l_partkey").agg(F.avg("l_quantity").alias("a"))
    return lines.join(means, "l_partkey").where("l_quantity < 0.2 * a").select("l_orderkey", "l_partkey", "l_quantity")


@query("""
SELECT doc_id, CAST(length(text) AS BIGINT) AS n, substr(text, 1, 12) AS head, regexp_replace(source, '[0-9]+', '#', 'g') AS kind,
       CAST(len(string_split(text, ' ')) AS BIGINT) AS parts, md5(text) AS digest FROM documents""")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        F.length("text").cast("bigint").alias("n"),
        F.substring("text", 1, 12).alias("head"),
        F.regexp_replace("source", "[0-9]+", "#").alias("kind"),
        F.size(F.split("text", " ")).cast("bigint").alias("parts"),
        F.md5("text").alias("digest"),
    )


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
       CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").groupBy(F.year(at).alias("y"), F.quarter(at).alias("q"), F.trunc(at.cast("date"), "month").alias("m")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(sqrt(abs(value)), 6) AS root, CAST(floor(value) AS BIGINT) AS low FROM events")
def json_and_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.round(F.sqrt(F.abs("value")), 6).alias("root"), F.floor("value").alias("low"))


@query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS square,
       round(CAST(list_max(embedding) AS DOUBLE), 5) AS top FROM embeddings""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(v, v), 5).alias("square"), F.round(F.array_max(v).cast("double"), 5).alias("top"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = load(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return made.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("""
SELECT start AS window_start, CAST(count(*) AS BIGINT) AS n FROM (
SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 2 HOUR]) AS start FROM events) GROUP BY start""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = load(spark, sf_dir, "events").groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("window_start"), "n")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS rest FROM events")
def parsed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return parsed.select("event_id", "p.k", (F.col("p.k") % 7).alias("rest"))


@query("""
SELECT event_type, TRUE AS count_is_close, TRUE AS median_is_close, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users,
       quantile_disc(value, 0.5) AS mid, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type""")
def approximate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches held against the exact values, which need no set and no sort of a type's rows: distinct users are grouped, and the
    exact median is looked for between the sketch's 49th and 51st percentiles, ten times the sketch's error away from it.
    """
    events = load(spark, sf_dir, "events")
    about = events.groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("about"), F.percentile_approx("value", F.array(F.lit(0.49), F.lit(0.5), F.lit(0.51)), 1000).alias("near"), F.count("value").alias("n_values"), F.count("*").alias("n")
    )
    users = events.groupBy("event_type", "user_id").agg(F.count("*")).groupBy("event_type").agg(F.count("user_id").alias("n_users"))
    sides = F.broadcast(about.select(F.col("event_type").alias("_type"), "near", "n_values"))
    between = F.greatest(F.least("value", F.col("near")[2]), F.col("near")[0])  # values outside count at the ends
    cells = events.where("value IS NOT NULL").join(sides, F.col("event_type").eqNullSafe(F.col("_type"))).groupBy("event_type", between.alias("v"), F.col("near")[1].alias("sketched"), "n_values").agg(F.count("*").alias("n_v"))
    upto = cells.withColumn("upto", F.sum("n_v").over(Window.partitionBy("event_type").orderBy("v")))
    exact = upto.groupBy("event_type").agg(
        F.min(F.when(F.col("upto") * 2 >= F.col("n_values"), F.col("v"))).alias("mid"),
        ((F.sum(F.when(F.col("v") < F.col("sketched"), F.col("n_v")).otherwise(0)) <= 0.51 * F.first("n_values")) & (F.max(F.when(F.col("v") <= F.col("sketched"), F.col("upto")).otherwise(0)) >= 0.49 * F.first("n_values"))).alias("is_close"),
    )
    users, exact = users.withColumnRenamed("event_type", "_users"), exact.withColumnRenamed("event_type", "_exact")
    made = about.join(users, F.col("event_type").eqNullSafe(F.col("_users"))).join(exact, F.col("event_type").eqNullSafe(F.col("_exact")), "left")
    count_is_close = F.abs(F.col("about") - F.col("n_users")) <= 0.1 * F.col("n_users") + 2
    return made.select("event_type", count_is_close.alias("count_is_close"), F.coalesce("is_close", F.lit(True)).alias("median_is_close"), "n_users", "mid", "n")


@query("SELECT p_partkey, upper(substr(p_brand, 1, 1)) || CAST(length(p_name) AS VARCHAR) AS code FROM part")
def vectorised_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function over Arrow arrays, batch by batch. Built-in functions could do this one; name_similarity is one that they can't."""
    return load(spark, sf_dir, "part").select("p_partkey", brand_code("p_brand", "p_name").alias("code"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) // 1000 AS block, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id, text")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lateral join with a table function: rows of one row."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.lateralJoin(spark.tvf.explode(F.split(F.col("text").outer(), "\n")))
    return lines.groupBy("doc_id", F.floor(F.length("text") / 1000).alias("block")).agg(F.count("*").alias("n"))


@query("""
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, CAST(count(*) AS BIGINT) AS n FROM (
SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(load(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours", [F.count("*").alias("n")])


@query("""
SELECT c_nationkey, round(stddev_samp(c_acctbal), 4) AS sd, round(corr(c_acctbal, c_custkey), 6) AS r, round(median(c_acctbal), 4) AS mid FROM customer GROUP BY c_nationkey""")
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"), F.round(F.corr("c_acctbal", "c_custkey"), 6).alias("r"), F.round(F.median("c_acctbal"), 4).alias("mid"))
