"""Joins, aggregates, grouping sets, latest rows and upserts over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.catalog import table
from lattice.operators import latest
from lattice.plans.registry import query


@query("q1", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(net), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"),
    )


@query("q3", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("1995-03-15").cast("timestamp_ntz")
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < day)
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > day)
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    out = joined.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return out.orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("q5", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    nations = t["nation"].join(t["region"].where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    suppliers = t["supplier"].join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    joined = (
        t["lineitem"].join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"], (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    )
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("q6", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.where((F.col("l_shipdate") >= F.lit("1994-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("latest_event_per_user", """
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return latest.latest_by(events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("lateral_top1_order", """
SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderkey, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey""")
def lateral_top1_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    last = latest.latest_by(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("three_way_fanout_join", """
SELECT o_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
WHERE c_nationkey = 3""")
def three_way_fanout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "l_linenumber", "c_name")


@query("distinct_pairs_join", """
SELECT DISTINCT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def distinct_pairs_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_mktsegment").distinct()


@query("left_anti_customers", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def left_anti_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return latest.delete_unreferenced(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("left_semi_suppliers", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)")
def left_semi_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(li, "s_suppkey", "left_semi")


@query("status_counts", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high FROM events GROUP BY event_type")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high"))


@query("having_expired_users", """
SELECT user_id, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY user_id
HAVING max(ts) < TIMESTAMP '2024-01-31 12:00:00' ORDER BY last_ts, user_id LIMIT 50""")
def having_expired_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("last_ts") < F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")).orderBy("last_ts", "user_id").limit(50)


@query("rollup_region_nation", """
SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_region_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("cube_flag_status", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_flag_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))


@query("mode_offset", """
WITH d AS (SELECT l_suppkey, l_linenumber - (l_partkey % 5) AS diff, min(l_orderkey * 10 + l_linenumber) AS seen, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, diff, n FROM d QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, seen) = 1""")
def mode_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_linenumber") - F.col("l_partkey") % 5).alias("diff"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    counted = li.groupBy("l_suppkey", "diff").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("seen"))
    best = counted.groupBy("l_suppkey").agg(F.max_by(F.struct("diff", "n"), F.struct("n", -F.col("seen"))).alias("b"))
    return best.select("l_suppkey", "b.diff", "b.n")


@query("max_score_per_key", """
SELECT l_partkey, arg_max(l_orderkey, (l_extendedprice, -l_orderkey)) AS best_order, max(l_extendedprice) AS best_price FROM lineitem GROUP BY l_partkey""")
def max_score_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey")
    return g.agg(F.max_by("l_orderkey", F.struct("l_extendedprice", -F.col("l_orderkey"))).alias("best_order"), F.max("l_extendedprice").alias("best_price"))


@query("latest_wins_upsert", """
WITH o AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'MACHINERY'),
n AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name || '*' END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_nationkey >= 12)
SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name,
       CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal
FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_nationkey >= 12").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.concat("c_name", F.lit("*"))).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return latest.upsert(c.where("c_mktsegment <> 'MACHINERY'"), new, ["c_custkey"], ["c_name"])


@query("insert_if_absent", """
SELECT c_custkey, 'old' AS origin FROM customer WHERE c_acctbal > 0 UNION ALL
SELECT c_custkey, 'new' FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT c_acctbal > 0""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return latest.insert_if_absent(c.where("c_acctbal > 0").select("c_custkey", F.lit("old").alias("origin")), c.where("c_mktsegment = 'BUILDING'").select("c_custkey").withColumn("origin", F.lit("new")), ["c_custkey"])


@query("replace_owned_subset", """
SELECT event_id, event_type, value FROM events WHERE NOT (event_type = 'click' OR value > 90) UNION ALL
SELECT event_id, 'redo', value / 2 FROM events WHERE event_type = 'click'""")
def replace_owned_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    new = e.where("event_type = 'click'").select("event_id", F.lit("redo").alias("event_type"), (F.col("value") / 2).alias("value"))
    return latest.replace_owned(e, new, (F.col("event_type") == "click") | (F.col("value") > 90))


@query("cascade_clear", """
SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey""")
def cascade_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(gone, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query("order_by_input_ids", """
SELECT p_partkey, p_name, list_position([7, 3, 11, 2], p_partkey::INTEGER) AS pos FROM part WHERE p_partkey IN (7, 3, 11, 2) ORDER BY pos""")
def order_by_input_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [7, 3, 11, 2]
    rows = table(spark, sf_dir, "part").where(F.col("p_partkey").isin(ids)).select("p_partkey", "p_name")
    return rows.withColumn("pos", F.array_position(F.array(*(F.lit(i).cast("long") for i in ids)), F.col("p_partkey")).cast("int")).orderBy("pos")


@query("ready_scope_filter", """
SELECT o_orderkey, coalesce(o_orderpriority, '') AS priority FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (1, 4, 7, 10, 13, 16, 19, 22)""")
def ready_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = list(dict.fromkeys([1, 4, 7, 10, 4, 13, 16, 19, 22, 1]))
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & F.col("o_custkey").isin(ids))
    return rows.select("o_orderkey", F.coalesce("o_orderpriority", F.lit("")).alias("priority"))


@query("nulls_first_order", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY parent ASC NULLS FIRST, o_orderkey) AS pos
FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS parent FROM orders)""")
def nulls_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("parent"))
    w = Window.partitionBy("o_custkey").orderBy(F.asc_nulls_first("parent"), "o_orderkey")
    return rows.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("pos"))


@query("latest_task_of_any_id", """
WITH p AS (SELECT unnest([o_custkey, (o_orderkey % 1000)::BIGINT]) AS id, o_orderkey, o_orderdate FROM orders)
SELECT c_custkey, o_orderkey FROM customer JOIN p ON id = c_custkey
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_task_of_any_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(F.col("o_custkey"), F.col("o_orderkey") % 1000)
    pairs = table(spark, sf_dir, "orders").select(F.explode(ids).alias("c_custkey"), "o_orderkey", "o_orderdate")
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(pairs, "c_custkey")
    return latest.latest_by(joined, ["c_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("c_custkey", "o_orderkey")


@query("latency_stats_by_type", """
SELECT event_type, count(*) AS n, min(value) AS min_v, max(value) AS max_v, round(avg(value), 6) AS avg_v, round(median(value), 6) AS p50,
       quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def latency_stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min_v"), F.max("value").alias("max_v"), F.round(F.avg("value"), 6).alias("avg_v"),
        F.round(F.median("value"), 6).alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"),
    )


@query("json_patch", """
SELECT event_id, json_extract(props, '$.k')::BIGINT AS k_before, CASE WHEN event_type = 'click' THEN 1 ELSE json_extract(props, '$.k')::BIGINT END AS k_after FROM events""")
def json_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k_before"), F.when(F.col("event_type") == "click", F.lit(1).cast("long")).otherwise(k).alias("k_after"))


@query("entity_counts", """
SELECT 'orders' AS entity, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents""")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("entity"), "n") for t in ("orders", "events", "documents")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("ordered_distinct_types", """
WITH f AS (SELECT user_id, event_type, min(ts) AS first_ts, min(event_id) AS first_id FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, ',' ORDER BY first_ts, first_id) AS types FROM f GROUP BY user_id""")
def ordered_distinct_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.min("event_id").alias("first_id"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("first_ts", "first_id", "event_type"))), lambda s: s["event_type"])
    return first.groupBy("user_id").agg(F.array_join(ordered, ",").alias("types"))
