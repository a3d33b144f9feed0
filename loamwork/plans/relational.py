"""General relational queries over the star schema: joins, aggregates, sets, windows, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query, table


@query("rel_01_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(avg(l_discount), 8) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def rel_01(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(price), 4).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 4).alias("sum_disc"),
        F.round(F.avg("l_discount"), 8).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("rel_02_top_orders", """SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def rel_02(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(li, o.o_orderkey == li.l_orderkey)
    return rows.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum("v"), 4).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("rel_03_nation_revenue", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def rel_03(spark, sf):
    places = table(spark, sf, "nation").join(table(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = table(spark, sf, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query("rel_04_forecast", "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24")
def rel_04(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_discount").between(0.02, 0.06) & (F.col("l_quantity") < 24))
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("revenue"))


@query("rel_05_left_join_counts", "SELECT n, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) GROUP BY n")
def rel_05(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return rows.groupBy("n").agg(F.count("*").alias("customers"))


@query("rel_06_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def rel_06(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("rel_07_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_07(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("rel_08_range_join", "SELECT b.lo, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN (SELECT unnest(generate_series(0, 90, 10)) AS lo) b ON value >= b.lo AND value < b.lo + 10 GROUP BY b.lo")
def rel_08(spark, sf):
    bands = spark.range(0, 100, 10).select(F.col("id").alias("lo"))
    rows = table(spark, sf, "events").join(F.broadcast(bands), (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("lo") + 10))
    return rows.groupBy("lo").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("rel_09_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def rel_09(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("rel_10_set_operations", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
def rel_10(spark, sf):
    o = table(spark, sf, "orders")
    keys = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return keys("F").intersect(keys("O")).subtract(table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey"))


@query("rel_11_running_total", "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS total, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def rel_11(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    total = F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4)
    return table(spark, sf, "events").select("user_id", "event_id", total.alias("total"), F.lag("event_type").over(w).alias("previous"))


@query("rel_12_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem) WHERE rank <= 3")
def rel_12(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("rel_13_as_of_join", """SELECT a.event_id, max_by(b.event_id, (b.ts, b.event_id)) AS view_id FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' AND b.ts <= a.ts WHERE a.event_type = 'purchase' OR a.event_type = 'error' GROUP BY a.event_id""")
def rel_13(spark, sf):
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("view_id", last).where("event_type in ('purchase', 'error')").select("event_id", "view_id")


@query("rel_14_pivot", "SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY user_id")
def rel_14(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["view", "click"]).agg(F.count(F.lit(1)))
    return rows.select("user_id", F.coalesce("view", F.lit(0)).alias("views"), F.coalesce("click", F.lit(0)).alias("clicks"))
