"""Tier B: the relational surface a user reaches through the SQL tools (B01-B28),
expressed with the DataFrame API on the TPC-H-like tables and ``events``.

Doubles are rounded in both engines before comparison; null order is always
explicit because Spark sorts nulls first ascending and DuckDB last.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.operators import relational as rel
from textmill.plans.registry import register
from textmill.session import read_table


def T(spark, sf, name):
    return read_table(spark, sf, name)


@register("sql_filter_project", oracle="""
  SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
         CASE WHEN l_quantity >= 40 THEN 'large' WHEN l_quantity >= 20 THEN 'medium' ELSE 'small' END AS size_class,
         l_shipdate IS NULL AS no_ship
  FROM lineitem
  WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag IN ('R', 'A') AND l_linestatus LIKE 'F%'""")
def sql_filter_project(spark, sf):
    li = T(spark, sf, "lineitem")
    return li.filter(F.col("l_discount").between(0.02, 0.06) & F.col("l_returnflag").isin("R", "A")
                     & F.col("l_linestatus").like("F%")).select(
        "l_orderkey", "l_linenumber",
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"),
        F.when(F.col("l_quantity") >= 40, "large").when(F.col("l_quantity") >= 20, "medium")
        .otherwise("small").alias("size_class"),
        F.col("l_shipdate").isNull().alias("no_ship"))


@register("sql_join_inner", oracle="""
  SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def sql_join_inner(spark, sf):
    o, c = T(spark, sf, "orders"), T(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(
        F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@register("sql_join_broadcast", oracle="""
  SELECT n_name, r_name, count(*) AS n_customers, round(avg(c_acctbal), 4) AS avg_bal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY n_name, r_name""")
def sql_join_broadcast(spark, sf):
    c, n, r = T(spark, sf, "customer"), T(spark, sf, "nation"), T(spark, sf, "region")
    # Spark broadcasts the dimensions while their size is under spark.sql.autoBroadcastJoinThreshold
    dim = n.join(r, n.n_regionkey == r.r_regionkey)
    return c.join(dim, c.c_nationkey == dim.n_nationkey).groupBy("n_name", "r_name").agg(
        F.count("*").alias("n_customers"), F.round(F.avg("c_acctbal"), 4).alias("avg_bal"))


@register("sql_join_outer", oracle="""
  SELECT coalesce(c.c_custkey, o.o_custkey) AS custkey, count(o.o_orderkey) AS n_orders,
         max(c.c_name) AS c_name
  FROM customer c FULL OUTER JOIN orders o ON c.c_custkey = o.o_custkey
  GROUP BY coalesce(c.c_custkey, o.o_custkey)""")
def sql_join_outer(spark, sf):
    c, o = T(spark, sf, "customer"), T(spark, sf, "orders")
    j = c.join(o, c.c_custkey == o.o_custkey, "full")
    return j.groupBy(F.coalesce("c_custkey", "o_custkey").alias("custkey")).agg(
        F.count("o_orderkey").alias("n_orders"), F.max("c_name").alias("c_name"))


@register("sql_join_left_right", oracle="""
  SELECT 'left' AS side, count(*) AS n_rows, count(o_orderkey) AS n_matched
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT 'right', count(*), count(c_custkey)
  FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'""")
def sql_join_left_right(spark, sf):
    c, o = T(spark, sf, "customer"), T(spark, sf, "orders")
    left = c.join(o, (c.c_custkey == o.o_custkey) & (o.o_orderpriority == "1-URGENT"), "left").agg(
        F.lit("left").alias("side"), F.count("*").alias("n_rows"), F.count("o_orderkey").alias("n_matched"))
    right = c.join(o, (c.c_custkey == o.o_custkey) & (c.c_mktsegment == "BUILDING"), "right").agg(
        F.lit("right").alias("side"), F.count("*").alias("n_rows"), F.count("c_custkey").alias("n_matched"))
    return left.unionByName(right)


@register("sql_semi_anti", oracle="""
  SELECT 'with_orders' AS kind, count(*) AS n FROM customer c
   WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
  UNION ALL
  SELECT 'without_orders', count(*) FROM customer c
   WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
  UNION ALL
  SELECT 'labelled_docs', count(*) FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL
  SELECT 'unlabelled_docs', count(*) FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def sql_semi_anti(spark, sf):
    c, o = T(spark, sf, "customer"), T(spark, sf, "orders")
    d, lb = T(spark, sf, "documents").select("doc_id"), T(spark, sf, "labels").select("doc_id")
    keys = o.select(F.col("o_custkey").alias("c_custkey"))
    parts = [
        c.join(keys, "c_custkey", "left_semi").agg(F.lit("with_orders").alias("kind"), F.count("*").alias("n")),
        c.join(keys, "c_custkey", "left_anti").agg(F.lit("without_orders").alias("kind"), F.count("*").alias("n")),
        d.join(lb, "doc_id", "left_semi").agg(F.lit("labelled_docs").alias("kind"), F.count("*").alias("n")),
        d.join(lb, "doc_id", "left_anti").agg(F.lit("unlabelled_docs").alias("kind"), F.count("*").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("sql_join_range", oracle="""
  SELECT p.p_size AS p_size, count(*) AS n_pairs
  FROM part p JOIN (SELECT * FROM (VALUES (1, 10), (11, 25), (26, 50)) t(lo, hi)) b
    ON p.p_size BETWEEN b.lo AND b.hi
  GROUP BY p.p_size""")
def sql_join_range(spark, sf):
    p = T(spark, sf, "part")
    bands = spark.createDataFrame([(1, 10), (11, 25), (26, 50)], "lo int, hi int")
    # The band table is a fixed 3-row constant; the non-equi join runs as a broadcast nested loop.
    j = p.join(F.broadcast(bands), p.p_size.between(F.col("lo"), F.col("hi")))
    return j.groupBy("p_size").agg(F.count("*").alias("n_pairs"))


@register("sql_join_asof", oracle="""
  SELECT e.event_id, e.user_id, p.event_id AS prev_purchase_id,
         round(p.value, 4) AS prev_purchase_value
  FROM (SELECT * FROM events WHERE event_type = 'error') e
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON e.user_id = p.user_id AND e.ts >= p.ts""")
def sql_join_asof(spark, sf):
    ev = T(spark, sf, "events")
    left = ev.filter(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    right = ev.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("r_id"), "user_id", F.col("ts").alias("r_ts"), F.col("value").alias("r_value"))
    out = rel.asof_join(left, right, by="user_id", left_ts="ts", right_ts="r_ts",
                        right_cols=["r_id", "r_value"], left_order="event_id", right_order="r_id")
    return out.select("event_id", "user_id", F.col("r_id").alias("prev_purchase_id"),
                      F.round("r_value", 4).alias("prev_purchase_value"))


@register("sql_join_interval", oracle="""
  SELECT a.event_id, count(b.event_id) AS n_within_10min
  FROM (SELECT * FROM events WHERE event_type = 'error') a
  LEFT JOIN events b ON a.user_id = b.user_id AND b.event_id <> a.event_id
   AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE
  GROUP BY a.event_id""")
def sql_join_interval(spark, sf):
    ev = T(spark, sf, "events")
    a = ev.filter(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    b = ev.select(F.col("event_id").alias("b_id"), F.col("user_id").alias("b_user"), F.col("ts").alias("b_ts"))
    j = rel.interval_join(a, b, left_key="user_id", right_key="b_user", left_ts="ts", right_ts="b_ts",
                          seconds=600, how="left", extra=F.col("b_id") != F.col("event_id"))
    return j.groupBy("event_id").agg(F.count("b_id").alias("n_within_10min"))


@register("sql_agg_basic", oracle="""
  SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
         round(sum(l_extendedprice), 2) AS sum_base_price,
         round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
         round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
         round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc,
         min(l_shipdate) AS min_ship, max(l_shipdate) AS max_ship, count(*) AS count_order
  FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def sql_agg_basic(spark, sf):
    li = T(spark, sf, "lineitem")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(disc), 2).alias("sum_disc_price"),
        F.round(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.min("l_shipdate").alias("min_ship"), F.max("l_shipdate").alias("max_ship"),
        F.count("*").alias("count_order"))


@register("sql_agg_distinct", oracle="""
  SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_suppkey) AS n_supp,
         count(DISTINCT l_partkey) AS n_parts
  FROM lineitem GROUP BY l_returnflag""")
def sql_agg_distinct(spark, sf):
    li = T(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(
        F.count_distinct("l_orderkey").alias("n_orders"), F.count_distinct("l_suppkey").alias("n_supp"),
        F.count_distinct("l_partkey").alias("n_parts"))


@register("sql_agg_approx_distinct", oracle="""
  SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders, true AS near FROM lineitem GROUP BY l_returnflag""")
def sql_agg_approx_distinct(spark, sf):
    """HyperLogLog++ (rsd 1%) beside the exact count: within 3 %.  Both are over the distinct orders, which
    leave a sketch as it is: beside a distinct count, Spark would carry a sketch of 13 KB an order."""
    orders = T(spark, sf, "lineitem").select("l_returnflag", "l_orderkey").distinct()
    near = orders.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.01).alias("approx"),
                                              F.count("l_orderkey").alias("n_orders"))
    return near.select("l_returnflag", "n_orders", (F.abs(F.col("approx") - F.col("n_orders")) <= 0.03 * F.col("n_orders")).alias("near"))


@register("sql_grouping_sets", oracle="""
  SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty,
         grouping(l_returnflag) AS g_flag, grouping(l_linestatus) AS g_status
  FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def sql_grouping_sets(spark, sf):
    li = T(spark, sf, "lineitem")
    li.createOrReplaceTempView("lineitem_gs")
    return spark.sql("""
      SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty,
             cast(grouping(l_returnflag) AS int) AS g_flag, cast(grouping(l_linestatus) AS int) AS g_status
      FROM lineitem_gs GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")


@register("sql_rollup", oracle="""
  SELECT r_name, n_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS bal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ROLLUP (r_name, n_name)""")
def sql_rollup(spark, sf):
    c, n, r = T(spark, sf, "customer"), T(spark, sf, "nation"), T(spark, sf, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n_customers"),
                                            F.round(F.sum("c_acctbal"), 2).alias("bal"))


@register("sql_cube", oracle="""
  SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total,
         grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS gid
  FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def sql_cube(spark, sf):
    o = T(spark, sf, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.grouping_id().cast("int").alias("gid"))


@register("sql_agg_filter", oracle="""
  SELECT o_custkey, count(*) AS n_orders,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS n_finished,
         round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent_total
  FROM orders GROUP BY o_custkey HAVING count(*) >= 15""")
def sql_agg_filter(spark, sf):
    o = T(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"),
        F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_finished"),
        F.round(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))), 2).alias("urgent_total"),
    ).filter(F.col("n_orders") >= 15)


@register("sql_agg_stats", oracle="""
  SELECT event_type, round(stddev_samp(value), 4) AS sd, round(var_pop(value), 4) AS vp,
         round(corr(value, cast(user_id AS DOUBLE)), 6) AS corr_uv,
         round(quantile_cont(value, 0.5), 4) AS median_value,
         round(quantile_cont(value, 0.9), 4) AS p90
  FROM events GROUP BY event_type""")
def sql_agg_stats(spark, sf):
    ev = T(spark, sf, "events")
    moments = ev.groupBy("event_type").agg(
        F.round(F.stddev_samp("value"), 4).alias("sd"), F.round(F.var_pop("value"), 4).alias("vp"),
        F.round(F.corr("value", F.col("user_id").cast("double")), 6).alias("corr_uv"))
    ranks = rel.exact_quantiles(ev, ["event_type"], "value", [0.5, 0.9]).groupBy("event_type").agg(
        *[F.round(F.max(F.when(F.col("prob") == p, F.col("quantile"))), 4).alias(n) for p, n in ((0.5, "median_value"), (0.9, "p90"))])
    return moments.join(ranks, "event_type")


@register("sql_agg_list", oracle="""
  SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS order_keys,
         string_agg(o_orderstatus, '' ORDER BY o_orderdate, o_orderkey) AS statuses
  FROM orders GROUP BY o_custkey""")
def sql_agg_list(spark, sf):
    o = T(spark, sf, "orders")
    g = o.groupBy("o_custkey").agg(
        F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("l"))
    return g.select("o_custkey", F.col("l.o_orderkey").alias("order_keys"),
                    F.array_join("l.o_orderstatus", "").alias("statuses"))


@register("sql_win_rank", oracle="""
  SELECT o_orderkey, o_custkey,
         row_number() OVER w AS rn, rank() OVER w AS rnk, dense_rank() OVER w AS drnk,
         ntile(4) OVER w AS quartile, round(percent_rank() OVER w, 6) AS pct, round(cume_dist() OVER w, 6) AS cd
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
def sql_win_rank(spark, sf):
    o = T(spark, sf, "orders")
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.select("o_orderkey", "o_custkey",
                    F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rnk"),
                    F.dense_rank().over(w).alias("drnk"), F.ntile(4).over(w).alias("quartile"),
                    F.round(F.percent_rank().over(w), 6).alias("pct"),
                    F.round(F.cume_dist().over(w), 6).alias("cd"))


@register("sql_win_analytic", oracle="""
  SELECT event_id, user_id,
         lag(event_type) OVER w AS prev_type, lead(event_type) OVER w AS next_type,
         first_value(event_id) OVER w AS first_id,
         last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id,
         nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_id
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def sql_win_analytic(spark, sf):
    ev = T(spark, sf, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    wf = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return ev.select("event_id", "user_id",
                     F.lag("event_type").over(w).alias("prev_type"), F.lead("event_type").over(w).alias("next_type"),
                     F.first("event_id").over(w).alias("first_id"), F.last("event_id").over(wf).alias("last_id"),
                     F.nth_value("event_id", 2).over(wf).alias("second_id"))


@register("sql_win_frame", oracle="""
  SELECT event_id, user_id,
         round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS sum_last3,
         round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS avg_nbr,
         count(*) OVER (PARTITION BY user_id ORDER BY cast(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n_last_hour,
         round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running
  FROM events""")
def sql_win_frame(spark, sf):
    ev = T(spark, sf, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    wr = W.partitionBy("user_id").orderBy(secs).rangeBetween(-3600, 0)
    return ev.select("event_id", "user_id",
                     F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("sum_last3"),
                     F.round(F.avg("value").over(w.rowsBetween(-1, 1)), 4).alias("avg_nbr"),
                     F.count("*").over(wr).alias("n_last_hour"),
                     F.round(F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)), 4).alias("running"))


@register("sql_topk", oracle="""
  SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice
  FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20""")
def sql_topk(spark, sf):
    o = T(spark, sf, "orders")
    return o.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(20).select(
        "o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@register("sql_topk_group", oracle="""
  SELECT c_nationkey, c_custkey, round(c_acctbal, 2) AS c_acctbal, rn FROM (
    SELECT c_nationkey, c_custkey, c_acctbal,
           row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rn
    FROM customer) WHERE rn <= 3""")
def sql_topk_group(spark, sf):
    c = T(spark, sf, "customer")
    return rel.top_k_per_group(c, ["c_nationkey"], [F.desc_nulls_last("c_acctbal"), F.col("c_custkey")], 3) \
        .select("c_nationkey", "c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), "rn")


@register("sql_set_ops", oracle="""
  SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer)
  UNION ALL SELECT 'union_all', count(*) FROM (SELECT o_custkey FROM orders UNION ALL SELECT c_custkey FROM customer)
  UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)
  UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
  UNION ALL SELECT 'intersect_all', count(*) FROM (SELECT l_suppkey FROM lineitem INTERSECT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')
  UNION ALL SELECT 'except_all', count(*) FROM (SELECT l_suppkey FROM lineitem EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')""")
def sql_set_ops(spark, sf):
    o = T(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    c = T(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    li = T(spark, sf, "lineitem")
    s_all = li.select("l_suppkey")
    s_r = li.filter(F.col("l_returnflag") == "R").select("l_suppkey")

    def cnt(df, name):
        return df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))

    parts = [cnt(o.union(c).distinct(), "union"), cnt(o.unionAll(c), "union_all"),
             cnt(o.intersect(c), "intersect"), cnt(c.subtract(o), "except"),
             cnt(s_all.intersectAll(s_r), "intersect_all"), cnt(s_all.exceptAll(s_r), "except_all")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("sql_subquery", oracle="""
  SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal,
         (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders
  FROM customer c
  WHERE c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)""")
def sql_subquery(spark, sf):
    T(spark, sf, "customer").createOrReplaceTempView("customer_sq")
    T(spark, sf, "orders").createOrReplaceTempView("orders_sq")
    return spark.sql("""
      SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal,
             (SELECT count(*) FROM orders_sq o WHERE o.o_custkey = c.c_custkey) AS n_orders
      FROM customer_sq c
      WHERE c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer_sq c2 WHERE c2.c_nationkey = c.c_nationkey)""")


@register("sql_cte", oracle="""
  WITH cust_rev AS (
    SELECT o_custkey, sum(o_totalprice) AS rev FROM orders GROUP BY o_custkey),
  seg AS (
    SELECT c_mktsegment, c_custkey, rev FROM customer JOIN cust_rev ON c_custkey = o_custkey)
  SELECT c_mktsegment, count(*) AS n_customers, round(max(rev), 2) AS max_rev, round(avg(rev), 4) AS avg_rev
  FROM seg GROUP BY c_mktsegment""")
def sql_cte(spark, sf):
    o, c = T(spark, sf, "orders"), T(spark, sf, "customer")
    rev = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("rev"))
    seg = c.join(rev, c.c_custkey == rev.o_custkey)
    return seg.groupBy("c_mktsegment").agg(F.count("*").alias("n_customers"),
                                           F.round(F.max("rev"), 2).alias("max_rev"),
                                           F.round(F.avg("rev"), 4).alias("avg_rev"))


@register("sql_pivot", oracle="""
  SELECT user_id,
         count(*) FILTER (WHERE event_type = 'click') AS click,
         count(*) FILTER (WHERE event_type = 'error') AS error,
         count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
         count(*) FILTER (WHERE event_type = 'signup') AS signup,
         count(*) FILTER (WHERE event_type = 'view') AS "view"
  FROM events GROUP BY user_id""")
def sql_pivot(spark, sf):
    ev = T(spark, sf, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    return ev.groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).fillna(0, subset=kinds)


@register("sql_unpivot", oracle="""
  SELECT l_orderkey, l_linenumber, metric, round(val, 4) AS val FROM (
    UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem WHERE l_returnflag = 'R')
    ON l_quantity, l_discount, l_tax INTO NAME metric VALUE val)""")
def sql_unpivot(spark, sf):
    li = T(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
    u = li.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "metric", "val")
    return u.select("l_orderkey", "l_linenumber", "metric", F.round("val", 4).alias("val"))


@register("fn_string", oracle="""
  SELECT p_partkey, upper(substr(p_name, 1, 5)) AS head, replace(p_type, ' ', '_') AS type_u,
         split_part(p_type, ' ', 2) AS type_word2, lpad(cast(p_size AS VARCHAR), 3, '0') AS size_pad,
         regexp_extract(p_brand, '[0-9]+') AS brand_no, length(p_name) AS name_len,
         concat(lower(p_brand), '/', p_size) AS tag, reverse(p_brand) AS rev,
         position('a' IN p_name) AS pos_a, trim('  ' || p_brand || '  ') AS trimmed
  FROM part""")
def fn_string(spark, sf):
    p = T(spark, sf, "part")
    return p.select(
        "p_partkey", F.upper(F.substring("p_name", 1, 5)).alias("head"),
        F.replace("p_type", F.lit(" "), F.lit("_")).alias("type_u"),
        F.split_part("p_type", F.lit(" "), F.lit(2)).alias("type_word2"),
        F.lpad(F.col("p_size").cast("string"), 3, "0").alias("size_pad"),
        F.regexp_extract("p_brand", "[0-9]+", 0).alias("brand_no"),
        F.length("p_name").alias("name_len"),
        F.concat(F.lower("p_brand"), F.lit("/"), F.col("p_size").cast("string")).alias("tag"),
        F.reverse("p_brand").alias("rev"), F.instr("p_name", "a").alias("pos_a"),
        F.trim(F.concat(F.lit("  "), "p_brand", F.lit("  "))).alias("trimmed"))


@register("fn_date", oracle="""
  SELECT o_orderkey, date_trunc('month', o_orderdate) AS month_start,
         extract(year FROM o_orderdate) AS yr, extract(quarter FROM o_orderdate) AS qtr,
         dayofweek(o_orderdate) AS dow,
         datediff('day', o_orderdate, TIMESTAMP '1999-01-01') AS days_to_1999,
         cast(o_orderdate + INTERVAL 3 MONTH AS DATE) AS plus_3m,
         strftime(o_orderdate, '%Y-%m') AS ym
  FROM orders""")
def fn_date(spark, sf):
    o = T(spark, sf, "orders")
    return o.select(
        "o_orderkey", F.date_trunc("month", "o_orderdate").alias("month_start"),
        F.year("o_orderdate").alias("yr"), F.quarter("o_orderdate").alias("qtr"),
        (F.dayofweek("o_orderdate") - 1).alias("dow"),
        F.datediff(F.lit("1999-01-01").cast("date"), F.to_date("o_orderdate")).alias("days_to_1999"),
        F.add_months(F.to_date("o_orderdate"), 3).alias("plus_3m"),
        F.date_format("o_orderdate", "yyyy-MM").alias("ym"))


@register("fn_math", oracle="""
  SELECT l_orderkey, l_linenumber, round(l_extendedprice, 1) AS r1, l_linenumber % 3 AS m3,
         round(power(l_quantity, 2), 2) AS sq, round(ln(l_extendedprice), 6) AS lnp,
         round(sqrt(l_quantity), 6) AS rt, greatest(l_discount, l_tax) AS g, least(l_discount, l_tax) AS l,
         cast(ceil(l_quantity / 7) AS BIGINT) AS c7, cast(floor(l_extendedprice / 1000) AS BIGINT) AS f1000, abs(l_discount - l_tax) AS ad,
         sign(l_discount - l_tax) AS sg
  FROM lineitem""")
def fn_math(spark, sf):
    li = T(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.round("l_extendedprice", 1).alias("r1"),
        (F.col("l_linenumber") % 3).alias("m3"), F.round(F.pow("l_quantity", 2), 2).alias("sq"),
        F.round(F.log("l_extendedprice"), 6).alias("lnp"), F.round(F.sqrt("l_quantity"), 6).alias("rt"),
        F.greatest("l_discount", "l_tax").alias("g"), F.least("l_discount", "l_tax").alias("l"),
        F.ceil(F.col("l_quantity") / 7).alias("c7"), F.floor(F.col("l_extendedprice") / 1000).alias("f1000"),
        F.abs(F.col("l_discount") - F.col("l_tax")).alias("ad"),
        F.signum(F.col("l_discount") - F.col("l_tax")).cast("int").alias("sg"))


@register("fn_array", oracle="""
  SELECT o_custkey, len(ks) AS n, list_sort(list_transform(ks, lambda k: k % 10)) AS last_digits,
         len(list_filter(ks, lambda k: k % 2 = 0)) AS n_even, ks[1] AS first_key,
         list_contains(ks, 1) AS has_1, list_max(ks) AS max_key
  FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders GROUP BY o_custkey)""")
def fn_array(spark, sf):
    o = T(spark, sf, "orders")
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    return g.select("o_custkey", F.size("ks").alias("n"),
                    F.array_sort(F.transform("ks", lambda k: k % 10)).alias("last_digits"),
                    F.size(F.filter("ks", lambda k: k % 2 == 0)).alias("n_even"),
                    F.element_at("ks", 1).alias("first_key"),
                    F.array_contains("ks", 1).alias("has_1"), F.array_max("ks").alias("max_key"))


@register("fn_map", oracle="""
  SELECT user_id, n_types, round(purchase_value, 4) AS purchase_value FROM (
    SELECT user_id, len(map_keys(m)) AS n_types, coalesce(m['purchase'], 0.0) AS purchase_value
    FROM (SELECT user_id, map(list(event_type ORDER BY event_type), list(v ORDER BY event_type)) AS m
          FROM (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY user_id, event_type)
          GROUP BY user_id))""")
def fn_map(spark, sf):
    ev = T(spark, sf, "events")
    per = ev.groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    m = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return m.select("user_id", F.size(F.map_keys("m")).alias("n_types"),
                    F.round(F.coalesce(F.try_element_at("m", F.lit("purchase")), F.lit(0.0)), 4).alias("purchase_value"))


@register("fn_json", oracle="""
  SELECT event_type, cast(sum(cast(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
         max(cast(json_extract(props, '$.k') AS INTEGER)) AS max_k, count(*) AS n
  FROM events GROUP BY event_type""")
def fn_json(spark, sf):
    ev = T(spark, sf, "events")
    parsed = ev.select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k1"),
                       F.from_json("props", "k int").alias("p"))
    return parsed.groupBy("event_type").agg(F.sum("k1").alias("sum_k"), F.max("p.k").alias("max_k"),
                                            F.count("*").alias("n"))
