"""Physical patterns: joins, orderings, ranks, set operations, table access."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import ordered as od
from ..functions.expr import first_of
from ..operators.survival import risk_groups
from ..sources import tables as tb
from .analysis_queries import _PCT
from .registry import query, rounded

# ---- joins -------------------------------------------------------------


@query("join_left_lookup", "SELECT c.customer_id, c.persona, round(s.clv, 3) AS clv FROM t_customers c LEFT JOIN t_summary s USING (customer_id)")
def _(v):
    return rounded(v.customers().join(v.summary().select("customer_id", "clv"), "customer_id", "left").select("customer_id", "persona", "clv"), default=3)


@query("join_outer_coalesce", """WITH a AS (SELECT customer_id, count(*) AS n FROM t_orders WHERE order_time >= TIMESTAMP '2001-01-01' GROUP BY 1), b AS (SELECT customer_id, count(*) AS n FROM t_orders WHERE order_time < TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT customer_id, coalesce(a.n, 0) AS late_orders, coalesce(b.n, 0) AS early_orders FROM a FULL JOIN b USING (customer_id)""")
def _(v):
    o = v.orders()
    a = o.where("order_time >= timestamp_ntz'2001-01-01 00:00:00'").groupBy("customer_id").agg(F.count(F.lit(1)).alias("a"))
    b = o.where("order_time < timestamp_ntz'1996-01-01 00:00:00'").groupBy("customer_id").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "customer_id", "full").selectExpr("customer_id", "coalesce(a, 0) AS late_orders", "coalesce(b, 0) AS early_orders")


@query("join_semi_anti", """SELECT 'with_late_order' AS side, count(*) AS n FROM t_customers WHERE customer_id IN (SELECT customer_id FROM t_orders WHERE order_time >= TIMESTAMP '2001-01-01')
UNION ALL SELECT 'without', count(*) FROM t_customers WHERE customer_id NOT IN (SELECT customer_id FROM t_orders WHERE order_time >= TIMESTAMP '2001-01-01')""")
def _(v):
    late = v.orders().where("order_time >= timestamp_ntz'2001-01-01 00:00:00'").select("customer_id")
    c = v.customers().select("customer_id")
    side = lambda how, name: c.join(late, "customer_id", how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return side("left_semi", "with_late_order").unionByName(side("left_anti", "without"))


@query("join_asof_backward", """WITH g AS (SELECT customer_id, exposure_time FROM t_exposures), o AS (SELECT DISTINCT customer_id, order_time FROM t_orders)
SELECT g.customer_id, g.exposure_time, o.order_time AS last_order FROM g ASOF LEFT JOIN o ON g.customer_id = o.customer_id AND o.order_time <= g.exposure_time""")
def _(v):
    o = v.orders().selectExpr("customer_id", "order_time", "order_time AS last_order")
    return od.asof_backward(v.exposures().select("customer_id", "exposure_time"), o, ["customer_id"], "exposure_time", "order_time", ["last_order"])


@query("join_range_window", """SELECT a.customer_id, count(*) AS orders_0_60d, round(sum(net_amount), 2) AS revenue_0_60d FROM t_assign a JOIN t_orders o ON o.customer_id = a.customer_id AND order_time >= assigned_at AND order_time <= assigned_at + INTERVAL 60 DAY GROUP BY 1""")
def _(v):
    j = v.orders().join(v.assignments().select("customer_id", "assigned_at"), "customer_id").where("order_time >= assigned_at AND order_time <= assigned_at + INTERVAL '60' DAY")
    return rounded(j.groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders_0_60d"), F.sum("net_amount").alias("revenue_0_60d")), default=2)


@query("expand_catalog", "SELECT customer_id, i AS intervention_intensity, round(coupon_cost * CASE i WHEN 'low' THEN 0.65 WHEN 'mid' THEN 1.0 ELSE 1.45 END, 4) AS cost FROM t_assign, (SELECT unnest(['low', 'mid', 'high']) AS i)")
def _(v):
    a = v.assignments().selectExpr("customer_id", "coupon_cost", "inline(array(struct('low' AS intervention_intensity, 0.65D AS m), struct('mid' AS intervention_intensity, 1D AS m), struct('high' AS intervention_intensity, 1.45D AS m)))")
    return rounded(a.selectExpr("customer_id", "intervention_intensity", "coupon_cost * m AS cost"), default=4)


@query("grid_fill", """SELECT p.persona, r.region, count(s.customer_id) AS customers FROM (SELECT DISTINCT persona FROM t_customers) p CROSS JOIN (SELECT DISTINCT region FROM t_customers) r
LEFT JOIN (SELECT * FROM t_summary WHERE churn_probability >= 0.4) s ON s.persona = p.persona AND s.region = r.region GROUP BY 1, 2""")
def _(v):
    c = v.customers()
    # five personas and five regions: the grid is a fixed 25 rows
    grid = c.select("persona").distinct().crossJoin(F.broadcast(c.select("region").distinct()))
    n = v.summary().where("churn_probability >= 0.4").groupBy("persona", "region").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["persona", "region"], "left").selectExpr("persona", "region", "coalesce(n, 0) AS customers")


# ---- aggregation and windows -------------------------------------------


@query("group_many_aggregates", "SELECT persona, count(*) AS n, round(sum(monetary), 2) AS total, round(avg(clv), 3) AS mean_clv, round(min(clv), 3) AS min_clv, round(max(clv), 3) AS max_clv, count(DISTINCT region) AS regions FROM t_summary GROUP BY 1")
def _(v):
    g = v.summary().groupBy("persona").agg(F.count(F.lit(1)).alias("n"), F.sum("monetary").alias("total"), F.avg("clv").alias("mean_clv"), F.min("clv").alias("min_clv"), F.max("clv").alias("max_clv"), F.count_distinct("region").alias("regions"))
    return rounded(g, {"total": 2}, default=3)


@query("exact_quantiles", "SELECT persona, round(quantile_cont(clv, 0.25), 4) AS q25, round(quantile_cont(clv, 0.5), 4) AS q50, round(quantile_cont(clv, 0.9), 4) AS q90 FROM t_summary GROUP BY 1")
def _(v):
    q = od.exact_quantiles(v.summary(), {"clv": "clv"}, [0.25, 0.5, 0.9], by=["persona"])
    return rounded(q.selectExpr("persona", "q_0 AS q25", "q_1 AS q50", "q_2 AS q90"), default=4)


@query("mode_per_group", """SELECT customer_id, item_category FROM (SELECT customer_id, item_category, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, item_category) AS rn FROM t_orders GROUP BY 1, 2) WHERE rn = 1""")
def _(v):
    n = v.orders().groupBy("customer_id", "item_category").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("customer_id").agg(F.expr("min_by(item_category, struct(-n, item_category)) AS item_category"))


@query("pct_rank", f"SELECT customer_id, round({_PCT('frequency')}, 6) AS frequency_rank, round({_PCT('monetary')}, 6) AS monetary_rank FROM t_summary")
def _(v):
    return rounded(od.pct_ranks(v.summary(), "customer_id", {"frequency_rank": "frequency", "monetary_rank": "monetary"}))


@query("tertile_groups", """WITH r AS (SELECT customer_id, row_number() OVER (ORDER BY frequency, customer_id) AS k, count(*) OVER () AS n FROM t_summary)
SELECT customer_id, CASE WHEN k <= 1 + (n - 1) / 3.0 THEN 'Low risk' WHEN k <= 1 + 2 * (n - 1) / 3.0 THEN 'Mid risk' ELSE 'High risk' END AS risk_group FROM r""")
def _(v):
    return risk_groups(v.summary().select("customer_id", "frequency"), "frequency").select("customer_id", "risk_group")


@query("running_total_global", """SELECT order_id, row_number() OVER (ORDER BY order_time, order_id) AS row_index, CAST(sum(CAST(round(net_amount * 100) AS BIGINT)) OVER (ORDER BY order_time, order_id) AS BIGINT) AS running_cents FROM t_orders""")
def _(v):
    o = v.orders().selectExpr("order_id", "datediff(order_time, date'1995-01-01') AS day", "cast(round(net_amount * 100) AS bigint) AS cents")
    return od.running_totals(o, [("day", True), ("order_id", True)], {"row_index": F.lit(1).cast("long"), "running_cents": F.col("cents")}).select("order_id", "row_index", "running_cents")


@query("running_total_by_key", "SELECT order_id, row_number() OVER (PARTITION BY customer_id ORDER BY order_time, order_id) AS purchase_number, CAST(sum(CAST(round(net_amount * 100) AS BIGINT)) OVER (PARTITION BY customer_id ORDER BY order_time, order_id) AS BIGINT) AS running_cents FROM t_orders")
def _(v):
    o = v.orders().selectExpr("order_id", "customer_id", "order_time", "cast(round(net_amount * 100) AS bigint) AS cents", "trunc(order_time, 'year') AS y")
    return od.running_totals(o, [("order_time", True), ("order_id", True)], {"purchase_number": F.lit(1).cast("long"), "running_cents": F.col("cents")}, by=["customer_id"], range_col="y").select("order_id", "purchase_number", "running_cents")


@query("lag_by_key", "SELECT order_id, lag(net_amount) OVER (PARTITION BY customer_id ORDER BY order_time, order_id) AS prev_net_amount FROM t_orders")
def _(v):
    o = v.orders().selectExpr("order_id", "customer_id", "order_time", "net_amount", "trunc(order_time, 'month') AS m")
    return od.previous_row(o, ["customer_id"], [("order_time", True), ("order_id", True)], ["net_amount"], "m").select("order_id", "prev_net_amount")


@query("min_max_normalise", "SELECT customer_id, round((clv - (SELECT min(clv) FROM t_summary)) / ((SELECT max(clv) FROM t_summary) - (SELECT min(clv) FROM t_summary)), 8) AS clv_norm, 0.0 AS constant_norm FROM t_summary")
def _(v):
    return rounded(od.min_max_scaled(v.summary().select("customer_id", "clv"), {"clv_norm": "clv", "constant_norm": "1"}).select("customer_id", "clv_norm", "constant_norm"), default=8)


@query("pivot_event_types", "SELECT customer_id, count(*) FILTER (event_type = 'visit') AS visit, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'page_view') AS page_view FROM t_events GROUP BY 1")
def _(v):
    p = v.events().groupBy("customer_id").pivot("event_type", ["visit", "purchase", "page_view"]).agg(F.count(F.lit(1)))
    return p.na.fill(0)


@query("unpivot_metrics", "SELECT customer_id, 'churn_probability' AS metric, round(churn_probability, 6) AS value FROM t_summary UNION ALL SELECT customer_id, 'coupon_affinity', round(coupon_affinity, 6) FROM t_summary")
def _(v):
    return rounded(v.summary().select("customer_id", "churn_probability", "coupon_affinity").unpivot(["customer_id"], ["churn_probability", "coupon_affinity"], "metric", "value"))


@query("sort_multi_key_head", "SELECT customer_id, frequency FROM t_summary ORDER BY frequency DESC, region, customer_id LIMIT 100 OFFSET 10")
def _(v):
    return v.summary().orderBy(F.desc("frequency"), "region", "customer_id").offset(10).limit(100).select("customer_id", "frequency")


@query("top_k_per_group", "SELECT persona, customer_id, rn FROM (SELECT persona, customer_id, row_number() OVER (PARTITION BY persona ORDER BY clv DESC, customer_id) AS rn FROM t_summary) WHERE rn <= 5")
def _(v):
    w = W.partitionBy("persona").orderBy(F.desc("clv"), "customer_id")
    return v.summary().withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("persona", "customer_id", "rn")


@query("dedupe_keep_last", "SELECT customer_id, order_id AS last_order_id FROM (SELECT customer_id, order_id, row_number() OVER (PARTITION BY customer_id ORDER BY order_time DESC, order_id DESC) AS rn FROM t_orders) WHERE rn = 1")
def _(v):
    return tb.keep_first(v.orders(), ["customer_id"], [F.desc("order_time"), F.desc("order_id")]).selectExpr("customer_id", "order_id AS last_order_id")


@query("set_operations", """WITH a AS (SELECT customer_id FROM t_orders WHERE order_time >= TIMESTAMP '2001-01-01'), b AS (SELECT customer_id FROM t_exposures)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def _(v):
    a = v.orders().where("order_time >= timestamp_ntz'2001-01-01 00:00:00'").select("customer_id")
    b = v.exposures().select("customer_id")
    n = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n(a.unionByName(b).distinct(), "union").unionByName(n(a.intersect(b), "intersect")).unionByName(n(a.subtract(b), "except"))


@query("status_islands", """WITH s AS (SELECT customer_id, snapshot_date, current_status, CASE WHEN lag(current_status) OVER w IS DISTINCT FROM current_status THEN 1 ELSE 0 END AS ch FROM t_snapshots WINDOW w AS (PARTITION BY customer_id ORDER BY snapshot_date)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY customer_id ORDER BY snapshot_date) AS island FROM s)
SELECT customer_id, CAST(island AS BIGINT) AS island, current_status, min(snapshot_date) AS island_start, max(snapshot_date) AS island_end, count(*) AS snapshots FROM g GROUP BY 1, 2, 3""")
def _(v):
    # both steps read their input twice
    s = od.cut_lineage(v.snapshots().select("customer_id", "snapshot_date", "current_status", F.trunc("snapshot_date", "year").alias("y")))
    p = od.cut_lineage(od.previous_row(s, ["customer_id"], [("snapshot_date", True)], ["current_status"], "y"))
    g = od.running_totals(p, [("snapshot_date", True)], {"island": F.expr("cast(NOT (prev_current_status <=> current_status) AS bigint)")}, by=["customer_id"], range_col="y")
    return g.groupBy("customer_id", "island", "current_status").agg(F.min("snapshot_date").alias("island_start"), F.max("snapshot_date").alias("island_end"), F.count(F.lit(1)).alias("snapshots"))


# ---- table access ------------------------------------------------------


@query("read_delimited", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def _(v):
    path = od.scratch_path(v.spark) + ".tsv"
    v.table("customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.option("header", True).option("sep", "\t").csv(path)
    return tb.read_delimited(v.spark, path, "c_custkey bigint, c_mktsegment string, c_acctbal double")


@query("load_tables", """SELECT 'orders' AS name, count(*) AS rows, count(DISTINCT customer_id) AS customers FROM t_orders UNION ALL SELECT 'customers', count(*), count(DISTINCT customer_id) FROM t_customers UNION ALL SELECT 'events', count(*), count(DISTINCT customer_id) FROM t_events
UNION ALL SELECT 'treatment_assignments', count(*), count(DISTINCT customer_id) FROM t_assign UNION ALL SELECT 'campaign_exposures', count(*), count(DISTINCT customer_id) FROM t_exposures UNION ALL SELECT 'customer_summary', count(*), count(DISTINCT customer_id) FROM t_summary UNION ALL SELECT 'state_snapshots', 0, 0""")
def _(v):
    """All core tables as they were written; the optional one that is not there is empty."""
    root = od.scratch_path(v.spark)
    there = {"orders": v.orders(), "customers": v.customers(), "events": v.events(), "treatment_assignments": v.assignments(), "campaign_exposures": v.exposures(), "customer_summary": v.summary()}
    tb.write_tables(there, root)
    tables = tb.Catalog(v.spark, {name: f"{root}/{name}" for name in there}).load()
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("customer_id").alias("customers")).select(F.lit(name).alias("name"), "rows", "customers") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("load_pruned", "SELECT o_orderkey, o_custkey FROM orders")
def _(v):
    return tb.Catalog(v.spark, {"orders": f"{v.dir}/orders.parquet"}).table("orders", ["o_orderkey", "o_custkey", "not_there"])


@query("write_and_store", "SELECT customer_id, round(clv, 3) AS clv FROM t_summary")
def _(v):
    root = od.scratch_path(v.spark)
    tb.FeatureStore(root).save(v.summary().select("customer_id", "clv"), v.spark.range(1).selectExpr("'t' AS name"))
    feats, _meta = tb.FeatureStore(root).load(v.spark)
    tb.write_tables({"copy": feats}, root, "csv")
    return rounded(tb.read_delimited(v.spark, f"{root}/copy", "customer_id bigint, clv double", "utf-8"), default=3)


@query("merge_on_customer", """WITH a AS (SELECT customer_id, clv, CASE WHEN customer_id % 2 = 0 THEN persona END AS persona FROM t_summary WHERE customer_id % 3 > 0), b AS (SELECT customer_id, persona, region FROM t_customers WHERE customer_id % 4 > 0)
SELECT customer_id, round(clv, 3) AS clv, coalesce(a.persona, b.persona) AS persona, region FROM a FULL JOIN b USING (customer_id)""")
def _(v):
    a = v.summary().where("customer_id % 3 > 0").selectExpr("cast(customer_id AS string) AS user_id", "clv", "CASE WHEN customer_id % 2 = 0 THEN persona END AS persona")
    b = v.customers().where("customer_id % 4 > 0").select("customer_id", "persona", "region")
    return rounded(tb.merge_on_customer([a.withColumnRenamed("user_id", "customer_id"), b]).select("customer_id", "clv", "persona", "region"), default=3)


@query("pick_alias", "SELECT customer_id, round(coalesce(CASE WHEN uplift_score > 0 THEN uplift_score END, coupon_affinity, 0.5), 6) AS value FROM (SELECT customer_id, uplift_score, CASE WHEN coupon_affinity > 0 THEN coupon_affinity END AS coupon_affinity FROM t_summary)")
def _(v):
    s = v.summary()
    return rounded(s.select("customer_id", first_of(s, ["missing", "uplift_score", "coupon_affinity"], 0.5, positive=True).alias("value")))
