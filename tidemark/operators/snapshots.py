"""Customer state on a regular date grid, rebuilt from activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.ordered import cut_lineage

KEY = "customer_id"


def activity_times(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Visits and purchases of the log plus all orders."""
    e = events.where("lower(event_type) IN ('visit', 'purchase')").selectExpr(KEY, "timestamp AS activity_time", "lower(event_type) AS kind")
    return e.unionByName(orders.selectExpr(KEY, "order_time AS activity_time", "'purchase' AS kind")).where("activity_time IS NOT NULL")


def activity_snapshots(customers: DataFrame, events: DataFrame, orders: DataFrame, *, threshold: int = 30, every: int = 7) -> DataFrame:
    """``customers``: customer_id, signup_date and, when known, frequency and monetary.

    Activity shrinks to one row per customer and calendar day before anything is
    ordered, so the window of even the busiest customer is bounded by the calendar.
    """
    act = activity_times(events, orders)
    # one row per customer, day and "exactly at midnight"; every total below comes from these
    days = cut_lineage(act.groupBy(KEY, F.expr("to_date(activity_time) AS _date"), F.expr("activity_time = date_trunc('day', cast(activity_time AS timestamp)) AS _midnight")).agg(
        F.expr("count_if(kind = 'visit') AS v"), F.expr("count_if(kind = 'purchase') AS p"), F.min("activity_time").alias("_first"), F.max("activity_time").alias("last_any"),
        F.expr("max(activity_time) FILTER (WHERE kind = 'purchase') AS last_buy")))
    # totals count the whole day; "last activity" at a midnight sees only what happened before it
    totals = days.groupBy(KEY, F.col("_date").alias("day")).agg(F.sum("v").alias("v"), F.sum("p").alias("p"))
    seen = days.groupBy(KEY, F.expr("CASE WHEN _midnight THEN _date ELSE date_add(_date, 1) END AS day")).agg(F.max("last_any").alias("last_any"), F.max("last_buy").alias("last_buy"))
    daily = totals.join(seen, [KEY, "day"], "full").withColumn("grid", F.lit(0))
    spans = days.groupBy(KEY).agg(F.min("_first").alias("_a"), F.max("last_any").alias("_b"))
    end = days.agg(F.expr("to_date(max(last_any)) AS _end"))
    # read twice: for the grid and beside its rows
    base = cut_lineage(customers.join(spans, KEY, "left").crossJoin(F.broadcast(end)).withColumn("_signup", F.expr("coalesce(signup_date, _a, _end)")))
    start, stop = "to_date(least(_signup, _a))", "greatest(to_date(_b), _end, to_date(least(_signup, _a)))"
    grid = base.selectExpr(
        KEY, f"explode(array_distinct(concat(sequence({start}, {stop}, INTERVAL {every} DAY), array({stop})))) AS day", "1 AS grid")
    w = W.partitionBy(KEY).orderBy("day", "grid").rowsBetween(W.unboundedPreceding, 0)
    rows = daily.unionByName(grid, allowMissingColumns=True).select(
        KEY, "day", "grid", F.sum("v").over(w).alias("v"), F.sum("p").over(w).alias("p"),
        F.max("last_any").over(w).alias("la"), F.max("last_buy").over(w).alias("lb")).where("grid = 1")
    per_order = ("CASE WHEN frequency > 0 THEN try_divide(monetary, frequency) ELSE 0D END"
                 if {"frequency", "monetary"} <= set(customers.columns) else "0D")
    info = base.selectExpr(KEY, "_signup", f"{per_order} AS _amount")
    dormant = max(int(round(threshold / 2)), 1)
    out = rows.join(info, KEY).selectExpr(
        KEY, "cast(day AS timestamp_ntz) AS snapshot_date", "coalesce(la, _signup) AS last_visit_date",
        "coalesce(lb, la, _signup) AS last_purchase_date", "coalesce(v, 0) AS visits_total", "coalesce(p, 0) AS purchases_total",
        "coalesce(p, 0) * coalesce(_amount, 0D) AS monetary_total",
        "greatest(floor((unix_micros(cast(cast(day AS timestamp_ntz) AS timestamp)) - unix_micros(cast(coalesce(la, _signup) AS timestamp))) / 86400000000), 0) AS inactivity_days")
    step = W.partitionBy(KEY).orderBy("snapshot_date")
    return out.select(
        "*", F.expr(f"CASE WHEN inactivity_days >= {threshold} THEN 'churn_risk' WHEN inactivity_days >= {dormant} THEN 'dormant' ELSE 'active' END AS current_status"),
        F.least(F.col("visits_total") - F.coalesce(F.lag("visits_total").over(step), F.lit(0)), F.lit(2)).cast("double").alias("recent_visit_score"),
        F.least(F.col("purchases_total") - F.coalesce(F.lag("purchases_total").over(step), F.lit(0)), F.lit(2)).cast("double").alias("recent_purchase_score"),
        F.lit(0.0).alias("recent_exposure_score"))


def monthly_snapshots(summary: DataFrame, *, threshold: int = 30, months: int = 12) -> DataFrame:
    """Twelve 30-day steps per customer when no activity history exists."""
    dormant = max(int(round(threshold / 2)), 1)
    return summary.selectExpr("*", f"explode(sequence(0, {months - 1})) AS _m").selectExpr(
        KEY, "signup_date + make_dt_interval(30 * _m) AS snapshot_date",
        "signup_date + make_dt_interval(30 * _m) - make_dt_interval(cast(greatest(inactivity_days, 0) AS int)) AS last_visit_date",
        "signup_date + make_dt_interval(30 * _m) - make_dt_interval(cast(greatest(recency_days, 0) AS int)) AS last_purchase_date",
        "cast(frequency * 3 AS bigint) AS visits_total", "cast(frequency AS bigint) AS purchases_total", "monetary AS monetary_total",
        "cast(inactivity_days AS bigint) AS inactivity_days",
        f"CASE WHEN inactivity_days >= {threshold} OR churn_probability >= 0.7 THEN 'churn_risk' "
        f"WHEN inactivity_days >= {dormant} OR churn_probability >= 0.5 THEN 'dormant' ELSE 'active' END AS current_status")
