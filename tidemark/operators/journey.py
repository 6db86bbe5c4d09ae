"""What customers do before they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.ordered import exact_quantiles, previous_row, shared

KEY = "customer_id"
# Event types that carry meaning, the reported types, the stage names.
MEANINGFUL = ("visit", "page_view", "search", "add_to_cart", "remove_from_cart", "purchase", "support_contact")
MAJOR_TYPES = ("remove_from_cart", "support_contact", "add_to_cart", "search", "purchase", "coupon_open", "coupon_redeem", "visit", "page_view")
STAGES = ("가입", "첫구매", "재구매", "충성", "이탈")


def final_churn_run(snapshots: DataFrame) -> DataFrame:
    """Start of the unbroken churn_risk run at the end of the history, in one pass over the snapshots."""
    person = W.partitionBy(KEY)
    ends = snapshots.where(F.col(KEY).isNotNull()).select(
        KEY, "snapshot_date", F.max("snapshot_date").over(person).alias("final_snapshot_date"),
        F.max(F.expr("CASE WHEN current_status <> 'churn_risk' THEN snapshot_date END")).over(person).alias("_other"))
    return ends.where("_other IS NULL OR _other < final_snapshot_date AND snapshot_date > _other").groupBy(KEY).agg(
        F.min("snapshot_date").alias("final_churn_start_date"), F.max("final_snapshot_date").alias("final_snapshot_date"))


def behavior_anchor(events: DataFrame, churners: DataFrame, meaningful=MEANINGFUL) -> DataFrame:
    kinds = ", ".join(f"'{x}'" for x in meaningful)
    last = events.groupBy(KEY).agg(
        F.expr(f"max(timestamp) FILTER (WHERE event_type IN ({kinds})) AS _m"), F.max("timestamp").alias("_a"))
    return churners.join(last, KEY, "left").selectExpr(
        KEY, "final_churn_start_date", "final_snapshot_date",
        "coalesce(_m, _a, final_churn_start_date) AS behavior_anchor_time",
        "CASE WHEN _m IS NOT NULL THEN 'last_meaningful_event' WHEN _a IS NOT NULL THEN 'last_any_event' ELSE 'final_churn_start_date' END AS anchor_source")


def _before_anchor(events: DataFrame, anchors: DataFrame, days: int = 30) -> DataFrame:
    return events.join(anchors.select(KEY, "behavior_anchor_time"), KEY).where(
        f"timestamp <= behavior_anchor_time AND timestamp >= behavior_anchor_time - INTERVAL '{days}' DAY")


def compressed_sequences(events: DataFrame, n: int = 5) -> DataFrame:
    """Repeats collapsed, last n types joined in time order."""
    e = events.select(KEY, "timestamp", "event_type", F.to_date("timestamp").alias("_day"))
    marked = previous_row(e, [KEY], [("timestamp", True), ("event_type", True)], ["event_type"], "_day")
    kept = marked.where("prev_event_type IS NULL OR prev_event_type <> event_type")
    w = W.partitionBy(KEY).orderBy(F.desc("timestamp"), F.desc("event_type"))
    last = kept.withColumn("_k", F.row_number().over(w)).where(f"_k <= {n}")
    return last.groupBy(KEY).agg(F.expr(
        "concat_ws(' > ', transform(array_sort(collect_list(struct(-_k AS k, event_type))), x -> x.event_type)) AS pattern"))


def pre_churn_patterns(events: DataFrame, anchors: DataFrame, top: int = 5) -> DataFrame:
    anchors = shared(anchors)
    seq = compressed_sequences(_before_anchor(events, anchors))
    per = anchors.select(KEY).join(seq, KEY, "left").selectExpr(KEY, "coalesce(pattern, 'no_history') AS pattern")
    total = anchors.agg(F.expr("greatest(count(1), 1) AS _n"))
    best = per.groupBy("pattern").agg(F.count(F.lit(1)).alias("customer_count")).orderBy(F.desc("customer_count"), "pattern").limit(top)
    # the ranking window runs over the few rows that the limit leaves
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("customer_count"), "pattern")).cast("long"))
    return ranked.crossJoin(F.broadcast(total)).selectExpr("rank", "pattern", "customer_count", "customer_count / _n AS share_of_churn_customers")


def pre_churn_event_frequency(events: DataFrame, anchors: DataFrame, types=MAJOR_TYPES) -> DataFrame:
    listed = events.sparkSession.createDataFrame([(t,) for t in types], "event_type string")
    per = _before_anchor(events, anchors).groupBy("event_type", KEY).agg(F.count(F.lit(1)).alias("_n")).groupBy("event_type").agg(
        F.sum("_n").alias("event_count"), F.count(F.lit(1)).alias("customer_count"))
    total = anchors.agg(F.expr("greatest(count(1), 1) AS _t"))
    return F.broadcast(listed).join(per, "event_type", "left").crossJoin(F.broadcast(total)).selectExpr(
        "event_type", "coalesce(event_count, 0) AS event_count", "coalesce(customer_count, 0) AS customer_count",
        "coalesce(customer_count, 0) / _t AS customer_share")


def journey_funnel(customers: DataFrame, orders: DataFrame, churners: DataFrame) -> DataFrame:
    n = orders.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    one = customers.select(KEY).join(n, KEY, "left").join(churners.select(KEY, F.lit(1).alias("_c")), KEY, "left").agg(*[F.expr(x) for x in (
        "count(1) AS n0", "count_if(_n >= 1) AS n1", "count_if(_n >= 2) AS n2", "count_if(_n >= 3) AS n3", "count(_c) AS n4")])
    rows = ", ".join(
        f"struct('{s}' AS stage, n{i} AS customer_count, {'1D' if i == 0 else f'n{i} / greatest(n0, 1)'} AS stage_rate_from_signup, "
        f"{'1D' if i == 0 else f'n{i} / greatest(n{i - 1}, 1)'} AS transition_rate_from_prev)" for i, s in enumerate(STAGES))
    return one.selectExpr(f"inline(array({rows}))")


def churn_timing_by_stage(customers: DataFrame, orders: DataFrame, churners: DataFrame) -> DataFrame:
    churners = shared(churners)
    before = orders.join(churners.select(KEY, "final_churn_start_date"), KEY).where("order_time <= final_churn_start_date").groupBy(KEY).agg(
        F.count(F.lit(1)).alias("_n"))
    t = churners.join(customers.select(KEY, "signup_date"), KEY, "left").join(before, KEY, "left").selectExpr(
        KEY, "CASE WHEN _n >= 3 THEN '충성' WHEN _n = 2 THEN '재구매' WHEN _n = 1 THEN '첫구매' ELSE '가입' END AS churn_stage",
        "greatest(floor((unix_micros(cast(final_churn_start_date AS timestamp)) - unix_micros(cast(signup_date AS timestamp))) / 86400000000), 0) AS d")
    t = shared(t)
    med = exact_quantiles(t, {"d": "d"}, [0.5], by=["churn_stage"])
    total = t.agg(F.expr("greatest(count(1), 1) AS _t"))
    g = t.groupBy("churn_stage").agg(F.count_distinct(KEY).alias("churned_customers"), F.avg("d").alias("avg_days_to_churn"))
    return g.join(med, "churn_stage", "left").crossJoin(F.broadcast(total)).selectExpr(
        "churn_stage", "churned_customers", "avg_days_to_churn", "q_0 AS median_days_to_churn", "churned_customers / _t AS share_of_churn_customers")
