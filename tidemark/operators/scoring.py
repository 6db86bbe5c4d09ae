"""Per-event micro features, ROI scoring and the segment rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import add, bound, chain


def micro_features(events: DataFrame, key: str = "customer_id") -> DataFrame:
    """Counts and amounts per customer with closed-form starting scores."""
    g = events.groupBy(key).agg(
        F.count(F.lit(1)).alias("event_frequency"),
        F.expr("coalesce(sum(amount), 0D) AS total_amount"),
        F.expr("coalesce(avg(coalesce(amount, 0D)), 0D) AS avg_amount"),
        F.expr("count_if(lower(event_type) = 'purchase') AS purchase_count"),
        F.expr("count_if(lower(event_type) RLIKE 'support|cancel|refund|complaint') AS support_count"),
    )
    return chain(
        g,
        churn_probability="1 / (1 + exp(-(0.55 * support_count - 0.035 * event_frequency - 0.0007 * total_amount + 0.8)))",
        uplift_score=bound("0.02 + 0.22 * churn_probability + 0.015 * log1p(event_frequency)", 0.01, 0.35),
        clv=bound("25 + 1.8 * total_amount + 8 * event_frequency", "20D"),
        coupon_cost=bound("4 + 0.015 * clv + 2 * churn_probability", 3, 75),
    )


def roi_score(df: DataFrame) -> DataFrame:
    """Expected value, contact penalty, profit and ROI of contacting each row."""
    out = add(df, expected_value="uplift_score * churn_probability * clv",
              contact_penalty="0.08 * churn_probability * coupon_cost")
    out = out.withColumn("expected_profit", F.expr("expected_value - coupon_cost - contact_penalty"))
    return out.withColumn("roi", F.expr("CASE WHEN coupon_cost > 0 THEN try_divide(expected_profit, coupon_cost) ELSE 0D END"))


def uplift_band(u: str = "uplift_score") -> str:
    """Segment by uplift alone (customer summary rule)."""
    return (f"CASE WHEN {u} >= 0.12 THEN 'Persuadables' WHEN {u} >= 0.02 THEN 'Sure Things' "
            f"WHEN {u} >= -0.03 THEN 'Lost Causes' ELSE 'Sleeping Dogs' END")


def uplift_by_risk(u: str, churn: str) -> str:
    """Segment by uplift and churn (uplift model rule)."""
    return (f"CASE WHEN {u} < 0 THEN 'Sleeping Dogs' WHEN {u} > 0.02 AND {churn} >= 0.5 THEN 'Persuadables' "
            f"WHEN abs({u}) <= 0.02 AND {churn} >= 0.5 THEN 'Lost Causes' ELSE 'Sure Things' END")


def uplift_by_median(churn: str, monetary: str, median: str) -> str:
    """Segment by churn and spend (upload rule)."""
    return (f"CASE WHEN {churn} >= 0.45 AND {monetary} > {median} THEN 'Persuadables' WHEN {monetary} > {median} THEN 'Sure Things' "
            f"WHEN {churn} >= 0.45 THEN 'Lost Causes' ELSE 'Sleeping Dogs' END")


def customer_segment(high: str, segment: str, is_new: str) -> str:
    """Value tier and uplift segment in one of seven labels; new customers come first."""
    return f"""CASE WHEN {is_new} THEN 'New Customers' ELSE concat(
        CASE WHEN {high} AND {segment} IN ('Persuadables', 'Sure Things', 'Lost Causes', 'Sleeping Dogs') THEN 'High Value-' ELSE 'Low Value-' END,
        CASE WHEN {segment} = 'Persuadables' THEN 'Persuadables' WHEN {segment} IN ('Lost Causes', 'Sleeping Dogs') THEN 'Lost Causes'
             ELSE 'Sure Things' END) END"""
