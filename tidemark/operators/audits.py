"""Balance, diagnostics and monitoring tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import pct_ranks, quantile_row, shared

KEY = "customer_id"


def standardized_differences(df: DataFrame, columns) -> DataFrame:
    """Difference of arm means over the pooled standard deviation, long form."""
    aggs = []
    for c in columns:
        for s, a in (("t", "treatment"), ("c", "control")):
            aggs += [f"avg({c}) FILTER (WHERE treatment_group = '{a}') AS m_{s}_{c}", f"var_samp({c}) FILTER (WHERE treatment_group = '{a}') AS v_{s}_{c}"]
    rows = ", ".join(f"struct('{c}' AS feature, coalesce(CASE WHEN sqrt((v_t_{c} + v_c_{c}) / 2) >= 1e-9 THEN (m_t_{c} - m_c_{c}) / sqrt((v_t_{c} + v_c_{c}) / 2) END, 0D) AS smd)" for c in columns)
    return df.agg(*[F.expr(x) for x in aggs]).selectExpr(f"inline(array({rows}))")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation: Pearson on average-tie ranks."""
    r = pct_ranks(df, KEY, {"_a": a, "_b": b})
    return r.agg(F.corr("_a", "_b").alias("spearman"))


def funnel_user_rates(customers: DataFrame, events: DataFrame, orders: DataFrame) -> DataFrame:
    total = customers.agg(F.expr("count(1) AS n"))
    flags = events.groupBy(KEY).agg(*[F.expr(x) for x in (
        "max(event_type = 'visit') AS v", "max(event_type IN ('browse', 'search')) AS b", "max(event_type = 'add_to_cart') AS c")])
    users = flags.agg(*[F.expr(f"count_if({x}) AS {x}") for x in ("v", "b", "c")])
    buyers = orders.agg(F.count_distinct(KEY).alias("p"))
    return total.crossJoin(users).crossJoin(buyers).selectExpr(
        "coalesce(try_divide(v, n), 0D) AS visit_user_rate", "coalesce(try_divide(b, n), 0D) AS browse_user_rate",
        "coalesce(try_divide(c, n), 0D) AS cart_user_rate", "coalesce(try_divide(p, n), 0D) AS purchase_user_rate", "p / greatest(c, 1) AS cart_to_purchase_user_rate")


def treatment_balance_audit(summary: DataFrame, customers: DataFrame, events: DataFrame, orders: DataFrame, *, columns=("price_sensitivity", "coupon_affinity"),
                            inactivity: str = "recency_days") -> DataFrame:
    summary = shared(summary)
    smd = standardized_differences(summary, columns).agg(F.expr("max(abs(smd)) AS max_abs_smd"))
    rho = spearman(summary, "churn_probability", inactivity)
    p90 = quantile_row(summary, {"_p90": "churn_probability"}, [0.9])
    top = summary.crossJoin(F.broadcast(p90)).agg(*[F.expr(x) for x in (
        f"avg(CASE WHEN {inactivity} >= 30 THEN 1D ELSE 0D END) AS actual_churn_overall",
        f"avg(CASE WHEN {inactivity} >= 30 THEN 1D ELSE 0D END) FILTER (WHERE churn_probability >= _p90_0) AS actual_churn_top_decile")])
    f = funnel_user_rates(customers, events, orders)
    return f.crossJoin(smd).crossJoin(rho).crossJoin(top).selectExpr(
        "*", "max_abs_smd > 0.10 AS warn_imbalance", "purchase_user_rate > visit_user_rate AS warn_funnel", "coalesce(spearman, 0D) < 0.25 AS warn_weak_alignment")


def data_diagnostics(summary: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, distinct customers and orphan customers per table, in long form."""
    ids = summary.select(KEY).distinct()
    parts = [summary.agg(F.expr("'customer_summary' AS dataset"), F.expr("count(1) AS rows"), F.count_distinct(KEY).alias("unique_customers")).withColumn("orphan_customers", F.lit(0).cast("long"))]
    for name, df in tables.items():
        per = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(per.join(ids.withColumn("_known", F.lit(1)), KEY, "left").agg(
            F.expr(f"'{name}' AS dataset"), F.expr("coalesce(sum(_n), 0) AS rows"), F.count(KEY).alias("unique_customers"), F.expr("count_if(_known IS NULL) AS orphan_customers")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def orphan_customers(df: DataFrame, summary: DataFrame) -> DataFrame:
    return df.join(summary.select(KEY), KEY, "left_anti").select(KEY).distinct()


def value_mix(df: DataFrame, columns) -> DataFrame:
    """``dimension, value, count, share`` of each column's values; rows without one count as ``unknown``."""
    pairs = ", ".join(f"struct('{c}' AS dimension, coalesce(cast({c} AS string), 'unknown') AS value)" for c in columns)
    counts = df.selectExpr(f"inline(array({pairs}))").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("count"))
    rows = df.agg(F.expr("greatest(count(1), 1) AS _t"))
    return counts.crossJoin(F.broadcast(rows)).selectExpr("dimension", "value", "count", "count / _t AS share")


def diagnostic_checks(summary: DataFrame, tables: dict[str, DataFrame], covering: dict[str, DataFrame], scores=("churn_probability", "uplift_score", "clv")) -> DataFrame:
    """``check, value, expected, ok``: repeated customers, orphans per table, coverage of the ``covering`` tables, missing scores.

    An empty covering table is not a fault.
    """
    nulls = " + ".join(f"count_if({s} IS NULL)" for s in scores)
    own = summary.agg(F.count_distinct(KEY).alias("_ids"), F.expr(f"count(1) - count(DISTINCT {KEY}) AS _again"), F.expr(f"{nulls} AS _nulls"))
    parts = [own.selectExpr("inline(array(struct('repeated_customers' AS check, _again AS value, 0L AS expected, _again = 0 AS ok), struct('missing_scores' AS check, _nulls AS value, 0L AS expected, _nulls = 0 AS ok)))")]
    for name, df in tables.items():
        parts.append(orphan_customers(df, summary).agg(F.count(F.lit(1)).alias("value")).selectExpr(f"'{name}_orphans' AS check", "value", "0L AS expected", "value = 0 AS ok"))
    for name, df in covering.items():
        seen = df.agg(F.count_distinct(KEY).alias("value"))
        parts.append(seen.crossJoin(own).selectExpr(f"'{name}_coverage' AS check", "value", "_ids AS expected", "value = 0 OR value = greatest(_ids, 1) AS ok"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def coupon_totals(summary: DataFrame, exposures: DataFrame) -> DataFrame:
    """One row: exposed customers, exposures, opens and redemptions with their rates, and what was spent."""
    s = summary.agg(*[F.expr(x) for x in (
        "count_if(coalesce(coupon_exposure_count, 0) > 0) AS exposed_customers", "count_if(coalesce(coupon_exposure_count, 0) >= 3) AS high_exposure_customers",
        "coalesce(sum(coupon_exposure_count), 0) AS total_exposures", "try_divide(coalesce(sum(coupon_opens), 0), sum(coupon_exposure_count)) AS open_rate",
        "try_divide(coalesce(sum(coupon_redeem_count), 0), sum(coupon_exposure_count)) AS redeem_rate")])
    return s.crossJoin(exposures.agg(F.expr("coalesce(sum(coupon_cost), 0D) AS coupon_spend_total")))


def coupon_risk(summary: DataFrame) -> DataFrame:
    """Exposure and redemption per persona with a total row."""
    aggs = [F.expr(x) for x in (
        "count(1) AS customers", "count_if(coalesce(coupon_exposure_count, 0) > 0) AS exposed_customers", "count_if(coalesce(coupon_exposure_count, 0) >= 3) AS high_exposure_customers",
        "coalesce(sum(coupon_exposure_count), 0) AS total_exposures", "try_divide(sum(coupon_redeem_count), sum(coupon_exposure_count)) AS redeem_rate",
        "avg(coalesce(coupon_exposure_count, 0)) AS avg_coupon_exposure", "avg(churn_probability) AS avg_churn_probability",
        "count_if(coalesce(coupon_exposure_count, 0) >= 3) / greatest(count(1), 1) >= 0.15 AS flag_high_exposure",
        "coalesce(try_divide(sum(coupon_redeem_count), sum(coupon_exposure_count)) < 0.02, false) AS flag_low_redeem")]
    total = summary.agg(*aggs).select(F.lit("ALL").alias("persona"), "*")
    return summary.groupBy("persona").agg(*aggs).unionByName(total)


def operations_overview(summary: DataFrame) -> DataFrame:
    return summary.groupBy("persona").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("churn_probability").alias("avg_churn_probability"), F.avg("uplift_score").alias("avg_uplift_score"), F.avg("clv").alias("avg_clv"))


def event_mix(events: DataFrame) -> DataFrame:
    total = events.agg(F.expr("greatest(count(1), 1) AS _t"))
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("count")).crossJoin(F.broadcast(total)).selectExpr("event_type", "count", "count / _t AS share")


def realtime_monitor(states: DataFrame, signals) -> DataFrame:
    """Mean signal values in long form."""
    one = states.agg(*[F.expr(f"coalesce(avg(coalesce({s}, 0D)), 0D) AS {s}") for s in signals])
    rows = ", ".join(f"struct('{s}' AS signal, {s} AS mean_value)" for s in signals)
    return one.selectExpr(f"inline(array({rows}))")
