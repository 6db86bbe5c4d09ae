"""How strongly to act: arms by cost and exposure, effects per arm."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import add, bound
from ..functions.ordered import cut_lineage, min_max_scaled, quantile_row
from .uplift import FEATURES, _after_assignment, _assembled

KEY = "customer_id"
ARMS = ("control", "low", "mid", "high")
MIN_ARM_ROWS = 80


def dose_dataset(summary: DataFrame, assignments: DataFrame, orders: DataFrame, exposures: DataFrame, *, horizon: int = 60) -> DataFrame:
    base = summary.drop(*[x for x in ("treatment_flag", "treatment_group", "coupon_cost", "assigned_at") if x in summary.columns])
    base = base.join(assignments.select(KEY, "assigned_at", "treatment_flag", "treatment_group", "coupon_cost"), KEY, "left")
    post = _after_assignment(orders, "order_time", assignments, horizon).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("orders_post_horizon"), F.sum("net_amount").alias("revenue_post_horizon"), F.sum("discount_amount").alias("discount_post_horizon"))
    seen = _after_assignment(exposures.select(KEY, "exposure_time"), "exposure_time", assignments, min(horizon, 30)).groupBy(KEY).agg(F.count(F.lit(1)).alias("dose_exposure_count"))
    df = base.join(post, KEY, "left").join(seen, KEY, "left").na.fill(0, ["orders_post_horizon", "revenue_post_horizon", "discount_post_horizon", "dose_exposure_count", "treatment_flag", "coupon_cost"])
    recent = "coalesce(purchase_last_30, 0)" if "purchase_last_30" in summary.columns else "0"
    df = add(df, retained_horizon=f"cast(orders_post_horizon > 0 OR {recent} > 0 AS int)", tenure_days_at_assignment="greatest(coalesce(datediff(assigned_at, signup_date), 0), 0)",
             avg_order_value_hist="coalesce(monetary, 0D) / greatest(coalesce(frequency, 0), 1e-9D)")
    df = cut_lineage(df)
    treated = df.where("treatment_flag = 1").select(KEY, "coupon_cost", "dose_exposure_count")
    t = min_max_scaled(treated, {"_c": "coupon_cost", "_x": "dose_exposure_count"}).selectExpr(KEY, "0.75D * _c + 0.25D * _x AS dose_score")
    q = quantile_row(t, {"_q": "dose_score"}, [1 / 3, 2 / 3])
    arms = t.crossJoin(F.broadcast(q)).selectExpr(KEY, "dose_score", "CASE WHEN dose_score <= _q_0 THEN 'low' WHEN dose_score <= _q_1 THEN 'mid' ELSE 'high' END AS _arm")
    return df.join(arms, KEY, "left").withColumn("dose_intensity", F.expr("coalesce(_arm, 'control')")).drop("_arm")


def dose_arm_summary(df: DataFrame) -> DataFrame:
    """Per arm: size, retention, cost, exposure, revenue, effect against control, cost against mid."""
    arms = df.sparkSession.createDataFrame([(a,) for a in ARMS], "arm string")
    g = df.groupBy(F.col("dose_intensity").alias("arm")).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("retained_horizon").alias("retention_rate"), F.avg("coupon_cost").alias("avg_coupon_cost"),
        F.avg("dose_exposure_count").alias("avg_exposure_count"), F.avg("revenue_post_horizon").alias("avg_revenue_post_horizon"))
    full = F.broadcast(arms).join(g, "arm", "left").na.fill(0)
    ref = full.agg(F.expr("max(retention_rate) FILTER (WHERE arm = 'control') AS _c"), F.expr("max(avg_coupon_cost) FILTER (WHERE arm = 'mid') AS _m"))
    treated = df.agg(F.expr("avg(coupon_cost) FILTER (WHERE treatment_flag = 1) AS _t"))
    return full.crossJoin(ref).crossJoin(treated).selectExpr(
        "arm", "samples", "retention_rate", "avg_coupon_cost", "avg_exposure_count", "avg_revenue_post_horizon",
        "CASE WHEN arm <> 'control' THEN retention_rate - _c END AS effect_prior",
        "CASE WHEN arm <> 'control' THEN avg_coupon_cost / greatest(CASE WHEN _m > 0 THEN _m ELSE coalesce(_t, 1D) END, 1D) END AS cost_multiplier")


def dose_model(df: DataFrame, features=FEATURES) -> DataFrame:
    """Effect of each intensity per customer, trained on all rows.

    Arm-wise logistic models; an arm that is too small or has one class falls back
    to its rate. A ridge regression smooths the effect.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import LinearRegression

    data = cut_lineage(_assembled(df, features).select(KEY, "features", "dose_intensity", "retained_horizon"))
    n = data.count()
    stats = {r["dose_intensity"]: r for r in data.groupBy("dose_intensity").agg(F.count(F.lit(1)).alias("n"), F.avg("retained_horizon").alias("p")).collect()}
    out = data
    for arm in ARMS:
        s = stats.get(arm)
        if s is None or s["n"] < MIN_ARM_ROWS or s["p"] in (0.0, 1.0):
            out = out.withColumn(f"p_{arm}", F.lit(float(s["p"]) if s else 0.5))
            continue
        model = LogisticRegression(labelCol="retained_horizon", maxIter=50, regParam=1.0 / s["n"], probabilityCol="_q", rawPredictionCol="_r", predictionCol="_l").fit(
            data.where(F.col("dose_intensity") == arm))
        out = model.transform(out).withColumn(f"p_{arm}", vector_to_array("_q")[1]).drop("_q", "_r", "_l")
    out = out.select("*", *[F.expr(bound(f"{bound(f'p_{a}', 0.001, 0.999)} - {bound('p_control', 0.001, 0.999)}", -0.35, 0.75)).alias(f"tau_{a}") for a in ARMS[1:]])
    out = cut_lineage(out)
    for arm in ARMS[1:]:
        model = LinearRegression(labelCol=f"tau_{arm}", elasticNetParam=0.0, regParam=2.0 / max(n, 1), predictionCol=f"e_{arm}", maxIter=50).fit(out)
        out = model.transform(out)
    rows = ", ".join(f"struct('{a}' AS intervention_intensity, {bound(f'e_{a}', -0.35, 0.75)} AS incremental_effect, p_{a} AS retention_prob_treated, p_control AS retention_prob_control)" for a in ARMS[1:])
    return out.selectExpr(KEY, f"inline(array({rows}))")
