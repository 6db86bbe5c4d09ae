"""Customer lifetime value: inclusive-window features, model, distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import add, at
from ..functions.ordered import cut_lineage, quantile_row, shared

KEY = "customer_id"
WINDOWS = (30, 90, 180)
MODEL_FEATURES = (*[f"w{w}_{x}" for w in WINDOWS for x in ("orders", "spend", "avg_order")], "tenure_days", "spend_velocity", "order_velocity")


def clv_features(customers: DataFrame, orders: DataFrame, anchor: str) -> DataFrame:
    """Orders, spend and average in day-inclusive windows [anchor - (w - 1), anchor]."""
    a = f"to_date({at(anchor)})"
    inside = lambda w: f"to_date(order_time) BETWEEN date_sub({a}, {w - 1}) AND {a}"
    g = orders.groupBy(KEY).agg(*[F.expr(x) for w in WINDOWS for x in (
        f"count_if({inside(w)}) AS w{w}_orders", f"coalesce(sum(net_amount) FILTER (WHERE {inside(w)}), 0D) AS w{w}_spend")])
    df = customers.where(f"to_date(signup_date) <= {a}").join(g, KEY, "left").na.fill(0)
    df = add(df, **{f"w{w}_avg_order": f"w{w}_spend / greatest(w{w}_orders, 1)" for w in WINDOWS}, tenure_days=f"greatest(datediff({a}, signup_date), 0)")
    return add(df, spend_velocity="w180_spend / greatest(tenure_days, 1)", order_velocity="w180_orders / greatest(tenure_days, 1)")


def future_spend(customers: DataFrame, orders: DataFrame, anchor: str, horizon: int) -> DataFrame:
    a = f"to_date({at(anchor)})"
    g = orders.where(f"to_date(order_time) > {a} AND to_date(order_time) <= date_add({a}, {horizon})").groupBy(KEY).agg(F.sum("net_amount").alias("future_spend"))
    return customers.select(KEY).join(g, KEY, "left").na.fill(0.0)


def clv_distribution(df: DataFrame, value: str = "predicted_clv_12m") -> DataFrame:
    df = shared(df)
    q = quantile_row(df, {"_v": value}, [0.5, 0.8, 0.95])
    one = df.agg(F.expr(f"min({value}) AS min_clv"), F.expr(f"avg({value}) AS mean_clv"), F.expr(f"max({value}) AS max_clv"))
    flag = df.crossJoin(F.broadcast(q)).agg(F.expr(f"count_if({value} >= _v_1) AS high_value_customers"), F.expr(f"count_if({value} >= _v_1) / count(1) AS high_value_share"))
    return one.crossJoin(q).crossJoin(flag).selectExpr("min_clv", "_v_0 AS median_clv", "mean_clv", "_v_1 AS p80_clv", "_v_2 AS p95_clv", "max_clv", "high_value_customers", "high_value_share")


def flag_high_value(df: DataFrame, value: str = "predicted_clv_12m") -> DataFrame:
    df = shared(df)
    q = quantile_row(df, {"_v": value}, [0.8])
    return df.crossJoin(F.broadcast(q)).selectExpr(*df.columns, "_v_0 AS high_value_threshold_80pct", f"{value} >= _v_0 AS is_high_value_top20pct")


def clv_model(customers: DataFrame, orders: DataFrame, current_anchor: str, train_anchor: str) -> tuple[DataFrame, DataFrame]:
    """Forest on spend in the 180 days after an earlier anchor; doubled to 12 months. Returns predictions and metrics."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import RandomForestRegressor

    from .uplift import _assembled

    past = clv_features(customers, orders, train_anchor)
    data = cut_lineage(past.join(future_spend(customers, orders, train_anchor, 180), KEY))
    hold = F.expr(f"pmod(xxhash64({KEY}), 4) = 0")
    ready = _assembled(data, MODEL_FEATURES)
    model = RandomForestRegressor(labelCol="future_spend", numTrees=20, maxDepth=5, minInstancesPerNode=5, seed=42, predictionCol="_p").fit(ready.where(~hold))
    test = model.transform(ready.where(hold))
    metrics = {m: RegressionEvaluator(labelCol="future_spend", predictionCol="_p", metricName=m).evaluate(test) for m in ("mae", "rmse", "r2")}
    now = model.transform(_assembled(clv_features(customers, orders, current_anchor), MODEL_FEATURES))
    pred = now.selectExpr(KEY, "tenure_days", "greatest(_p, 0D) AS predicted_future_spend_180d", "greatest(_p, 0D) * 2 AS predicted_clv_12m")
    return flag_high_value(cut_lineage(pred)), customers.sparkSession.createDataFrame([tuple(metrics.values())], "mae double, rmse double, r2 double")
