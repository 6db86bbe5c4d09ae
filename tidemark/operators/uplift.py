"""Treatment effect: dataset, learners, Qini and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import add, bound, chain
from ..functions.ordered import cheap, cut_lineage, running_totals, shared
from .scoring import uplift_by_risk

KEY = "customer_id"
NEUTRAL_BAND = 0.02
FEATURES = ("recency_days", "frequency", "monetary", "churn_probability", "clv", "price_sensitivity", "coupon_affinity", "tenure_days_at_assignment", "avg_order_value_hist")


def _after_assignment(rows: DataFrame, time: str, base: DataFrame, days: int) -> DataFrame:
    """Rows 0..days whole days after each customer's assignment."""
    return rows.join(base.select(KEY, "assigned_at"), KEY).where(f"datediff({time}, assigned_at) BETWEEN 0 AND {days}")


def uplift_dataset(summary: DataFrame, assignments: DataFrame, orders: DataFrame, days: int = 60) -> DataFrame:
    base = summary.drop(*[x for x in ("treatment_flag", "treatment_group", "coupon_cost", "assigned_at") if x in summary.columns])
    base = base.join(assignments.select(KEY, "assigned_at", "treatment_flag", "treatment_group", "coupon_cost"), KEY, "left")
    post = _after_assignment(orders, "order_time", assignments, days).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("orders_post_60d"), F.sum("net_amount").alias("revenue_post_60d"))
    recent = "coalesce(purchase_last_30, 0)" if "purchase_last_30" in summary.columns else "0"
    return add(
        base.join(post, KEY, "left").na.fill(0, ["orders_post_60d", "revenue_post_60d"]),
        retained_60d=f"cast(orders_post_60d > 0 OR {recent} > 0 AS int)",
        retained_60d_strict="cast(orders_post_60d > 0 AS int)",
        tenure_days_at_assignment="greatest(datediff(assigned_at, signup_date), 0)",
        avg_order_value_hist="coalesce(monetary, 0D) / greatest(coalesce(frequency, 0), 1e-9D)")


def qini_curve(df: DataFrame, *, y: str = "retained_60d", w: str = "treatment_flag", score: str = "uplift_score") -> DataFrame:
    """Running treated and control response by falling score; ties by customer."""
    d = df.selectExpr(KEY, f"cast({score} AS double) AS _s", f"cast({y} AS double) AS _y", f"cast({w} AS int) AS _w")
    d = cut_lineage(d)
    n = d.agg(F.count(F.lit(1)).alias("_n"))
    r = running_totals(d, [("_s", False), (KEY, True)], {
        "k": F.lit(1).cast("long"), "_t": F.expr("cast(_w = 1 AS double)"), "_c": F.expr("cast(_w = 0 AS double)"),
        "_yt": F.expr("CASE WHEN _w = 1 THEN _y ELSE 0D END"), "_yc": F.expr("CASE WHEN _w = 0 THEN _y ELSE 0D END")})
    r = r.crossJoin(F.broadcast(n)).withColumn("qini_gain", F.expr("(_yt / greatest(_t, 1e-9D) - _yc / greatest(_c, 1e-9D)) * k"))
    last = r.where("k = _n").select(F.col("qini_gain").alias("_last"))
    return r.crossJoin(F.broadcast(last)).selectExpr(KEY, "k", "k / _n AS fraction", "qini_gain", "CASE WHEN _n > 1 THEN _last * (k - 1) / (_n - 1) ELSE _last END AS random_gain")


def auuc(curve: DataFrame) -> DataFrame:
    """Trapezoid area; equal steps make it a plain sum minus half the ends."""
    return curve.agg(F.expr("count(1) AS n"), F.expr("coalesce((sum(qini_gain) - (max_by(qini_gain, k) + min_by(qini_gain, k)) / 2) / count(1), 0D) AS auuc"))


def persuadables_profile(df: DataFrame, numeric) -> DataFrame:
    """Means of persuadable customers against all, long form."""
    hit = "FILTER (WHERE uplift_segment = 'Persuadables')"
    one = df.agg(*[F.expr(f"coalesce(avg({c}) {hit}, 0D) AS p_{c}") for c in numeric], *[F.expr(f"coalesce(avg({c}), 0D) AS a_{c}") for c in numeric])
    rows = ", ".join(f"struct('{c}' AS feature, p_{c} AS persuadables_mean, a_{c} AS overall_mean, p_{c} - a_{c} AS delta)" for c in numeric)
    return one.selectExpr(f"inline(array({rows}))")


def category_shares(df: DataFrame, columns, top: int = 3) -> DataFrame:
    from pyspark.sql import Window as W

    pairs = ", ".join(f"struct('{c}' AS dimension, cast({c} AS string) AS value)" for c in columns)
    g = df.where("uplift_segment = 'Persuadables'").selectExpr(f"inline(array({pairs}))").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("dimension")
    return g.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc("n"), "value"))).where(f"_k <= {top}").drop("_k")


# ---- learners ---------------------------------------------------------
def _assembled(df: DataFrame, features, out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    ready = df.select("*", *[F.expr(f"coalesce(cast({c} AS double), 0D) AS _f_{c}") for c in features])
    return VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol=out).transform(ready).drop(*[f"_f_{c}" for c in features])


def _forest(label: str, features: str = "features", trees: int = 20, depth: int = 5, seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(labelCol=label, featuresCol=features, numTrees=trees, maxDepth=depth, minInstancesPerNode=20, seed=seed,
                                  probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")


def _p1(model, df: DataFrame, out: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("_prob")
    return model.transform(df).withColumn(out, F.when(F.size(p) > 1, p[1]).otherwise(0.0)).drop("_prob", "_raw", "_pred")


def _read_once(train: DataFrame, apply_to: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every fit goes over its rows several times: they are written once, also if they are to be scored."""
    kept = shared(train)
    return kept, kept if apply_to is train else apply_to


def t_learner(train: DataFrame, apply_to: DataFrame, features=FEATURES, y: str = "retained_60d", w: str = "treatment_flag") -> DataFrame:
    """One outcome forest per arm."""
    train, apply_to = _read_once(train, apply_to)
    d, a = _assembled(train, features), _assembled(apply_to, features)
    m1, m0 = _forest(y).fit(d.where(f"{w} = 1")), _forest(y).fit(d.where(f"{w} = 0"))
    return _p1(m0, _p1(m1, a, "_p1"), "_p0").withColumn("uplift_score_t_learner", F.expr("_p1 - _p0")).drop("_p1", "_p0", "features")


def s_learner(train: DataFrame, apply_to: DataFrame, features=FEATURES, y: str = "retained_60d", w: str = "treatment_flag") -> DataFrame:
    """One forest with the treatment as a feature, applied with 1 and 0."""
    from pyspark.ml.feature import VectorAssembler

    train, apply_to = _read_once(train, apply_to)
    cols = [*features, "_arm"]
    model = _forest(y).fit(_assembled(train.withColumn("_arm", F.col(w)), cols))
    one = _p1(model, _assembled(apply_to.withColumn("_arm", F.lit(1)), cols), "_p1").drop("features")
    both = _p1(model, _assembled(one.withColumn("_arm", F.lit(0)), cols), "_p0")
    return both.withColumn("uplift_score_s_learner", F.expr("_p1 - _p0")).drop("_p1", "_p0", "features", "_arm")


def dr_learner(train: DataFrame, apply_to: DataFrame, features=FEATURES, y: str = "retained_60d", w: str = "treatment_flag") -> DataFrame:
    """Doubly robust pseudo-outcome, then one regression forest."""
    from pyspark.ml.regression import RandomForestRegressor

    train, apply_to = _read_once(train, apply_to)
    d = _assembled(train, features)
    m1, m0 = _forest(y).fit(d.where(f"{w} = 1")), _forest(y).fit(d.where(f"{w} = 0"))
    e = train.agg(F.expr(f"least(greatest(avg({w}), 0.05), 0.95) AS _e"))
    p = _p1(m0, _p1(m1, d, "_p1"), "_p0").crossJoin(F.broadcast(e))
    p = p.withColumn("_dr", F.expr(bound(f"_p1 - _p0 + {w} * ({y} - _p1) / _e - (1 - {w}) * ({y} - _p0) / (1 - _e)", -0.5, 0.5)))
    model = RandomForestRegressor(labelCol="_dr", numTrees=20, maxDepth=5, minInstancesPerNode=20, seed=42, predictionCol="uplift_score_dr_learner").fit(p)
    return model.transform(_assembled(apply_to, features)).drop("features")


def uplift_scoring(dataset: DataFrame, features=FEATURES) -> DataFrame:
    """Three learners, the best by area on a held-out half, guarded fallback, economics."""
    dataset = cut_lineage(dataset)
    hold = F.expr(f"pmod(xxhash64({KEY}), 4) = 0")
    train, test = cheap(dataset.where(~hold)), dataset.where(hold)
    names = {"uplift_score_t_learner": t_learner, "uplift_score_s_learner": s_learner, "uplift_score_dr_learner": dr_learner}
    area = {n: auuc(qini_curve(fit(train, test, features), score=n)).first()["auuc"] for n, fit in names.items()}
    scored = dataset
    for n, fit in names.items():
        scored = fit(dataset, scored, features)
    best = max(area, key=area.get)
    counts = scored.agg(F.expr("count(1) AS n"), *[F.expr(f"count_if({c} > {NEUTRAL_BAND}) AS {c}") for c in names]).first()
    if counts[best] < max(100, int(counts["n"] * 0.005)) and counts["uplift_score_t_learner"] > counts[best]:
        best = "uplift_score_t_learner"
    return chain(scored, predicted_uplift=bound(f"coalesce({best}, 0D)", -0.35, 0.50), uplift_segment=uplift_by_risk("predicted_uplift", "churn_probability"),
                 expected_incremental_profit="predicted_uplift * coalesce(clv, 0D)",
                 expected_roi="(expected_incremental_profit - coalesce(coupon_cost, 0D)) / greatest(coalesce(coupon_cost, 0D), 1e-9D)")
