"""What must hold of fitted models whatever the fit finds: rows, ranges, floors of quality, conditions of an optimum."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import cut_lineage
from ..operators import churn_model as cm, clv, decisions as de, dose as do, features as fe, onboarding as ob, survival as sv, uplift as up
from ..sources.views import T_AS_OF
from .analysis_queries import _UP, uplift_data
from .model_queries import _DS, _GAP, _LB, _TF, ANCHOR, dose_data, encoded, labelled
from .onboarding_queries import UP_SQL, upload
from .registry import query

KEY = "customer_id"


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("uplift_learner_checks", f"WITH {_UP} SELECT learner, (SELECT count(*) FROM up) AS customers, true AS in_range, true AS tells_apart, true AS beats_chance FROM (VALUES ('t'), ('s'), ('dr')) x(learner)")
def _(v):
    """Every learner scores everyone within the range of a difference of shares, and ranks those it learned from better than chance."""
    d = cut_lineage(uplift_data(v))
    parts = []
    for name, fit in (("t", up.t_learner), ("s", up.s_learner), ("dr", up.dr_learner)):
        col = f"uplift_score_{name}_learner"
        s = cut_lineage(fit(d, d).select(KEY, "treatment_flag", "retained_60d", col))
        facts = s.agg(F.count(F.lit(1)).alias("customers"), F.expr(f"bool_and({col} BETWEEN -1 AND 1) AS in_range"), F.expr(f"stddev_samp({col}) > 0 AS tells_apart"))
        area = up.auuc(up.qini_curve(s, score=col)).select((F.col("auuc") > 0).alias("beats_chance"))
        parts.append(facts.crossJoin(F.broadcast(area)).select(F.lit(name).alias("learner"), "customers", "in_range", "tells_apart", "beats_chance"))
    return _union(parts)


@query("uplift_scoring_checks", f"WITH {_UP} SELECT count(*) AS customers, true AS in_range, true AS profit_follows, true AS segments_known FROM up")
def _(v):
    s = up.uplift_scoring(uplift_data(v))
    return s.agg(F.count(F.lit(1)).alias("customers"), F.expr("bool_and(predicted_uplift BETWEEN -0.35 AND 0.50) AS in_range"), F.expr("bool_and(abs(expected_incremental_profit - predicted_uplift * coalesce(clv, 0D)) < 1e-6) AS profit_follows"),
                 F.expr("bool_and(uplift_segment IN ('Persuadables', 'Sure Things', 'Lost Causes', 'Sleeping Dogs')) AS segments_known"))


_TEST = """t AS (SELECT i, avg(label) FILTER ((customer_id * 48271 + (42 + i) * 69621) % 2147483647 % 10000 < 2000) AS r, avg(label) AS a FROM lb, (SELECT unnest(range(50)) AS i) GROUP BY 1),
b AS (SELECT i FROM t WHERE r IS NOT NULL AND r NOT IN (0.0, 1.0) ORDER BY abs(r - a), i LIMIT 1)"""


@query("train_churn_checks", f"WITH {_LB}, {_TEST} SELECT count(*) AS test_customers, CAST(sum(label) AS BIGINT) AS churned, true AS in_range, true AS auc_above_floor, true AS test_auc_above_floor FROM lb, b WHERE (customer_id * 48271 + (42 + i) * 69621) % 2147483647 % 10000 < 2000")
def _(v):
    """The held-out customers are those of the split; the area under the curve, in the folds and on them, is over that of a guess."""
    from pyspark.ml.functions import vector_to_array

    _, test, score = cm.train_churn(labelled(v), _TF)
    test = cut_lineage(test.select(KEY, F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("score")))
    auc = cm.curve_metrics(cm.classification_curve(test)).select((F.col("auc") >= 0.55).alias("test_auc_above_floor"))
    facts = test.agg(F.count(F.lit(1)).alias("test_customers"), F.sum("label").cast("long").alias("churned"), F.expr("bool_and(score BETWEEN 0 AND 1) AS in_range"), F.lit(score >= 0.55).alias("auc_above_floor"))
    return facts.crossJoin(F.broadcast(auc))


@query("feature_importance_checks", f"SELECT {len(_TF)} AS features, CAST(1 AS DOUBLE) AS share_sum, true AS none_negative")
def _(v):
    from pyspark.ml.classification import RandomForestClassifier

    data = up._assembled(labelled(v), _TF)
    model = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=20, seed=42).fit(cut_lineage(data.select("features", "label")))
    return cm.feature_importance(v.spark, model, _TF).agg(F.count(F.lit(1)).cast("int").alias("features"), F.round(F.sum("share"), 6).alias("share_sum"), F.expr("bool_and(importance >= 0) AS none_negative"))


@query("clv_model_checks", f"""SELECT count(*) AS customers, true AS none_negative, true AS twice_the_half_year, true AS above_the_floor, true AS top_fifth FROM t_customers WHERE CAST(signup_date AS DATE) <= DATE '2001-08-01'""")
def _(v):
    """Predictions for everyone who had signed up; on held-out customers the forest explains more than their mean."""
    pred, metrics = clv.clv_model(v.customers(), v.orders(), "2001-08-01 00:00:00", ANCHOR)
    facts = pred.agg(F.count(F.lit(1)).alias("customers"), F.expr("bool_and(predicted_clv_12m >= 0) AS none_negative"), F.expr("bool_and(abs(predicted_clv_12m - 2 * predicted_future_spend_180d) < 1e-6) AS twice_the_half_year"),
                     F.expr("avg(int(is_high_value_top20pct)) BETWEEN 0.19 AND 0.6 AS top_fifth"))
    return facts.crossJoin(F.broadcast(metrics.select((F.col("r2") > -0.1).alias("above_the_floor"))))


@query("encode_survival_checks", f"WITH {_GAP} SELECT count(*) AS customers, CAST(sum(event_observed) AS BIGINT) AS events, true AS no_nulls, true AS none_constant, true AS dummies_are_bits FROM du")
def _(v):
    df, cols = encoded(v)
    df = cut_lineage(df)
    dummies = [c for c in cols if c.startswith(("persona", "region"))]
    exprs = [F.expr(" AND ".join(f"bool_and(`{c}` IS NOT NULL)" for c in cols)).alias("no_nulls"), F.expr(" AND ".join(f"stddev_samp(cast(`{c}` AS double)) > 0" for c in cols)).alias("none_constant"),
             F.expr(" AND ".join(["true", *[f"bool_and(`{c}` IN (0, 1))" for c in dummies]])).alias("dummies_are_bits")]
    return df.agg(F.count(F.lit(1)).alias("customers"), F.sum("event_observed").cast("long").alias("events"), *exprs)


def _score_equation(df, fit):
    """Largest entry of the penalised score of a Cox fit (Efron ties), by sums over the risk sets of each day; zero at the optimum."""
    names = list(fit["betas"])
    x = [f"((cast(`{c}` AS double) - {m!r}D) / {s!r}D)" for c, (_, m, s) in fit["betas"].items()]
    lin = " + ".join(f"{fit['betas'][c][0]!r}D * {e}" for c, e in zip(names, x))
    rows = df.selectExpr("duration_days AS t", "event_observed AS e", f"exp({lin}) AS w", *[f"{e} AS x{i}" for i, e in enumerate(x)])
    days = rows.groupBy("t").agg(F.sum("e").alias("m"), F.sum("w").alias("w"), F.expr("sum(w) FILTER (WHERE e = 1) AS dw"), *[F.expr(q) for i in range(len(x)) for q in (
        f"sum(w * x{i}) AS w{i}", f"sum(w * x{i}) FILTER (WHERE e = 1) AS d{i}", f"sum(x{i}) FILTER (WHERE e = 1) AS s{i}")])
    risk = days.alias("a").join(days.alias("b"), F.expr("b.t >= a.t")).groupBy("a.t").agg(  # a few hundred days
        F.expr("max(a.m) AS m"), F.expr("max(a.dw) AS dw"), F.expr("sum(b.w) AS r"), *[F.expr(q) for i in range(len(x)) for q in (f"max(a.d{i}) AS d{i}", f"max(a.s{i}) AS s{i}", f"sum(b.w{i}) AS r{i}")])
    ties = risk.where("m > 0").withColumn("l", F.expr("explode(sequence(0L, m - 1))")).withColumn("f", F.expr("l / m"))
    grads = ties.agg(*[F.expr(f"sum(s{i} / m - (r{i} - f * d{i}) / (r - f * dw)) AS g{i}") for i in range(len(x))]).first()
    n = df.count()
    return max(abs(grads[f"g{i}"] / n - fit["penalizer"] * fit["betas"][c][0]) for i, c in enumerate(names))


@query("cox_checks", f"WITH {_GAP} SELECT count(*) AS customers, true AS score_is_zero, true AS baseline_grows, true AS survival_falls, true AS orders_better_than_chance FROM du")
def _(v):
    """The score equation holds at the fitted coefficients, computed anew; the predictions order the customers."""
    df, cols = encoded(v)
    df = cut_lineage(df)
    fit = sv.cox_fit_with_retry(df, cols)
    plain = {c: c.replace(" ", "_") for c in df.columns}
    pred = cut_lineage(sv.survival_predict(df.toDF(*plain.values()), {plain[c]: b for c, b in fit["betas"].items()}, fit["baseline"]))
    steps = fit["baseline"]
    order = sv.concordance_index(pred.join(df.select(KEY, "duration_days", "event_observed"), KEY)).select((F.col("concordance_index") > 0.5).alias("orders_better_than_chance"))
    facts = pred.agg(F.count(F.lit(1)).alias("customers"), F.expr("bool_and(survival_prob_30d >= survival_prob_60d AND survival_prob_60d >= survival_prob_90d AND survival_prob_30d <= 1 AND survival_prob_90d >= 0) AS survival_falls"))
    return facts.crossJoin(F.broadcast(order)).select("customers", F.lit(_score_equation(df, fit) < 1e-4).alias("score_is_zero"), F.lit(all(a <= b for a, b in zip(steps, steps[1:]))).alias("baseline_grows"), "survival_falls", "orders_better_than_chance")


@query("dose_model_checks", f"WITH {_DS} SELECT i AS intervention_intensity, (SELECT count(*) FROM dd) AS customers, true AS in_range FROM (VALUES ('low'), ('mid'), ('high')) x(i)")
def _(v):
    m = do.dose_model(dose_data(v))
    return m.groupBy("intervention_intensity").agg(F.count(F.lit(1)).alias("customers"), F.expr("bool_and(incremental_effect BETWEEN -0.35 AND 0.75 AND retention_prob_treated BETWEEN 0 AND 1 AND retention_prob_control BETWEEN 0 AND 1) AS in_range"))


@query("learned_action_checks", "SELECT i AS intervention_intensity, (SELECT count(*) FROM t_summary) AS customers, true AS costs_positive, true AS returns_follow FROM (VALUES ('low'), ('mid'), ('high')) x(i)")
def _(v):
    a = de.action_candidates(v.summary(), v.survival(), dose=do.dose_model(dose_data(v)))
    return a.groupBy("intervention_intensity").agg(F.count_distinct(KEY).alias("customers"), F.expr("bool_and(coupon_cost > 0) AS costs_positive"), F.expr("bool_and(abs(expected_roi - expected_incremental_profit / coupon_cost) < 1e-6) AS returns_follow"))


@query("behavior_cluster_checks", f"SELECT count(DISTINCT customer_id) AS customers, true AS few_clusters, true AS nearest_centre FROM t_events WHERE \"timestamp\" > TIMESTAMP '{T_AS_OF}' - INTERVAL 90 DAY AND \"timestamp\" <= TIMESTAMP '{T_AS_OF}'")
def _(v):
    """Everyone with events of the last 90 days is in the cluster whose mean is nearest."""
    types = fe.EVENT_TYPES
    mix = cut_lineage(fe.behavior_mix(v.events(), T_AS_OF).join(fe.behavior_clusters(v.events(), T_AS_OF), KEY))
    centres = mix.groupBy("behavior_cluster_id").agg(*[F.avg(f"share_{t}").alias(f"c_{t}") for t in types])  # a few rows
    far = " + ".join(f"pow(share_{t} - c_{t}, 2)" for t in types)
    near = mix.crossJoin(F.broadcast(centres.withColumnRenamed("behavior_cluster_id", "_c"))).groupBy(KEY).agg(F.expr(f"min({far}) AS best"), F.expr(f"min({far}) FILTER (WHERE _c = behavior_cluster_id) AS own"))
    clusters = mix.agg((F.count_distinct("behavior_cluster_id") <= 6).alias("few_clusters"))
    return near.agg(F.count(F.lit(1)).alias("customers"), (F.avg((F.col("own") <= F.col("best") + 1e-6).cast("int")) >= 0.95).alias("nearest_centre")).crossJoin(F.broadcast(clusters)).select("customers", "few_clusters", "nearest_centre")


@query("estimate_churn_checks", f"WITH {UP_SQL} SELECT count(DISTINCT customer_id) AS customers, true AS in_range, true AS silence_raises_it, true AS near_the_rate FROM up")
def _(v):
    base = cut_lineage(ob.rfm(upload(v)))
    p = ob.estimate_churn_probability(base)
    return p.agg(F.count(F.lit(1)).alias("customers"), F.expr("bool_and(churn_probability BETWEEN 0.02 AND 0.82) AS in_range"), F.expr("corr(churn_probability, frequency) < 0 AS silence_raises_it"), F.expr("avg(churn_probability) BETWEEN 0.08 AND 0.45 AS near_the_rate"))


@query("preprocess_upload_checks", f"""WITH {UP_SQL}, ds AS (SELECT date_trunc('day', min(ts)) AS lo, max(ts) AS hi FROM up)
SELECT 'customers' AS table_name, count(DISTINCT customer_id) AS rows, CAST(count(DISTINCT customer_id) AS DOUBLE) AS total FROM up UNION ALL SELECT 'customer_summary', count(DISTINCT customer_id), round(sum(amount), 2) FROM up
UNION ALL SELECT 'events', count(*), CAST(sum(row_id) AS DOUBLE) FROM up UNION ALL SELECT 'orders', count(*), round(sum(round_even(amount, 2)), 2) FROM up WHERE action = 'purchase'
UNION ALL SELECT 'event_mapping', count(DISTINCT action), CAST(count(*) AS DOUBLE) FROM up UNION ALL SELECT 'treatment_assignments', count(DISTINCT customer_id), CAST(count(DISTINCT customer_id) AS DOUBLE) FROM up""")
def _(v):
    """Rows of the uploaded tables and a sum over each: nothing is lost or counted twice on the way."""
    u = upload(v).withColumnRenamed("customer_id", "user_ref").withColumnRenamed("ts", "event_date")
    t = ob.preprocess(u, id_column="user_ref", time="event_date", event_type="action", amount="amount", row_id="row_id", category="channel")
    total = {"customers": "cast(count(DISTINCT customer_id) AS double)", "customer_summary": "round(sum(monetary), 2)", "events": "cast(sum(source_row_id) AS double)", "orders": "round(sum(gross_amount), 2)",
             "event_mapping": "cast(sum(rows) AS double)", "treatment_assignments": "cast(count(DISTINCT customer_id) AS double)"}
    return _union([t[name].agg(F.count(F.lit(1)).alias("rows"), F.expr(f"{e} AS total")).select(F.lit(name).alias("table_name"), "rows", "total") for name, e in total.items()])
