"""Model data, fits and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import cut_lineage
from ..operators import churn_model as cm, clv, dose as do, features as fe, survival as sv, uplift as up
from ..sources.views import T_AS_OF
from .analysis_queries import _PCT, _UP, uplift_data
from .feature_queries import LABEL_SQL
from .registry import query, rounded

ANCHOR = "2001-02-01 00:00:00"
LM = "2001-03-01 00:00:00"

_QN = f"""{_UP}, q AS (SELECT customer_id, treatment_flag AS w, retained_60d AS y, row_number() OVER (ORDER BY uplift_score DESC, customer_id) AS k FROM up),
g AS (SELECT customer_id, k, count(*) OVER () AS n, (sum(y * w) OVER o / greatest(sum(w) OVER o, 1e-9) - sum(y * (1 - w)) OVER o / greatest(sum(1 - w) OVER o, 1e-9)) * k AS gain FROM q WINDOW o AS (ORDER BY k))"""


@query("qini_curve", f"WITH {_QN} SELECT customer_id, k, round(k / CAST(n AS DOUBLE), 8) AS fraction, round(gain, 6) AS qini_gain, round((SELECT gain FROM g WHERE k = n) * (k - 1) / (n - 1), 6) AS random_gain FROM g")
def _(v):
    return rounded(up.qini_curve(uplift_data(v)), {"fraction": 8})


@query("auuc", f"WITH {_QN} SELECT count(*) AS n, round((sum(gain) - ((SELECT gain FROM g WHERE k = 1) + (SELECT gain FROM g WHERE k = n)) / 2) / count(*), 6) AS auuc FROM g")
def _(v):
    return rounded(up.auuc(up.qini_curve(uplift_data(v))))


_PN = ("churn_probability", "coupon_affinity", "price_sensitivity", "frequency", "monetary")


@query("persuadables_profile", "SELECT f AS feature, round(avg(x) FILTER (uplift_segment = 'Persuadables'), 4) AS persuadables_mean, round(avg(x), 4) AS overall_mean, round(avg(x) FILTER (uplift_segment = 'Persuadables') - avg(x), 4) AS delta FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS f, CAST({c} AS DOUBLE) AS x, uplift_segment FROM t_summary" for c in _PN) + ") GROUP BY 1")
def _(v):
    return rounded(up.persuadables_profile(v.summary(), _PN), default=4)


@query("persuadables_categories", """SELECT dimension, value, n, n / CAST(t AS DOUBLE) AS share FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS rn, sum(n) OVER (PARTITION BY dimension) AS t FROM (
  SELECT 'persona' AS dimension, persona AS value, count(*) AS n FROM t_summary WHERE uplift_segment = 'Persuadables' GROUP BY 2 UNION ALL SELECT 'region', region, count(*) FROM t_summary WHERE uplift_segment = 'Persuadables' GROUP BY 2)) WHERE rn <= 3""")
def _(v):
    return up.category_shares(v.summary(), ["persona", "region"])


@query("uplift_scoring")
def _(v):
    return up.uplift_scoring(uplift_data(v)).select("customer_id", "predicted_uplift", "uplift_segment", "expected_incremental_profit", "expected_roi")


@query("t_learner")
def _(v):
    d = uplift_data(v)
    return up.t_learner(d, d).select("customer_id", "uplift_score_t_learner")


@query("s_learner")
def _(v):
    d = uplift_data(v)
    return up.s_learner(d, d).select("customer_id", "uplift_score_s_learner")


@query("dr_learner")
def _(v):
    d = uplift_data(v)
    return up.dr_learner(d, d).select("customer_id", "uplift_score_dr_learner")


# ---- lifetime value ----------------------------------------------------
_W = lambda w: f"CAST(order_time AS DATE) BETWEEN DATE '2001-02-01' - {w - 1} AND DATE '2001-02-01'"


@query("clv_features", f"""WITH o AS (SELECT customer_id, {', '.join(f"count(*) FILTER ({_W(w)}) AS o{w}, coalesce(sum(net_amount) FILTER ({_W(w)}), 0) AS s{w}" for w in clv.WINDOWS)} FROM t_orders GROUP BY 1),
c AS (SELECT customer_id, greatest(date_diff('day', signup_date, TIMESTAMP '2001-02-01'), 0) AS tenure FROM t_customers WHERE CAST(signup_date AS DATE) <= DATE '2001-02-01')
SELECT customer_id, {', '.join(f"coalesce(o{w}, 0) AS w{w}_orders, round(coalesce(s{w}, 0), 2) AS w{w}_spend, round(coalesce(s{w} / greatest(o{w}, 1), 0), 5) AS w{w}_avg_order" for w in clv.WINDOWS)}, tenure AS tenure_days,
  round(coalesce(s180, 0) / greatest(tenure, 1), 5) AS spend_velocity, round(coalesce(o180, 0) / CAST(greatest(tenure, 1) AS DOUBLE), 8) AS order_velocity FROM c LEFT JOIN o USING (customer_id)""")
def _(v):
    d = clv.clv_features(v.customers(), v.orders(), ANCHOR).select("customer_id", *clv.MODEL_FEATURES)
    return rounded(d, {**{f"w{w}_spend": 2 for w in clv.WINDOWS}, "order_velocity": 8}, default=5)


@query("future_spend", "SELECT c.customer_id, round(coalesce(sum(net_amount), 0), 2) AS future_spend FROM t_customers c LEFT JOIN t_orders o ON o.customer_id = c.customer_id AND CAST(order_time AS DATE) > DATE '2001-02-01' AND CAST(order_time AS DATE) <= DATE '2001-02-01' + 180 GROUP BY 1")
def _(v):
    return rounded(clv.future_spend(v.customers(), v.orders(), ANCHOR, 180), default=2)


@query("clv_distribution", """SELECT round(min(clv), 3) AS min_clv, round(quantile_cont(clv, 0.5), 3) AS median_clv, round(avg(clv), 3) AS mean_clv, round(quantile_cont(clv, 0.8), 3) AS p80_clv, round(quantile_cont(clv, 0.95), 3) AS p95_clv, round(max(clv), 3) AS max_clv,
  (SELECT count(*) FROM t_summary WHERE clv >= (SELECT quantile_cont(clv, 0.8) FROM t_summary)) AS high_value_customers, round((SELECT avg(CASE WHEN clv >= (SELECT quantile_cont(clv, 0.8) FROM t_summary) THEN 1.0 ELSE 0 END) FROM t_summary), 3) AS high_value_share FROM t_summary""")
def _(v):
    return rounded(clv.clv_distribution(v.summary(), "clv"), default=3)


@query("clv_model")
def _(v):
    return clv.clv_model(v.customers(), v.orders(), "2001-08-01 00:00:00", ANCHOR)[0]


# ---- survival ----------------------------------------------------------
_AT = "act AS (SELECT DISTINCT customer_id, t FROM t_activity)"


@query("activity_times", f"WITH {_AT} SELECT customer_id, t AS activity_time FROM act")
def _(v):
    return sv.activity_times(v.events(), v.orders())


_GAP = f"""{_AT}, la AS (SELECT customer_id, max(t) AS l FROM act WHERE t <= TIMESTAMP '{LM}' GROUP BY 1),
ba AS (SELECT c.customer_id, coalesce(l, CASE WHEN signup_date <= TIMESTAMP '{LM}' THEN signup_date END, TIMESTAMP '{LM}') AS s FROM t_customers c LEFT JOIN la USING (customer_id)),
el AS (SELECT * FROM ba WHERE s + INTERVAL 90 DAY > TIMESTAMP '{LM}'),
st AS (SELECT customer_id, s AS t FROM el UNION ALL SELECT customer_id, t FROM act SEMI JOIN el USING (customer_id) WHERE t > TIMESTAMP '{LM}' AND t <= TIMESTAMP '{LM}' + INTERVAL 120 DAY),
ld AS (SELECT *, lead(t) OVER (PARTITION BY customer_id ORDER BY t) AS nx FROM st),
ev AS (SELECT customer_id, min(t + INTERVAL 90 DAY) AS e FROM ld WHERE (nx IS NULL OR t + INTERVAL 90 DAY < nx) AND t + INTERVAL 90 DAY <= TIMESTAMP '{LM}' + INTERVAL 120 DAY GROUP BY 1),
ge AS (SELECT el.customer_id, CASE WHEN e IS NOT NULL THEN greatest(e, TIMESTAMP '{LM}' + INTERVAL 1 DAY) END AS event_date FROM el LEFT JOIN ev USING (customer_id)),
du AS (SELECT customer_id, CAST(CASE WHEN event_date IS NOT NULL THEN greatest(date_diff('day', TIMESTAMP '{LM}', event_date), 1) ELSE 120 END AS INTEGER) AS duration_days, CAST(event_date IS NOT NULL AS INTEGER) AS event_observed FROM ge)"""


def gap_events(v):
    return sv.activity_gap_events(v.customers(), sv.activity_times(v.events(), v.orders()), LM, horizon=120, threshold=90)


def frame(v):
    return sv.landmark_frame(gap_events(v), LM, horizon=120)


@query("activity_gap_events", f"WITH {_GAP} SELECT * FROM ge")
def _(v):
    return gap_events(v)


@query("landmark_survival_frame", f"WITH {_GAP} SELECT * FROM du")
def _(v):
    return frame(v)


@query("status_survival_frame", f"""WITH f AS (SELECT customer_id, min(snapshot_date) AS e FROM t_snapshots WHERE snapshot_date > TIMESTAMP '{LM}' AND snapshot_date <= TIMESTAMP '{LM}' + INTERVAL 90 DAY AND current_status = 'churn_risk' GROUP BY 1)
SELECT customer_id, CAST(CASE WHEN e IS NULL THEN 90 ELSE greatest(date_diff('day', TIMESTAMP '{LM}', e), 1) END AS INTEGER) AS duration_days, CAST(e IS NOT NULL AS INTEGER) AS event_observed FROM t_customers LEFT JOIN f USING (customer_id)""")
def _(v):
    return sv.landmark_frame(sv.status_events(v.customers(), v.snapshots(), LM), LM)


_KM = f"""{_GAP}, k AS (SELECT persona, duration_days, count(*) AS n, sum(event_observed) AS d FROM du JOIN t_customers USING (customer_id) GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY persona ORDER BY duration_days DESC) AS at_risk FROM k)"""


@query("kaplan_meier", f"""WITH {_KM} SELECT persona, duration_days, CAST(at_risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(product(1 - d / CAST(at_risk AS DOUBLE)) OVER (PARTITION BY persona ORDER BY duration_days), 6) AS survival FROM r""")
def _(v):
    return rounded(sv.kaplan_meier(frame(v).join(v.customers().select("customer_id", "persona"), "customer_id"), "persona"))


_BETAS = {"frequency": (-0.4, 10.0, 3.0), "recency_days": (0.5, 200.0, 181.7)}
_BASE = [round(0.004 * d, 6) for d in range(1, 121)]
_HZ = "hz AS (SELECT customer_id, exp(-0.4 * (frequency - 10) / 3.0 + 0.5 * (recency_days - 200) / 181.7) AS h FROM t_summary)"


@query("survival_predict", f"""WITH {_HZ}, r AS (SELECT *, {_PCT('h')} AS pc, row_number() OVER (ORDER BY h, customer_id) AS k, count(*) OVER () AS n FROM hz)
SELECT customer_id, round(h, 6) AS predicted_hazard_ratio, {', '.join(f"round(exp(-{_BASE[d - 1]} * h), 6) AS survival_prob_{d}d" for d in (1, 30, 60, 90, 120))},
  CAST(least(greatest(ceil(ln(2) / (0.004 * h) - 1e-9), 1), 120) AS DOUBLE) AS predicted_median_time_to_churn_days, round(pc, 6) AS risk_percentile,
  CASE WHEN k <= 1 + (n - 1) / 3.0 THEN 'Low risk' WHEN k <= 1 + 2 * (n - 1) / 3.0 THEN 'Mid risk' ELSE 'High risk' END AS risk_group FROM r""")
def _(v):
    return rounded(sv.survival_predict(v.summary(), _BETAS, _BASE))


@query("concordance_index", f"""WITH {_GAP}, {_HZ}, x AS (SELECT duration_days AS t, event_observed AS e, round(h, 9) AS h FROM du JOIN hz USING (customer_id))
SELECT count(*) AS comparable_pairs, round(avg(CASE WHEN a.h > b.h THEN 1.0 WHEN a.h = b.h THEN 0.5 ELSE 0 END), 6) AS concordance_index FROM x a JOIN x b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0))""")
def _(v):
    hz = v.summary().selectExpr("customer_id", "round(exp(-0.4D * (frequency - 10) / 3D + 0.5D * (recency_days - 200) / 181.7D), 9) AS predicted_hazard_ratio")
    return rounded(sv.concordance_index(frame(v).join(hz, "customer_id")))


def encoded(v):
    s = v.summary().select("customer_id", "frequency", "monetary", "price_sensitivity", "coupon_affinity", "clv", "persona", "region")
    return sv.encode_survival(frame(v).join(s, "customer_id"), numeric=["frequency", "monetary", "price_sensitivity", "coupon_affinity", "clv"], categorical=["persona", "region"])


@query("encode_survival")
def _(v):
    return encoded(v)[0]


@query("cox_fit")
def _(v):
    df, cols = encoded(v)
    fit = sv.cox_fit_with_retry(df, cols)
    return v.spark.createDataFrame([(c, b, m, s) for c, (b, m, s) in fit["betas"].items()], "feature string, coefficient double, mean double, scale double")


@query("cox_predict")
def _(v):
    df, cols = encoded(v)
    fit = sv.cox_fit_with_retry(df, cols)
    return sv.survival_predict(df.toDF(*[c.replace(" ", "_") for c in df.columns]), {c.replace(" ", "_"): b for c, b in fit["betas"].items()}, fit["baseline"])


# ---- dose response -----------------------------------------------------
_DS = """pe AS (SELECT customer_id, count(*) AS n, sum(net_amount) AS r, sum(discount_amount) AS d FROM t_orders JOIN t_assign USING (customer_id) WHERE date_diff('day', assigned_at, order_time) BETWEEN 0 AND 60 GROUP BY 1),
xe AS (SELECT x.customer_id, count(*) AS c FROM t_exposures x JOIN t_assign a USING (customer_id) WHERE date_diff('day', assigned_at, exposure_time) BETWEEN 0 AND 30 GROUP BY 1),
ds AS (SELECT s.customer_id, treatment_flag, coupon_cost, coalesce(n, 0) AS op, coalesce(r, 0) AS rp, coalesce(d, 0) AS dp, coalesce(c, 0) AS xc FROM t_summary s LEFT JOIN pe USING (customer_id) LEFT JOIN xe USING (customer_id)),
sc AS (SELECT customer_id, 0.75 * (coupon_cost - min(coupon_cost) OVER ()) / (max(coupon_cost) OVER () - min(coupon_cost) OVER ()) + 0.25 * (xc - min(xc) OVER ()) / CAST(max(xc) OVER () - min(xc) OVER () AS DOUBLE) AS s FROM ds WHERE treatment_flag = 1),
qs AS (SELECT quantile_cont(s, 1 / 3.0) AS q1, quantile_cont(s, 2 / 3.0) AS q2 FROM sc),
dd AS (SELECT ds.*, s AS dose_score, CASE WHEN s IS NULL THEN 'control' WHEN s <= q1 + 1e-12 THEN 'low' WHEN s <= q2 + 1e-12 THEN 'mid' ELSE 'high' END AS arm FROM ds LEFT JOIN sc USING (customer_id), qs)"""


def dose_data(v):
    return do.dose_dataset(v.summary(), v.assignments(), v.orders(), v.exposures())


@query("dose_dataset", f"WITH {_DS} SELECT customer_id, op AS orders_post_horizon, round(rp, 2) AS revenue_post_horizon, round(dp, 4) AS discount_post_horizon, xc AS dose_exposure_count, CASE WHEN op > 0 THEN 1 ELSE 0 END AS retained_horizon, round(dose_score, 6) AS dose_score, arm AS dose_intensity FROM dd")
def _(v):
    return rounded(dose_data(v).select("customer_id", "orders_post_horizon", "revenue_post_horizon", "discount_post_horizon", "dose_exposure_count", "retained_horizon", "dose_score", "dose_intensity"),
                   {"revenue_post_horizon": 2, "discount_post_horizon": 4})


@query("dose_arm_summary", f"""WITH {_DS}, g AS (SELECT arm, count(*) AS samples, avg(CASE WHEN op > 0 THEN 1.0 ELSE 0 END) AS rr, avg(coupon_cost) AS ac, avg(xc) AS ax, avg(rp) AS ar FROM dd GROUP BY 1)
SELECT arm, samples, round(rr, 6) AS retention_rate, round(ac, 4) AS avg_coupon_cost, round(ax, 6) AS avg_exposure_count, round(ar, 3) AS avg_revenue_post_horizon,
  CASE WHEN arm <> 'control' THEN round(rr - (SELECT rr FROM g WHERE arm = 'control'), 6) END AS effect_prior, CASE WHEN arm <> 'control' THEN round(ac / (SELECT ac FROM g WHERE arm = 'mid'), 6) END AS cost_multiplier FROM g""")
def _(v):
    return rounded(do.dose_arm_summary(dose_data(v)), {"avg_coupon_cost": 4, "avg_revenue_post_horizon": 3})


@query("dose_model")
def _(v):
    return do.dose_model(dose_data(v))


@query("action_candidates_learned")
def _(v):
    from ..operators import decisions as de

    return de.action_candidates(v.summary(), v.survival(), dose=do.dose_model(dose_data(v))).select(
        "customer_id", "intervention_intensity", "coupon_cost", "dose_response_incremental_effect", "expected_incremental_profit", "expected_roi", "priority_score")


# ---- churn model -------------------------------------------------------
def labelled(v):
    lab = fe.future_activity_label(v.customers(), v.events(), v.orders(), None, T_AS_OF, 45)
    return v.summary().join(lab, "customer_id")


_LB = f"lb AS (SELECT s.*, label FROM t_summary s JOIN ({LABEL_SQL}) USING (customer_id))"


@query("leakage_filter", "SELECT f AS feature FROM (VALUES ('persona'), ('region'), ('signup_date'), ('acquisition_month'), ('treatment_group'), ('treatment_flag'), ('price_sensitivity'), ('coupon_affinity'), ('frequency'), ('monetary'), ('recency_days'), ('clv'), ('coupon_cost'), ('discount_pressure_score'), ('brand_sensitivity')) t(f)")
def _(v):
    kept, _drop = cm.leakage_filter(labelled(v).drop("uplift_segment"))
    names = [c for c in kept.columns if c not in ("customer_id", "label")]
    return v.spark.createDataFrame([(c,) for c in names], "feature string")


_NUM = ("frequency", "monetary", "recency_days", "coupon_affinity", "treatment_flag")


@query("target_proxy_filter", f"""WITH {_LB}, l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, label FROM lb" for c in (*_NUM, 'label'))}),
r AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk FROM l),
a AS (SELECT feature, (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)) AS auc FROM r GROUP BY 1),
p AS (SELECT 'persona' AS feature, sum(greatest(m, 1 - m) * n) / sum(n) AS s FROM (SELECT persona, avg(label) AS m, count(*) AS n FROM lb GROUP BY 1))
SELECT CASE feature WHEN 'label' THEN 'copy' ELSE feature END AS feature, round(greatest(auc, 1 - auc), 6) AS strength, greatest(auc, 1 - auc) >= 0.995 AS is_proxy FROM a UNION ALL SELECT feature, round(s, 6), s >= 0.995 FROM p""")
def _(v):
    d = labelled(v).withColumn("copy", F.col("label"))
    return rounded(cm.target_proxy_filter(d, numeric=[*_NUM, "copy"], categorical=["persona"]))


@query("datetime_parts", "SELECT customer_id, year(signup_date) AS signup_date_year, month(signup_date) AS signup_date_month, isodow(signup_date) - 1 AS signup_date_dayofweek FROM t_customers")
def _(v):
    return cm.datetime_parts(v.customers().select("customer_id", "signup_date"))


@query("constant_filter", "SELECT 'persona' AS feature, false AS is_constant UNION ALL SELECT 'one', true UNION ALL SELECT 'frequency', false")
def _(v):
    return cm.constant_columns(v.summary().select("customer_id", "persona", "frequency", F.lit("x").alias("one")))


_CV = f"""{_LB}, s AS (SELECT round(1 - frequency / 40.0 + price_sensitivity * 0.1, 6) AS th, label FROM lb), g AS (SELECT th, count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM s GROUP BY 1),
c AS (SELECT th, n, p, CAST(sum(n) OVER (ORDER BY th DESC) AS BIGINT) AS cn, CAST(sum(p) OVER (ORDER BY th DESC) AS BIGINT) AS tp, CAST(sum(p) OVER () AS BIGINT) AS tpn, CAST(sum(n) OVER () AS BIGINT) AS tn FROM g)"""


def curve(v):
    d = labelled(v).selectExpr("customer_id", "round(1 - frequency / 40D + price_sensitivity * 0.1D, 6) AS score", "label")
    return cm.classification_curve(d)


@query("classification_curves", f"WITH {_CV} SELECT th AS threshold, tp, cn - tp AS fp, tpn - tp AS fn, p AS pos_here, n - p AS neg_here, tn - tpn AS negatives, tpn AS positives, round(tp / CAST(tpn AS DOUBLE), 6) AS recall, round((cn - tp) / CAST(tn - tpn AS DOUBLE), 6) AS fpr, round(tp / CAST(cn AS DOUBLE), 6) AS precision FROM c")
def _(v):
    return rounded(curve(v))


@query("curve_metrics", f"WITH {_CV} SELECT round(sum((n - p) * (tp - p / 2.0)) / (CAST(max(tpn) AS DOUBLE) * max(tn - tpn)), 6) AS auc, round(sum(p * tp / CAST(cn AS DOUBLE)) / max(tpn), 6) AS average_precision FROM c")
def _(v):
    return rounded(cm.curve_metrics(curve(v)))


@query("business_threshold", f"WITH {_CV} SELECT th AS threshold, round(tp / CAST(cn AS DOUBLE), 6) AS precision, round(tp / CAST(tpn AS DOUBLE), 6) AS recall, tp, cn - tp AS fp, tpn - tp AS fn, CAST(tp * 120000.0 - (cn - tp) * 18000.0 - (tpn - tp) * 60000.0 AS DOUBLE) AS business_value FROM c ORDER BY 7 DESC, th LIMIT 1")
def _(v):
    return rounded(cm.business_threshold(curve(v)))


@query("group_split", f"""WITH {_LB}, t AS (SELECT i, avg(label) FILTER ((customer_id * 48271 + (42 + i) * 69621) % 2147483647 % 10000 < 2000) AS r, avg(label) AS a FROM lb, (SELECT unnest(range(50)) AS i) GROUP BY 1),
b AS (SELECT i FROM t WHERE r IS NOT NULL AND r NOT IN (0.0, 1.0) ORDER BY abs(r - a), i LIMIT 1)
SELECT (customer_id * 48271 + (42 + i) * 69621) % 2147483647 % 10000 < 2000 AS is_test, count(*) AS customers, round(avg(label), 6) AS positive_rate FROM lb, b GROUP BY 1""")
def _(v):
    return rounded(cm.group_split(labelled(v)).groupBy("is_test").agg(F.count(F.lit(1)).alias("customers"), F.avg("label").alias("positive_rate")))


_TF = ("frequency", "monetary", "price_sensitivity", "coupon_affinity", "clv", "recency_days")


@query("train_churn")
def _(v):
    model, test, score = cm.train_churn(labelled(v), _TF)
    return test.select("customer_id", "label", "prediction", F.lit(score).alias("cv_auc"))


def _training_table(v):
    """The labelled summary with a column of one value, one that gives the label away, and one of identifiers."""
    cols = ("customer_id", "label", "persona", "signup_date", "frequency", "monetary", "clv", "churn_probability", "recency_days", "coupon_affinity")
    return labelled(v).selectExpr(*cols, "1 AS fixed_fee", "3D * label + 1 AS twin", "concat('k', label) AS plan_code", "concat('u', customer_id) AS free_text", "customer_id AS account_id")


@query("churn_columns", """SELECT * FROM (VALUES ('persona', 'category'), ('signup_date_year', 'numeric'), ('signup_date_month', 'numeric'), ('signup_date_dayofweek', 'numeric'), ('frequency', 'numeric'), ('monetary', 'numeric'), ('clv', 'numeric'),
('churn_probability', 'leakage'), ('recency_days', 'numeric'), ('coupon_affinity', 'numeric'), ('fixed_fee', 'constant'), ('twin', 'proxy'), ('plan_code', 'proxy'), ('free_text', 'leakage'), ('account_id', 'leakage')) t(feature, fate)""")
def _(v):
    _, fate = cm.churn_columns(_training_table(v))
    return v.spark.createDataFrame(sorted(fate.items()), "feature string, fate string")


@query("train_churn_table")
def _(v):
    model, test, score, _ = cm.train_churn_table(_training_table(v))
    return test.select("customer_id", "label", "prediction", F.lit(score).alias("cv_auc"))


@query("feature_importance")
def _(v):
    from pyspark.ml.classification import RandomForestClassifier

    data = up._assembled(labelled(v), _TF)
    model = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=20, seed=42).fit(cut_lineage(data.select("features", "label")))
    return cm.feature_importance(v.spark, model, _TF)
