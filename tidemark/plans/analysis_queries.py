"""Experiments, counterfactuals, recommendations, reasons and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as au, counterfactual as cf, decisions as de, experiments as ex, explain as xp, recommend as rc, uplift as up
from .decision_sql import cl, norm, timing_sql
from .registry import query, rounded

_UP = """up AS (SELECT s.*, assigned_at, coalesce(n, 0) AS orders_post_60d, coalesce(r, 0.0) AS revenue_post_60d, CASE WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END AS retained_60d,
   greatest(date_diff('day', signup_date, assigned_at), 0) AS tenure_days_at_assignment, monetary / greatest(frequency, 1e-9) AS avg_order_value_hist
   FROM t_summary s LEFT JOIN (SELECT customer_id, assigned_at FROM t_assign) USING (customer_id)
   LEFT JOIN (SELECT customer_id, count(*) AS n, sum(net_amount) AS r FROM t_orders JOIN t_assign USING (customer_id) WHERE date_diff('day', assigned_at, order_time) BETWEEN 0 AND 60 GROUP BY 1) USING (customer_id))"""


def uplift_data(v):
    return up.uplift_dataset(v.summary(), v.assignments(), v.orders())


@query("uplift_dataset", f"WITH {_UP} SELECT customer_id, orders_post_60d, round(revenue_post_60d, 2) AS revenue_post_60d, retained_60d, retained_60d AS retained_60d_strict, tenure_days_at_assignment, round(avg_order_value_hist, 5) AS avg_order_value_hist FROM up")
def _(v):
    return rounded(uplift_data(v).select("customer_id", "orders_post_60d", "revenue_post_60d", "retained_60d", "retained_60d_strict", "tenure_days_at_assignment", "avg_order_value_hist"), {"avg_order_value_hist": 5}, default=2)


_AB = f"""WITH {_UP},
a AS (SELECT count(*) FILTER (treatment_flag = 1) AS n_t, CAST(sum(1 - retained_60d) FILTER (treatment_flag = 1) AS BIGINT) AS churn_t, sum(coupon_cost) FILTER (treatment_flag = 1) AS cost_t, avg(revenue_post_60d) FILTER (treatment_flag = 1) AS rev_t,
   count(*) FILTER (treatment_flag = 0) AS n_c, CAST(sum(1 - retained_60d) FILTER (treatment_flag = 0) AS BIGINT) AS churn_c, sum(coupon_cost) FILTER (treatment_flag = 0) AS cost_c, avg(revenue_post_60d) FILTER (treatment_flag = 0) AS rev_c FROM up),
b AS (SELECT *, churn_t / CAST(n_t AS DOUBLE) AS p_t, churn_c / CAST(n_c AS DOUBLE) AS p_c, (churn_t + churn_c) / CAST(n_t + n_c AS DOUBLE) AS pp FROM a)"""


@query("ab_test", _AB + """
SELECT n_t, churn_t, round(cost_t, 2) AS cost_t, round(rev_t, 4) AS rev_t, n_c, churn_c, round(cost_c, 2) AS cost_c, round(rev_c, 4) AS rev_c, round(p_t, 6) AS p_t, round(p_c, 6) AS p_c, round(p_t - p_c, 6) AS difference,
  round((p_t - p_c) / sqrt(pp * (1 - pp) * (1.0 / n_t + 1.0 / n_c)), 5) AS z_stat,
  round(p_t - p_c - 1.96 * sqrt(p_t * (1 - p_t) / n_t + p_c * (1 - p_c) / n_c), 6) AS ci_low, round(p_t - p_c + 1.96 * sqrt(p_t * (1 - p_t) / n_t + p_c * (1 - p_c) / n_c), 6) AS ci_high,
  round((n_t + n_c) * pow(greatest(abs(CAST(churn_t AS DOUBLE) * (n_c - churn_c) - CAST(churn_c AS DOUBLE) * (n_t - churn_t)) - (n_t + n_c) / 2.0, 0), 2) / (CAST(n_t AS DOUBLE) * n_c * (churn_t + churn_c) * (n_t + n_c - churn_t - churn_c)), 5) AS chi_square,
  CAST(ceil(pow(1.959963984540054 * sqrt((p_t + p_c) * (1 - (p_t + p_c) / 2)) + 0.8416212335729143 * sqrt(p_c * (1 - p_c) + p_t * (1 - p_t)), 2) / greatest(pow(p_t - p_c, 2), 1e-9)) AS BIGINT) AS required_sample_size_per_group,
  round((1.959963984540054 + 0.8416212335729143) * sqrt(2 * p_c * (1 - p_c) / least(n_t, n_c)), 6) AS minimum_detectable_effect, round((p_t - p_c) / p_c, 6) AS relative_change, round(p_c - p_t, 6) AS incremental_retention_lift,
  round((p_c - p_t) * n_t, 4) AS incremental_retained_customers, round(rev_t - rev_c, 4) AS revenue_per_customer, round((rev_t - rev_c) * n_t, 1) AS incremental_revenue, round((rev_t - rev_c) * n_t - cost_t, 1) AS incremental_profit,
  CASE WHEN p_c > p_t THEN round(cost_t / ((p_c - p_t) * n_t), 3) END AS cost_per_retained, round(((rev_t - rev_c) * n_t - cost_t) / cost_t, 5) AS incremental_roi,
  least(n_t, n_c) >= pow(1.959963984540054 * sqrt((p_t + p_c) * (1 - (p_t + p_c) / 2)) + 0.8416212335729143 * sqrt(p_c * (1 - p_c) + p_t * (1 - p_t)), 2) / greatest(pow(p_t - p_c, 2), 1e-9) AS meets_required_sample_size,
  abs(p_t - p_c) < (1.959963984540054 + 0.8416212335729143) * sqrt(2 * p_c * (1 - p_c) / least(n_t, n_c)) AS smaller_than_mde FROM b""")
def _(v):
    return rounded(ex.ab_statistics(uplift_data(v)), {"cost_t": 2, "cost_c": 2, "rev_t": 4, "rev_c": 4, "z_stat": 5, "chi_square": 5, "incremental_retained_customers": 4, "revenue_per_customer": 4,
                                                      "incremental_revenue": 1, "incremental_profit": 1, "cost_per_retained": 3, "incremental_roi": 5})


@query("ab_test_full")
def _(v):
    return ex.ab_test(uplift_data(v))


# ---- counterfactual ----------------------------------------------------
_CFP = f"""cp AS (SELECT *, 0.34 * churn_probability + 0.26 * greatest(u, 0) + 0.20 * {norm('clv')} + 0.20 * timing_urgency_score AS rk FROM ({timing_sql("(SELECT *, least(greatest(uplift_score, -0.30), 0.60) AS u FROM t_summary WHERE churn_probability >= 0.2)")})
   ORDER BY rk DESC, churn_probability DESC, clv DESC, customer_id)"""
# urgency and window of the pool use the pool's own hazard range
_A = f"""s1 AS (SELECT *, {norm('clv')} AS vv, {norm('coupon_affinity')} AS ca, {norm('price_sensitivity')} AS ps, {norm('discount_pressure_score')} AS fa, {norm('brand_sensitivity')} AS br, greatest(CAST(intervention_window_days AS DOUBLE), 1) AS dd FROM cp),
s2 AS (SELECT * FROM s1, (VALUES (0, 'no_action', 0.0, 0.0), (1, 'coupon_5000', 5000.0, 1.0), (2, 'consult_call', 12000.0, 1.18), (3, 'push_email', 800.0, 0.42), (4, 'wait_7d', 0.0, 0.0)) a(ao, action_id, action_cost, mul)),
s3 AS (SELECT *, least(least(greatest(u * mul * least(greatest(churn_timing_weight, 0.6), 1.6) * {cl("CASE action_id WHEN 'coupon_5000' THEN 0.82 + 0.22 * ca + 0.22 * ps + 0.12 * timing_urgency_score - 0.18 * fa WHEN 'consult_call' THEN 0.78 + 0.25 * vv + 0.18 * churn_probability + 0.14 * timing_urgency_score + 0.08 * br - 0.08 * ca WHEN 'push_email' THEN 0.68 + 0.18 * greatest(u, 0) + 0.12 * (1 - fa) + 0.10 * (1 - timing_urgency_score) ELSE 1.0 END", 0.25, 1.35)}, -0.25), 0.45), churn_probability) AS eff FROM s2),
s4 AS (SELECT *, CASE action_id WHEN 'no_action' THEN churn_probability WHEN 'wait_7d' THEN {cl('churn_probability + least(7 / dd, 1) * (0.05 + 0.22 * timing_urgency_score + 0.20 * churn_probability)')} ELSE {cl('churn_probability - eff')} END AS tc,
   CASE WHEN action_id = 'wait_7d' THEN 0.018 * clv * (1 - timing_urgency_score) * greatest(u, 0) ELSE 0 END AS ov FROM s3),
sc AS (SELECT *, clv * (1 - tc) + ov - action_cost AS net FROM s4)"""


def cf_pool(v):
    return cf.counterfactual_pool(v.summary(), None, v.survival(), threshold=0.2)


@query("counterfactual_pool", f"WITH {_CFP} SELECT customer_id, round(churn_probability, 6) AS churn_probability, round(u, 6) AS uplift_score, round(timing_urgency_score, 6) AS timing_urgency_score FROM cp")
def _(v):
    return rounded(cf_pool(v).select("customer_id", "churn_probability", "uplift_score", "timing_urgency_score"))


@query("counterfactual_scenarios", f"WITH {_CFP}, {_A} SELECT customer_id, action_id, CAST(action_cost AS DOUBLE) AS action_cost, round(tc, 6) AS treated_churn_probability, round(net, 2) AS expected_net_profit, round(net - clv * (1 - churn_probability), 2) AS incremental_vs_no_action, round(CASE WHEN action_cost > 0 THEN (net - clv * (1 - churn_probability)) / action_cost END, 5) AS scenario_roi, round(tc - churn_probability, 6) AS estimated_churn_delta FROM sc")
def _(v):
    s = cf.counterfactual_scenarios(cf_pool(v)).select("customer_id", "action_id", "action_cost", "treated_churn_probability", "expected_net_profit", "incremental_vs_no_action", "scenario_roi", "estimated_churn_delta")
    return rounded(s, {"expected_net_profit": 2, "incremental_vs_no_action": 2, "scenario_roi": 5})


_BEST = f"""{_CFP}, {_A}, r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY net DESC, ao) AS rn FROM sc),
b AS (SELECT r.*, greatest(net - (SELECT q.net FROM r q WHERE q.customer_id = r.customer_id AND q.rn = 2), 0) AS mg FROM r WHERE rn = 1),
f AS (SELECT *, net - clv * (1 - churn_probability) AS inc, {cl('0.55 + 0.25 * least(mg / CASE WHEN clv > 0 THEN clv ELSE 1 END, 0.35) / 0.35 + 0.20 * least(abs(u), 0.20) / 0.20')} AS cs FROM b),
g AS (SELECT *, cs < 0.74 OR abs(inc) < CASE WHEN clv > 0 THEN clv ELSE 1 END * 0.02 AS ab FROM f)"""


@query("counterfactual_best_action", f"WITH {_BEST} SELECT customer_id, action_id AS best_action_id, round(net, 2) AS best_expected_net_profit, round(inc, 2) AS incremental_vs_no_action, round(mg, 2) AS decision_margin, round(cs, 6) AS confidence_score, CASE WHEN cs >= 0.74 THEN '높음' WHEN cs >= 0.5 THEN '중간' ELSE '낮음' END AS confidence, ab AS ab_test_recommended FROM g")
def _(v):
    b = cf.best_action(cf.counterfactual_scenarios(cf_pool(v)))
    return rounded(b.select("customer_id", "best_action_id", "best_expected_net_profit", "incremental_vs_no_action", "decision_margin", "confidence_score", "confidence", "ab_test_recommended"), {"confidence_score": 6}, default=2)


@query("counterfactual_summary", f"WITH {_BEST} SELECT count(*) AS customer_count, count(*) * 5 AS scenario_count, round(avg(inc), 3) AS avg_incremental, count(*) FILTER (inc > 0) AS positive_recommendations, count(*) FILTER (ab) AS ab_test_recommended_count, round(avg(cs), 5) AS avg_confidence_score, "
       + ", ".join(f"count(*) FILTER (action_id = '{a[0]}') AS n_{a[0]}" for a in cf.ACTIONS) + " FROM g")
def _(v):
    return rounded(cf.counterfactual_summary(cf.best_action(cf.counterfactual_scenarios(cf_pool(v)))), {"avg_incremental": 3, "avg_confidence_score": 5})


# ---- recommendations ---------------------------------------------------
_PREF = "pr AS (SELECT customer_id, item_category, sum(net_amount * exp(-date_diff('day', order_time, (SELECT max(order_time) FROM t_orders)) / 90.0) + quantity * 5000) AS sc FROM t_orders GROUP BY 1, 2)"
_VIEW = "vw AS (SELECT customer_id, item_category, sum(exp(-date_diff('day', \"timestamp\", (SELECT max(\"timestamp\") FROM t_events WHERE event_type = 'page_view')) / 60.0)) AS vs FROM t_events WHERE event_type = 'page_view' GROUP BY 1, 2)"
_SEG = "sg AS (SELECT persona, uplift_segment, item_category, sum(net_amount) + count(*) * 3000 AS sp FROM t_orders JOIN t_summary USING (customer_id) GROUP BY 1, 2, 3)"
_GLOB = "gl AS (SELECT item_category, sum(net_amount) + count(*) * 2000 AS gp FROM t_orders GROUP BY 1)"


@query("category_preferences", f"WITH {_PREF} SELECT customer_id, item_category, round(sc, 3) AS customer_pref_score FROM pr")
def _(v):
    return rounded(rc.category_preferences(v.orders(quantity=True)), default=3)


@query("interest_scores", f"WITH {_VIEW} SELECT customer_id, item_category, round(vs, 8) AS view_score FROM vw")
def _(v):
    return rounded(rc.interest_scores(v.events()), default=8)


@query("segment_popularity", f"WITH {_SEG} SELECT persona, uplift_segment, item_category, round(sp, 2) AS segment_popularity FROM sg")
def _(v):
    return rounded(rc.segment_popularity(v.summary(), v.orders()), default=2)


@query("global_popularity", f"WITH {_GLOB} SELECT item_category, round(gp, 2) AS global_popularity FROM gl")
def _(v):
    return rounded(rc.global_popularity(v.orders()), default=2)


_PCT = lambda x: f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count(*) OVER ()"
_TG = f"""tg AS (SELECT *, 0.45 * churn_probability + 0.25 * ({_PCT('uplift_score')}) + 0.30 * ({_PCT('clv')}) AS pri FROM t_summary),
tt AS (SELECT * FROM tg WHERE churn_probability >= 0.3 ORDER BY pri DESC, clv DESC, customer_id)"""


def rec_targets(v):
    return rc.risk_targets(v.summary(), min_churn=0.3)


@query("recommendation_targets", f"WITH {_TG} SELECT customer_id, round(pri, 6) AS recommendation_priority FROM tt")
def _(v):
    return rounded(rec_targets(v).select("customer_id", "recommendation_priority"))


@query("recommendation_given_targets", f"""WITH tg AS (SELECT customer_id, churn_probability * 0.9 AS churn_score, 1 - churn_probability AS priority_score, uplift_score, clv, greatest(expected_roi, 0) AS roi FROM t_summary WHERE customer_id % 3 = 0),
j AS (SELECT *, least(greatest(0.30 * ({_PCT('priority_score')}) + 0.22 * churn_score + 0.14 * ({_PCT('uplift_score')}) + 0.14 * ({_PCT('clv')}) + 0.10 * ({_PCT('roi')}), 0), 1) AS pri FROM tg)
SELECT customer_id, round(churn_score, 6) AS churn_probability, round(pri, 6) AS recommendation_priority FROM j""")
def _(v):
    s = v.summary()
    t = s.where("customer_id % 3 = 0").selectExpr("customer_id", "churn_probability * 0.9 AS churn_score", "1 - churn_probability AS priority_score")
    return rounded(rc.given_targets(s, t, None).select("customer_id", "churn_probability", "recommendation_priority"))


_n = lambda x: f"CASE WHEN max({x}) OVER w - min({x}) OVER w < 1e-9 THEN 0 ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END"
_TOP = f"""WITH {_PREF}, {_VIEW}, {_SEG}, {_GLOB}, {_TG},
m AS (SELECT tt.customer_id, tt.persona, tt.uplift_segment, coupon_affinity, gl.item_category, coalesce(sc, 0) AS sc, coalesce(vs, 0) AS vs, coalesce(sp, 0) AS sp, gp FROM tt CROSS JOIN gl
  LEFT JOIN pr ON pr.customer_id = tt.customer_id AND pr.item_category = gl.item_category LEFT JOIN vw ON vw.customer_id = tt.customer_id AND vw.item_category = gl.item_category
  LEFT JOIN sg ON sg.persona = tt.persona AND sg.uplift_segment = tt.uplift_segment AND sg.item_category = gl.item_category),
k AS (SELECT *, 0.50 * ({_n('sc')}) + 0.15 * ({_n('vs')}) + 0.20 * ({_n('sp')}) + 0.15 * ({_n('gp')}) + 0.05 * coupon_affinity AS score FROM m WINDOW w AS (PARTITION BY customer_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, item_category) AS rn FROM k)"""


def recs(v):
    return rc.recommend_topk(rec_targets(v), v.orders(quantity=True), v.events(), v.summary())


@query("recommend_topk", _TOP + """ SELECT customer_id, persona, uplift_segment, CAST(rn AS INTEGER) AS recommendation_rank, item_category AS recommended_category, round(score, 6) AS recommendation_score,
  CASE WHEN sc > 0 OR vs > 0 OR sp > 0 THEN concat_ws(', ', CASE WHEN sc > 0 THEN 'own_purchase_history' END, CASE WHEN vs > 0 THEN 'recent_browse_signal' END, CASE WHEN sp > 0 THEN 'segment_popularity' END) ELSE 'global_popularity' END AS reason_tags FROM r WHERE rn <= 3""")
def _(v):
    return rounded(recs(v))


@query("recommendation_summary", _TOP + " SELECT item_category AS recommended_category, count(*) AS rows, count(DISTINCT customer_id) AS customers FROM r WHERE rn <= 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(v):
    return rc.recommendation_summary(recs(v), 10)


@query("localize_categories", f"""WITH m(k, l) AS (VALUES {', '.join(f"('{k}', '{x}')" for k, x in rc.FINANCE_CATEGORIES.items())}),
b AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Credit Card' WHEN 1 THEN 'loans' WHEN 2 THEN ' Wealth-Management ' ELSE p_brand END AS recommended_category FROM part)
SELECT p_partkey, coalesce(l, trim(recommended_category)) AS recommended_category, '고객 본인의 과거 금융거래 이력, other_tag' AS reason_tags FROM b LEFT JOIN m ON k = replace(replace(lower(trim(recommended_category)), ' ', '_'), '-', '_')""")
def _(v):
    b = v.table("part").selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN 'Credit Card' WHEN 1 THEN 'loans' WHEN 2 THEN ' Wealth-Management ' ELSE p_brand END AS recommended_category",
                                   "'own_purchase_history,other_tag' AS reason_tags")
    return rc.localize_categories(b)


# ---- explanations ------------------------------------------------------
_XP = f"""p AS (SELECT *, {_PCT('recency_days')} AS p1, {_PCT('uplift_score')} AS p2, {_PCT('coupon_affinity')} AS p3, {_PCT('clv')} AS p4, {_PCT('discount_pressure_score')} AS p5, {_PCT('brand_sensitivity')} AS p6 FROM t_summary),
q AS (SELECT *, list_filter([CASE WHEN p1 >= 0.80 THEN 'purchase_recency_drop' END], lambda x: x IS NOT NULL) AS r0, list_filter([CASE WHEN p2 >= 0.70 THEN 'high_uplift' END, CASE WHEN p3 >= 0.70 THEN 'coupon_affinity' END, CASE WHEN p4 >= 0.75 THEN 'high_clv' END], lambda x: x IS NOT NULL) AS l0,
   list_filter([CASE WHEN p5 >= 0.75 THEN 'discount_pressure' END, CASE WHEN p6 >= 0.70 THEN 'brand_sensitivity' END], lambda x: x IS NOT NULL) AS g0 FROM p),
e AS (SELECT *, array_to_string(CASE WHEN len(r0) = 0 AND churn_probability >= 0.5 THEN ['high_churn_score'] ELSE r0 END, ', ') AS risk_reason_codes,
   array_to_string(CASE WHEN len(l0) = 0 AND expected_roi > 0 THEN ['positive_expected_roi'] ELSE l0[1:2] END, ', ') AS action_reason_codes, array_to_string(g0[1:2], ', ') AS guardrail_codes FROM q)"""


@query("operational_reasons", f"WITH {_XP} SELECT customer_id, coalesce(risk_reason_codes, '') AS risk_reason_codes, coalesce(action_reason_codes, '') AS action_reason_codes, coalesce(guardrail_codes, '') AS guardrail_codes, round(expected_roi, 5) AS expected_roi FROM e")
def _(v):
    return rounded(xp.operational_reasons(v.summary()).select("customer_id", "risk_reason_codes", "action_reason_codes", "guardrail_codes", "expected_roi"), default=5)


@query("reason_frequency", f"WITH {_XP} SELECT code, count(*) AS count FROM (SELECT unnest(l0[1:2]) AS code FROM e UNION ALL SELECT 'positive_expected_roi' FROM e WHERE len(l0) = 0 AND expected_roi > 0) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(v):
    return xp.reason_frequency(xp.operational_reasons(v.summary()), "action_reason_codes")


_RS = """list_filter([CASE WHEN churn_probability >= 0.6 THEN '이탈 위험이 높음' END, CASE WHEN uplift_score >= 0.02 THEN '개입 반응 가능성이 큼' END, CASE WHEN clv >= 1000000 THEN '고객 가치가 높음' END, CASE WHEN intervention_window_days <= 7 THEN '개입 시한이 촉박함' END,
  CASE WHEN expected_roi >= 0.3 THEN '예상 ROI가 양호함' END, CASE WHEN coupon_affinity >= 0.7 AND price_sensitivity >= 0.7 THEN '할인 반응성이 높은 편' END, CASE WHEN xc >= 3 THEN '최근 쿠폰 노출이 누적됨' END], lambda x: x IS NOT NULL)[1:4]"""


@query("customer_explanations", f"""WITH b AS (SELECT t.*, coalesce(x.n, 0) AS xc FROM ({timing_sql('t_summary')}) t LEFT JOIN (SELECT customer_id, count(*) AS n FROM t_exposures GROUP BY 1) x USING (customer_id)),
r AS (SELECT *, {_RS} AS rr, list_filter([CASE WHEN xc >= 3 THEN '과도한 쿠폰 학습 가능성' END, CASE WHEN price_sensitivity >= 0.8 THEN '할인 없이는 반응 저하 가능' END], lambda x: x IS NOT NULL) AS ww FROM b ORDER BY churn_probability DESC, uplift_score DESC, clv DESC, customer_id)
SELECT customer_id, CASE WHEN len(rr) > 0 THEN array_to_string(rr, ', ') ELSE '핵심 신호를 종합해 관찰 대상에 포함' END AS selection_reason, CASE WHEN len(ww) > 0 THEN array_to_string(ww, ', ') ELSE '가격·서비스·타이밍 리스크를 함께 점검' END AS watchout FROM r""")
def _(v):
    x = v.exposures().groupBy("customer_id").agg(F.count(F.lit(1)).alias("coupon_exposure_count"))
    t = de.survival_timing(v.summary(), v.survival()).select("customer_id", "intervention_window_days")
    return xp.customer_explanations(v.summary(), [t, x]).select("customer_id", "selection_reason", "watchout")


@query("restore_dimensions", """WITH b AS (SELECT customer_id, CASE customer_id % 4 WHEN 0 THEN persona WHEN 1 THEN 'live' END AS persona, CASE WHEN customer_id % 3 = 0 THEN 'gold' END AS tier, CASE WHEN customer_id % 5 > 0 THEN region END AS region,
   CASE WHEN customer_id % 6 = 0 THEN uplift_segment END AS us, CASE WHEN customer_id % 7 > 0 THEN uplift_score END AS uplift_score FROM t_summary),
p AS (SELECT *, coalesce(persona, tier) AS pa FROM b)
SELECT customer_id, CASE WHEN pa IS NOT NULL AND pa <> 'live' THEN pa WHEN tier IS NOT NULL OR region IS NOT NULL THEN concat_ws(' / ', tier, region) ELSE 'unknown_persona' END AS persona,
  CASE WHEN pa IS NOT NULL AND pa <> 'live' THEN 'payload' WHEN tier IS NOT NULL OR region IS NOT NULL THEN 'derived' ELSE 'fallback' END AS persona_source,
  coalesce(us, CASE WHEN uplift_score IS NULL THEN 'unknown_segment' WHEN uplift_score >= 0.08 THEN 'very_high_uplift' WHEN uplift_score >= 0.05 THEN 'high_uplift' WHEN uplift_score >= 0.02 THEN 'medium_uplift' WHEN uplift_score >= 0 THEN 'low_uplift' ELSE 'negative_uplift' END) AS uplift_segment,
  CASE WHEN us IS NOT NULL THEN 'payload' WHEN uplift_score IS NULL THEN 'fallback' ELSE 'derived_from_uplift_score' END AS uplift_segment_source FROM p""")
def _(v):
    b = v.summary().selectExpr("customer_id", "CASE customer_id % 4 WHEN 0 THEN persona WHEN 1 THEN 'live' END AS persona", "CASE WHEN customer_id % 7 > 0 THEN uplift_score END AS uplift_score",
                               "to_json(struct(CASE WHEN customer_id % 3 = 0 THEN 'gold' END AS tier, CASE WHEN customer_id % 5 > 0 THEN region END AS region, CASE WHEN customer_id % 6 = 0 THEN uplift_segment END AS uplift_segment)) AS payload")
    return xp.restore_dimensions(b).select("customer_id", "persona", "persona_source", "uplift_segment", "uplift_segment_source")


# ---- audits ------------------------------------------------------------
@query("standardized_differences", """SELECT f AS feature, round((avg(x) FILTER (treatment_flag = 1) - avg(x) FILTER (treatment_flag = 0)) / sqrt((var_samp(x) FILTER (treatment_flag = 1) + var_samp(x) FILTER (treatment_flag = 0)) / 2), 6) AS smd
FROM (SELECT treatment_flag, 'price_sensitivity' AS f, price_sensitivity AS x FROM t_summary UNION ALL SELECT treatment_flag, 'coupon_affinity', coupon_affinity FROM t_summary) GROUP BY 1""")
def _(v):
    return rounded(au.standardized_differences(v.summary(), ["price_sensitivity", "coupon_affinity"]))


@query("spearman", f"SELECT round(corr(a, b), 6) AS spearman FROM (SELECT {_PCT('frequency')} AS a, {_PCT('recency_days')} AS b FROM t_summary)")
def _(v):
    return rounded(au.spearman(v.summary(), "frequency", "recency_days"))


@query("treatment_balance_audit", f"""WITH s AS (SELECT max(abs(d)) AS m FROM (SELECT (avg(x) FILTER (treatment_flag = 1) - avg(x) FILTER (treatment_flag = 0)) / sqrt((var_samp(x) FILTER (treatment_flag = 1) + var_samp(x) FILTER (treatment_flag = 0)) / 2) AS d
  FROM (SELECT treatment_flag, 'p' AS f, price_sensitivity AS x FROM t_summary UNION ALL SELECT treatment_flag, 'c', coupon_affinity FROM t_summary) GROUP BY f)),
r AS (SELECT corr(a, b) AS rho FROM (SELECT {_PCT('churn_probability')} AS a, {_PCT('recency_days')} AS b FROM t_summary)),
t AS (SELECT avg(CASE WHEN recency_days >= 30 THEN 1.0 ELSE 0 END) AS o, avg(CASE WHEN recency_days >= 30 THEN 1.0 ELSE 0 END) FILTER (churn_probability >= (SELECT quantile_cont(churn_probability, 0.9) FROM t_summary)) AS d FROM t_summary),
u AS (SELECT (SELECT count(*) FROM t_customers) AS n, count(DISTINCT customer_id) FILTER (event_type = 'visit') AS vi, count(DISTINCT customer_id) FILTER (event_type = 'purchase') AS pu FROM t_events)
SELECT round(vi / CAST(n AS DOUBLE), 6) AS visit_user_rate, 0.0 AS browse_user_rate, 0.0 AS cart_user_rate, round(pu / CAST(n AS DOUBLE), 6) AS purchase_user_rate, CAST(pu AS DOUBLE) AS cart_to_purchase_user_rate, round(m, 6) AS max_abs_smd, round(rho, 6) AS spearman,
  round(o, 6) AS actual_churn_overall, round(d, 6) AS actual_churn_top_decile, m > 0.10 AS warn_imbalance, pu > vi AS warn_funnel, rho < 0.25 AS warn_weak_alignment FROM s, r, t, u""")
def _(v):
    return rounded(au.treatment_balance_audit(v.summary(), v.customers(), v.events(), v.orders()))


@query("data_diagnostics", """WITH k AS (SELECT customer_id FROM t_summary WHERE customer_id % 50 > 0)
SELECT 'customer_summary' AS dataset, count(*) AS rows, count(DISTINCT customer_id) AS unique_customers, 0 AS orphan_customers FROM k
UNION ALL SELECT 'events', count(*), count(DISTINCT customer_id), count(DISTINCT customer_id) FILTER (customer_id NOT IN (SELECT customer_id FROM k)) FROM t_events
UNION ALL SELECT 'orders', count(*), count(DISTINCT customer_id), count(DISTINCT customer_id) FILTER (customer_id NOT IN (SELECT customer_id FROM k)) FROM t_orders
UNION ALL SELECT 'exposures', count(*), count(DISTINCT customer_id), count(DISTINCT customer_id) FILTER (customer_id NOT IN (SELECT customer_id FROM k)) FROM t_exposures""")
def _(v):
    return au.data_diagnostics(v.summary().where("customer_id % 50 > 0"), {"events": v.events(), "orders": v.orders(), "exposures": v.exposures()})


@query("orphan_customers", "SELECT DISTINCT customer_id FROM t_orders WHERE customer_id NOT IN (SELECT customer_id FROM t_summary WHERE customer_id % 7 > 0)")
def _(v):
    return au.orphan_customers(v.orders(), v.summary().where("customer_id % 7 > 0"))


_CR = """b AS (SELECT s.*, coalesce(n, 0) AS xc, coalesce(k, 0) AS rd FROM t_summary s LEFT JOIN (SELECT customer_id, count(*) AS n FROM t_exposures GROUP BY 1) USING (customer_id) LEFT JOIN (SELECT customer_id, count(*) AS k FROM t_orders WHERE coupon_used = 1 AND order_time >= TIMESTAMP '2001-01-01' GROUP BY 1) USING (customer_id))"""
_CRC = """count(*) AS customers, count(*) FILTER (xc > 0) AS exposed_customers, count(*) FILTER (xc >= 3) AS high_exposure_customers, CAST(sum(xc) AS BIGINT) AS total_exposures, round(sum(rd) / CAST(sum(xc) AS DOUBLE), 6) AS redeem_rate, round(avg(xc), 6) AS avg_coupon_exposure,
  round(avg(churn_probability), 6) AS avg_churn_probability, count(*) FILTER (xc >= 3) / CAST(count(*) AS DOUBLE) >= 0.15 AS flag_high_exposure, coalesce(sum(rd) / CAST(sum(xc) AS DOUBLE) < 0.02, false) AS flag_low_redeem"""


@query("coupon_risk", f"WITH {_CR} SELECT persona, {_CRC} FROM b GROUP BY 1 UNION ALL SELECT 'ALL', {_CRC} FROM b")
def _(v):
    x = v.exposures().groupBy("customer_id").agg(F.count(F.lit(1)).alias("coupon_exposure_count"))
    r = v.orders().where("coupon_used = 1 AND order_time >= timestamp_ntz'2001-01-01 00:00:00'").groupBy("customer_id").agg(F.count(F.lit(1)).alias("coupon_redeem_count"))
    return rounded(au.coupon_risk(v.summary().join(x, "customer_id", "left").join(r, "customer_id", "left")))


@query("diagnostic_checks", """WITH k AS (SELECT * FROM t_summary WHERE customer_id % 50 > 0), n AS (SELECT count(DISTINCT customer_id) AS n FROM k),
x AS (SELECT 'repeated_customers' AS "check", (SELECT count(*) - count(DISTINCT customer_id) FROM k) AS value, 0 AS expected
UNION ALL SELECT 'missing_scores', (SELECT count(*) FILTER (churn_probability IS NULL) + count(*) FILTER (uplift_score IS NULL) + count(*) FILTER (clv IS NULL) FROM k), 0
UNION ALL SELECT 'events_orphans', (SELECT count(DISTINCT customer_id) FROM t_events WHERE customer_id NOT IN (SELECT customer_id FROM k)), 0
UNION ALL SELECT 'orders_orphans', (SELECT count(DISTINCT customer_id) FROM t_orders WHERE customer_id NOT IN (SELECT customer_id FROM k)), 0
UNION ALL SELECT 'assignments_coverage', (SELECT count(DISTINCT customer_id) FROM t_assign), n FROM n)
SELECT "check", value, expected, CASE WHEN "check" LIKE '%_coverage' THEN value = 0 OR value = expected ELSE value = 0 END AS ok FROM x""")
def _(v):
    return au.diagnostic_checks(v.summary().where("customer_id % 50 > 0"), {"events": v.events(), "orders": v.orders()}, {"assignments": v.assignments()})


@query("customer_mix", """SELECT 'persona' AS dimension, persona AS value, count(*) AS count, count(*) / CAST((SELECT count(*) FROM t_summary) AS DOUBLE) AS share FROM t_summary GROUP BY persona
UNION ALL SELECT 'uplift_segment', uplift_segment, count(*), count(*) / CAST((SELECT count(*) FROM t_summary) AS DOUBLE) FROM t_summary GROUP BY uplift_segment""")
def _(v):
    return au.value_mix(v.summary(), ("persona", "uplift_segment"))


@query("coupon_totals", f"""WITH {_CR}, o AS (SELECT customer_id, count(*) AS op FROM t_exposures WHERE customer_id % 3 = 0 GROUP BY 1)
SELECT count(*) FILTER (xc > 0) AS exposed_customers, count(*) FILTER (xc >= 3) AS high_exposure_customers, CAST(sum(xc) AS BIGINT) AS total_exposures, round(sum(coalesce(op, 0)) / CAST(sum(xc) AS DOUBLE), 6) AS open_rate, round(sum(rd) / CAST(sum(xc) AS DOUBLE), 6) AS redeem_rate,
  (SELECT round(CAST(sum(coupon_cost) AS DOUBLE), 3) FROM t_exposures) AS coupon_spend_total FROM b LEFT JOIN o USING (customer_id)""")
def _(v):
    x = v.exposures().groupBy("customer_id").agg(F.count(F.lit(1)).alias("coupon_exposure_count"), F.expr("count_if(customer_id % 3 = 0) AS coupon_opens"))
    r = v.orders().where("coupon_used = 1 AND order_time >= timestamp_ntz'2001-01-01 00:00:00'").groupBy("customer_id").agg(F.count(F.lit(1)).alias("coupon_redeem_count"))
    return rounded(au.coupon_totals(v.summary().join(x, "customer_id", "left").join(r, "customer_id", "left"), v.exposures()), {"coupon_spend_total": 3})


@query("operations_overview", "SELECT persona, count(*) AS customers, round(avg(churn_probability), 6) AS avg_churn_probability, round(avg(uplift_score), 6) AS avg_uplift_score, round(avg(clv), 3) AS avg_clv FROM t_summary GROUP BY 1")
def _(v):
    return rounded(au.operations_overview(v.summary()), {"avg_clv": 3})


@query("event_mix", "SELECT event_type, count(*) AS count, count(*) / CAST((SELECT count(*) FROM t_events) AS DOUBLE) AS share FROM t_events GROUP BY 1")
def _(v):
    return au.event_mix(v.events())


@query("experiment_overview", _AB + """ SELECT n_t AS treatment_n, n_c AS control_n, round(p_c - p_t, 6) AS incremental_retention, round((p_c - p_t) * n_t, 4) AS incremental_retained_customers,
  (SELECT sum(coupon_cost) FROM t_exposures) AS coupon_spend_total, CASE WHEN p_c > p_t THEN round((SELECT sum(coupon_cost) FROM t_exposures) / ((p_c - p_t) * n_t), 3) END AS incremental_cpic, round((rev_t - rev_c) * n_t, 1) AS incremental_revenue FROM b""")
def _(v):
    s = ex.ab_statistics(uplift_data(v))
    spend = v.exposures().agg(F.sum("coupon_cost").alias("coupon_spend_total"))
    return rounded(s.crossJoin(spend).selectExpr(
        "n_t AS treatment_n", "n_c AS control_n", "incremental_retention_lift AS incremental_retention", "incremental_retained_customers", "coupon_spend_total",
        "CASE WHEN incremental_retained_customers > 0 THEN coupon_spend_total / incremental_retained_customers END AS incremental_cpic", "incremental_revenue"),
        {"incremental_retained_customers": 4, "incremental_cpic": 3, "incremental_revenue": 1})
