"""Timing, segments, actions, pools and budgets on the long history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget as bu, decisions as de
from ..operators.scoring import uplift_by_risk
from ..sources import tables as tb
from .decision_sql import actions_sql, greedy_sql, timing_sql
from .registry import query, rounded

THR, BUDGET = 0.2, 2_000_000
_POOL_SORT = ("selection_score DESC, pool_priority DESC, expected_roi DESC, timing_urgency_score DESC, expected_roi DESC, expected_incremental_profit DESC, "
              "intervention_window_days, coupon_cost, customer_id")
_POLICY_SORT = ("selection_score DESC, priority_score DESC, expected_roi DESC, timing_urgency_score DESC, expected_revenue DESC, retention_priority_score DESC, customer_id, coupon_cost")
_POLICY_OK = "(SELECT * FROM t_policy WHERE coupon_cost > 0 AND expected_revenue > 0 AND expected_incremental_profit > 0 AND uplift_segment <> 'Sleeping Dogs')"


def segments(v):
    from ..functions.ordered import quantile_row, shared

    s = shared(v.summary())
    p80 = quantile_row(s, {"_clv": "clv"}, [0.8])
    s = s.crossJoin(F.broadcast(p80)).selectExpr(
        "*", "clv AS predicted_clv_12m", "uplift_score AS predicted_uplift", "clv >= _clv_0 AS is_high_value_top20pct",
        "datediff(timestamp_ntz'1997-01-01 00:00:00', signup_date) AS tenure_days").drop("_clv_0")
    return de.assign_segments(s)


def pool(v):
    return de.candidate_pool(v.summary(), threshold=THR, survival=v.survival())


def policy(v):
    return de.policy_candidates(segments(v), v.survival()).where(de.POLICY_ELIGIBLE)


@query("survival_timing", f"""SELECT customer_id, round(risk_percentile, 6) AS risk_percentile, round(s30, 6) AS short_term_survival_probability, round(1 - s60, 6) AS mid_term_churn_probability,
  round(timing_urgency_score, 6) AS timing_urgency_score, round(churn_timing_weight, 6) AS churn_timing_weight, intervention_window_days, recommended_intervention_window, timing_priority_bucket
FROM ({timing_sql('t_summary')})""")
def _(v):
    t = de.survival_timing(v.summary(), v.survival())
    return rounded(t.select("customer_id", "risk_percentile", "short_term_survival_probability", "mid_term_churn_probability", "timing_urgency_score", "churn_timing_weight",
                            "intervention_window_days", "recommended_intervention_window", "timing_priority_bucket"))


@query("customer_segment", "SELECT customer_id, customer_segment, is_new AS is_new_customer, round(retention_priority_score, 3) AS retention_priority_score FROM t_segments")
def _(v):
    return rounded(segments(v).select("customer_id", "customer_segment", "is_new_customer", "retention_priority_score"), default=3)


@query("segment_summary", """SELECT customer_segment AS segment_name, count(*) AS customer_count, round(avg(clv), 3) AS avg_clv, round(avg(churn_probability), 6) AS avg_churn_probability,
  round(avg(uplift_score), 6) AS avg_uplift, round(avg(retention_priority_score), 3) AS avg_priority_score, round(count(*) / CAST((SELECT count(*) FROM t_segments) AS DOUBLE), 6) AS customer_ratio
FROM t_segments GROUP BY 1""")
def _(v):
    return rounded(de.segment_summary(segments(v)), {"avg_clv": 3, "avg_priority_score": 3})


@query("strategy_join", "SELECT customer_id, customer_segment, strategy_name, strategy_cost, strategy_effect_multiplier FROM t_strategy")
def _(v):
    return de.strategy_join(segments(v)).select("customer_id", "customer_segment", "strategy_name", "strategy_cost", "strategy_effect_multiplier")


_ACT = ("customer_id", "intervention_intensity", "coupon_cost", "segment_intensity_bias", "intensity_effect_multiplier", "fatigue_guardrail_multiplier",
        "expected_incremental_profit", "expected_revenue", "expected_roi", "priority_score")
_ACT_SQL = """SELECT customer_id, i AS intervention_intensity, coupon_cost, CAST(segment_intensity_bias AS DOUBLE) AS segment_intensity_bias, round(eff, 6) AS intensity_effect_multiplier, round(guard, 6) AS fatigue_guardrail_multiplier,
  round(expected_incremental_profit, 2) AS expected_incremental_profit, round(expected_revenue, 2) AS expected_revenue, round(expected_roi, 5) AS expected_roi, round(priority_score, 6) AS priority_score FROM """
_ACT_DIGITS = {"expected_incremental_profit": 2, "expected_revenue": 2, "expected_roi": 5}


@query("action_candidates_heuristic", _ACT_SQL + f"({actions_sql('(SELECT *, coupon_cost AS strategy_cost FROM t_summary)', 'uplift_segment')})")
def _(v):
    return rounded(de.action_candidates(v.summary(), v.survival()).select(*_ACT), _ACT_DIGITS)


@query("policy_priority_score", _ACT_SQL + "t_policy")
def _(v):
    return rounded(de.policy_candidates(segments(v), v.survival()).select(*_ACT), _ACT_DIGITS)


@query("candidate_pool", """SELECT customer_id, i AS intervention_intensity, coupon_cost, round(expected_incremental_profit, 2) AS expected_incremental_profit, round(expected_roi, 5) AS expected_roi,
  round(pool_priority, 6) AS priority_score, round(selection_score, 6) AS selection_score FROM t_pool""")
def _(v):
    return rounded(pool(v).select("customer_id", "intervention_intensity", "coupon_cost", "expected_incremental_profit", "expected_roi", "priority_score", "selection_score"),
                   {"expected_incremental_profit": 2, "expected_roi": 5})


_HC = "(SELECT greatest(1, CAST(floor(count(*) * 0.35) AS BIGINT)) FROM t_pool)"
_SEL = greedy_sql("t_pool", _POOL_SORT, [("budget", BUDGET)], high_cap=_HC)


def selected(v, cap=None):
    return bu.select_under_budget(pool(v), de.POOL_ORDER, BUDGET, max_customers=cap)


@query("budget_select", _SEL + " SELECT customer_id, i AS intervention_intensity, coupon_cost, pos AS pick_order FROM sel")
def _(v):
    return selected(v).select("customer_id", "intervention_intensity", "coupon_cost", "pick_order")


@query("budget_select_capped", greedy_sql("t_pool", _POOL_SORT, [("budget", BUDGET)], cap=60, high_cap="21") + " SELECT customer_id, i AS intervention_intensity, coupon_cost, pos AS pick_order FROM sel")
def _(v):
    return selected(v, 60).select("customer_id", "intervention_intensity", "coupon_cost", "pick_order")


@query("policy_budget_select", greedy_sql(_POLICY_OK, _POLICY_SORT, [("budget", BUDGET)], high_cap=f"(SELECT greatest(1, CAST(floor(count(DISTINCT customer_id) * 0.35) AS BIGINT)) FROM {_POLICY_OK})")
       + " SELECT customer_id, i AS intervention_intensity, coupon_cost FROM sel")
def _(v):
    return bu.select_under_budget(policy(v), de.POLICY_ORDER, BUDGET, high_base="customers").select("customer_id", "intervention_intensity", "coupon_cost")


_SEGS = "(VALUES ('Persuadables'), ('Sure Things'), ('Sleeping Dogs'), ('Lost Causes')) s(uplift_segment)"


@query("segment_allocation", _SEL + f""" SELECT s.uplift_segment, k.i AS intervention_intensity, count(DISTINCT sel.customer_id) AS customer_count, round(coalesce(sum(coupon_cost), 0), 2) AS allocated_budget,
  round(coalesce(sum(expected_incremental_profit), 0), 1) AS expected_profit, round(coalesce(sum(expected_revenue), 0), 1) AS expected_revenue,
  round(coalesce((sum(expected_revenue) - sum(coupon_cost)) / nullif(sum(coupon_cost), 0), 0), 5) AS expected_roi
FROM {_SEGS} CROSS JOIN (SELECT unnest(['low', 'mid', 'high']) AS i) k LEFT JOIN sel ON sel.uplift_segment = s.uplift_segment AND sel.i = k.i GROUP BY 1, 2""")
def _(v):
    a = bu.segment_allocation(selected(v), segments=bu.SEGMENT_ORDER)
    return rounded(a, {"allocated_budget": 2, "expected_roi": 5}, default=1)


@query("segment_allocation_collapsed", _SEL + f""" SELECT s.uplift_segment, count(DISTINCT sel.customer_id) AS customer_count, round(coalesce(sum(coupon_cost), 0), 2) AS allocated_budget,
  round(coalesce(sum(expected_incremental_profit), 0), 1) AS expected_profit FROM {_SEGS} LEFT JOIN sel USING (uplift_segment) GROUP BY 1""")
def _(v):
    a = bu.segment_allocation(selected(v), segments=bu.SEGMENT_ORDER, by_intensity=False)
    return rounded(a.select("uplift_segment", "customer_count", "allocated_budget", "expected_profit"), {"allocated_budget": 2}, default=1)


@query("budget_scenarios", greedy_sql("t_pool", _POOL_SORT, [("50%", BUDGET // 2), ("100%", BUDGET), ("200%", BUDGET * 2)], high_cap=_HC) + """
SELECT b.budget_id AS scenario, amount AS budget, round(coalesce(sum(coupon_cost), 0), 2) AS spent, round(amount - coalesce(sum(coupon_cost), 0), 2) AS remaining, count(DISTINCT customer_id) AS num_targeted,
  round(coalesce(sum(expected_revenue), 0), 1) AS expected_revenue, round(coalesce((sum(expected_revenue) - sum(coupon_cost)) / sum(coupon_cost), 0), 5) AS expected_roi
FROM b LEFT JOIN sel USING (budget_id) GROUP BY 1, 2""")
def _(v):
    return rounded(bu.budget_scenarios(pool(v), de.POOL_ORDER, BUDGET), {"spent": 2, "remaining": 2, "expected_revenue": 1, "expected_roi": 5})


_GRID = [(str(b), b) for b in bu.sensitivity_grid(BUDGET)]
_SENS = greedy_sql("t_pool", _POOL_SORT, [(k, b) for k, b in _GRID if b > 0], high_cap=_HC) + f""",
gr(k, budget) AS (VALUES {", ".join(f"('{k}', CAST({b} AS BIGINT))" for k, b in _GRID)}),
a AS (SELECT budget, coalesce(sum(coupon_cost), 0) AS spent, count(DISTINCT customer_id) AS target_count, coalesce(sum(expected_incremental_profit), 0) AS profit FROM gr LEFT JOIN sel ON budget_id = k GROUP BY 1),
m AS (SELECT *, CASE WHEN spent > 0 THEN profit / spent ELSE 0 END AS roi FROM a),
d AS (SELECT *, lag(budget) OVER o AS pb, coalesce(budget - lag(budget) OVER o, 0) AS ab, coalesce(spent - lag(spent) OVER o, 0) AS asp, coalesce(target_count - lag(target_count) OVER o, 0) AS atc,
  coalesce(profit - lag(profit) OVER o, 0) AS ap, lag(roi) OVER o AS pr FROM m WINDOW o AS (ORDER BY budget)),
f AS (SELECT *, CASE WHEN ab > 0 THEN ap / ab * 1000000 ELSE 0 END AS m1, CASE WHEN asp > 0 THEN ap / asp ELSE 0 END AS mr FROM d)"""


@query("budget_sensitivity", _SENS + """ SELECT budget, round(spent, 2) AS spent, round(greatest(budget - spent, 0), 2) AS remaining, target_count, round(profit, 1) AS expected_incremental_profit, round(roi, 5) AS average_roi,
  ab AS added_budget, round(asp, 2) AS added_spend, atc AS added_target_count, round(ap, 1) AS added_profit, round(m1, 1) AS marginal_profit_per_1m, round(mr, 5) AS marginal_roi,
  CASE WHEN pb IS NULL THEN '기준 구간' WHEN round(ap, 6) <= 0 AND atc <= 0 THEN '포화 또는 낭비 주의' WHEN mr < 0.2 THEN '효율 낮음' WHEN roi < pr THEN 'ROI 하락 시작' WHEN mr >= roi THEN '확대 검토 가능' ELSE '점진 확대 가능' END AS budget_status FROM f""")
def _(v):
    t = bu.budget_sensitivity(pool(v), de.POOL_ORDER, BUDGET)
    return rounded(t, {"spent": 2, "remaining": 2, "average_roi": 5, "added_spend": 2, "marginal_roi": 5}, default=1)


@query("budget_sensitivity_summary", _SENS + f""", t AS (SELECT greatest(max(m1) * 0.15, 0) AS thr, max(m1) > 0 AS pos FROM f)
SELECT {BUDGET} AS current_budget, round((SELECT spent FROM f ORDER BY abs(budget - {BUDGET}), budget LIMIT 1), 2) AS current_spent, (SELECT target_count FROM f WHERE budget = {BUDGET}) AS current_target_count,
  round((SELECT profit FROM f WHERE budget = {BUDGET}), 1) AS current_expected_profit, round((SELECT mr FROM f WHERE budget = {BUDGET}), 5) AS current_marginal_roi,
  round(coalesce((SELECT ap FROM f WHERE budget >= {BUDGET} + 1000000 ORDER BY budget LIMIT 1), 0), 1) AS next_step_profit_gain,
  coalesce((SELECT min(budget) FROM f, t WHERE budget > 0 AND m1 <= thr AND atc <= 0), (SELECT min(budget) FROM f, t WHERE budget > 0 AND m1 <= thr AND pos)) AS saturation_budget,
  (SELECT min(budget) FROM f WHERE budget > 0 AND (mr < 0.2 OR m1 <= 0)) AS low_efficiency_budget""")
def _(v):
    t = bu.budget_sensitivity(pool(v), de.POOL_ORDER, BUDGET)
    return rounded(bu.sensitivity_summary(t, BUDGET), {"current_spent": 2, "current_marginal_roi": 5}, default=1)


@query("budget_summary", _SEL + f""" SELECT {BUDGET} AS budget, CAST(round_even(sum(coupon_cost), 0) AS BIGINT) AS spent, CAST(round_even({BUDGET} - sum(coupon_cost), 0) AS BIGINT) AS remaining, count(DISTINCT customer_id) AS num_targeted,
  (SELECT count(DISTINCT customer_id) FROM t_pool) AS candidate_customers, (SELECT count(*) FROM t_pool) AS candidate_actions, sum(coupon_cost) >= {BUDGET} * 0.98 AS budget_binding,
  round(sum(expected_incremental_profit), 1) AS expected_incremental_profit, round(sum(expected_incremental_profit) / sum(coupon_cost), 5) AS overall_roi,
  count(*) FILTER (i = 'low') AS n_low, count(*) FILTER (i = 'mid') AS n_mid, count(*) FILTER (i = 'high') AS n_high, round((SELECT avg(timing_urgency_score) FROM t_pool), 5) AS avg_timing_urgency_score FROM sel""")
def _(v):
    from ..functions.ordered import cut_lineage

    p = cut_lineage(pool(v))
    s = bu.select_under_budget(p, de.POOL_ORDER, BUDGET)
    return rounded(bu.budget_summary(p, s, BUDGET), {"overall_roi": 5, "avg_timing_urgency_score": 5}, default=1)


_BASE = f"""(SELECT *, 0.40 * r + 0.25 * p + 0.15 * churn_probability + 0.10 * u + 0.10 * vv AS bp FROM (SELECT *,
  (expected_roi - min(expected_roi) OVER ()) / (max(expected_roi) OVER () - min(expected_roi) OVER ()) AS r,
  (expected_incremental_profit - min(expected_incremental_profit) OVER ()) / (max(expected_incremental_profit) OVER () - min(expected_incremental_profit) OVER ()) AS p,
  (uplift_score - min(uplift_score) OVER ()) / (max(uplift_score) OVER () - min(uplift_score) OVER ()) AS u, (clv - min(clv) OVER ()) / (max(clv) OVER () - min(clv) OVER ()) AS vv
  FROM t_summary WHERE churn_probability >= {THR} AND uplift_score > 0 AND coupon_cost > 0 AND expected_incremental_profit > 0) ORDER BY bp DESC, expected_roi DESC, expected_incremental_profit DESC, churn_probability DESC, clv DESC, customer_id LIMIT 300)"""


@query("baseline_budget", greedy_sql(_BASE, "bp DESC, expected_roi DESC, expected_incremental_profit DESC, churn_probability DESC, clv DESC, customer_id", [("budget", 1_000_000)], one=False)
       + " SELECT customer_id, coupon_cost, round(bp, 6) AS baseline_priority_score FROM sel")
def _(v):
    return rounded(bu.baseline_budget(v.summary(), 1_000_000, threshold=THR, max_customers=300).select("customer_id", "coupon_cost", "baseline_priority_score"))


@query("churn_status", f"""SELECT count(*) AS total_customers, count(*) FILTER (churn_probability >= {THR}) AS at_risk_customers, round(avg(CASE WHEN churn_probability >= {THR} THEN 1.0 ELSE 0 END), 6) AS risk_rate,
  round(avg(churn_probability), 6) AS avg_churn_prob FROM t_summary""")
def _(v):
    return rounded(de.churn_status(v.summary(), THR))


@query("at_risk_customers", f"SELECT customer_id, round(churn_probability, 6) AS churn_probability, round(clv, 3) AS clv FROM t_summary WHERE churn_probability >= {THR}")
def _(v):
    return rounded(de.at_risk_customers(v.summary(), THR).select("customer_id", "churn_probability", "clv"), {"clv": 3})


@query("distribution_table", """SELECT persona AS name, count(*) AS count, count(*) / CAST((SELECT count(*) FROM t_summary) AS DOUBLE) AS share FROM t_summary GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def _(v):
    return de.distribution_table(v.summary(), "persona", 3)


@query("high_value_rank", "SELECT customer_id, round(clv * uplift_score, 3) AS value_score FROM t_summary ORDER BY clv * uplift_score DESC, clv DESC, customer_id LIMIT 50")
def _(v):
    return rounded(de.high_value_rank(v.summary(), 50).select("customer_id", "value_score"), default=3)


@query("retention_targets", f"""WITH t AS (SELECT * FROM t_summary WHERE churn_probability >= 0.1 AND uplift_score > 0.08 AND clv > (SELECT quantile_cont(clv, 0.5) FROM t_summary) AND uplift_segment <> 'Sleeping Dogs')
SELECT customer_id, round(0.45 * churn_probability + 0.25 * uplift_score + 0.30 * clv / (SELECT max(clv) FROM t), 6) AS priority_score FROM t""")
def _(v):
    return rounded(de.retention_targets(v.summary(), 0.1).select("customer_id", "priority_score"))


@query("churn_timing_table", f"""SELECT customer_id, round(med, 5) AS expected_days, round(1 - s30, 6) AS churn_30d, round(greatest(clv, 0) * churn_probability, 3) AS expected_loss,
  DATE '2001-08-01' + CAST(ceil(med) AS INTEGER) AS expected_churn_date FROM ({timing_sql('t_summary')}) ORDER BY med, greatest(clv, 0) * churn_probability DESC, customer_id LIMIT 200""")
def _(v):
    t = de.churn_timing_table(v.summary(), v.survival(), base_date="2001-08-01", top=200)
    return rounded(t.select("customer_id", "expected_days", "churn_30d", "expected_loss", "expected_churn_date"), {"expected_days": 5, "expected_loss": 3})


@query("uplift_segment_by_risk", """SELECT customer_id, CASE WHEN uplift_score < 0 THEN 'Sleeping Dogs' WHEN uplift_score > 0.02 AND churn_probability >= 0.5 THEN 'Persuadables'
  WHEN abs(uplift_score) <= 0.02 AND churn_probability >= 0.5 THEN 'Lost Causes' ELSE 'Sure Things' END AS segment FROM t_summary""")
def _(v):
    return v.summary().selectExpr("customer_id", f"{uplift_by_risk('uplift_score', 'churn_probability')} AS segment")


@query("list_customers", """SELECT customer_id, persona, round(churn_probability, 6) AS churn_probability FROM t_summary WHERE persona = 'explorer' AND treatment_group = 'control' AND churn_probability >= 0.05
ORDER BY churn_probability DESC, customer_id LIMIT 40 OFFSET 20""")
def _(v):
    t = tb.list_customers(v.summary(), persona="explorer", treatment_group="control", min_churn_probability=0.05, sort_by="churn_probability", descending=True, limit=40, offset=20)
    return rounded(t.select("customer_id", "persona", "churn_probability"))
