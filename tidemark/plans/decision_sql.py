"""DuckDB text of the decision views, in the oracle's own words."""

NORM = "CASE WHEN max({x}) OVER () - min({x}) OVER () < 1e-12 THEN 0 ELSE (({x}) - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"


def norm(x):
    return NORM.format(x=x)


def cl(x, lo=0, hi=1):
    return f"least(greatest({x}, {lo}), {hi})"


def timing_sql(src):
    return f"""SELECT * REPLACE (round_even(timing_urgency_score, 6) AS timing_urgency_score),
   round_even(0.85 + 0.60 * timing_urgency_score, 6) AS churn_timing_weight,
   CASE WHEN intervention_window_days <= 14 THEN '14일 이내 즉시 연락' WHEN intervention_window_days <= 30 THEN '15~30일 안에 연락'
        WHEN intervention_window_days <= 60 THEN '31~60일 안에 계획적으로 연락' ELSE '60일 이후 관찰' END AS recommended_intervention_window,
   CASE WHEN intervention_window_days <= 14 THEN 'immediate' WHEN intervention_window_days <= 30 THEN 'near_term'
        WHEN intervention_window_days <= 60 THEN 'planned' ELSE 'monitor' END AS timing_priority_bucket
FROM (SELECT *, {cl('0.45 * risk_percentile + 0.35 * (1 - s30) + 0.20 * (1 - med / 90)')} AS timing_urgency_score,
        CAST(least(greatest(round_even(med, 0), 1), 90) AS INTEGER) AS intervention_window_days
      FROM (SELECT s.*, predicted_hazard_ratio, v.survival_prob_30d AS s30, v.survival_prob_60d AS s60, v.predicted_median_time_to_churn_days AS med,
              {norm('ln(1 + predicted_hazard_ratio)')} AS risk_percentile FROM {src} s JOIN t_survival v USING (customer_id)))"""


def actions_sql(src, segment):
    """``src`` has strategy_cost, strategy_name and the summary columns."""
    lv = lambda a, b, c: f"CASE i WHEN 'low' THEN {a} WHEN 'mid' THEN {b} ELSE {c} END"
    up = {"Persuadables": (1.02, 1.08, 1.12), "Sure Things": (1.04, 0.92, 0.76), "Lost Causes": (0.84, 0.74, 0.60), "Sleeping Dogs": (0.84, 0.74, 0.60)}
    sg = {"High Value-Persuadables": (0.95, 1.08, 1.18), "High Value-Sure Things": (1.05, 0.92, 0.78), "High Value-Lost Causes": (0.88, 0.80, 0.68),
          "Low Value-Persuadables": (1.10, 0.98, 0.84), "Low Value-Sure Things": (1.06, 0.90, 0.74), "Low Value-Lost Causes": (0.82, 0.72, 0.58),
          "New Customers": (1.02, 0.94, 0.86)}
    bias = f"CASE {segment} " + " ".join(f"WHEN '{k}' THEN {lv(*v)}" for k, v in {**up, **sg}.items()) + " ELSE 1.0 END"
    value = "predicted_clv_12m" if segment == "customer_segment" else "clv"
    return f"""
SELECT *, 0.26 * roi_rank_score + 0.24 * profit_rank_score + 0.14 * {cl('churn_probability')} + 0.10 * greatest(uplift_score, 0) + 0.12 * timing_urgency_score
   + 0.08 * (1 - window_rank_score) + 0.06 * value_rank_score - 0.08 * pr AS priority_score
FROM (SELECT *, {norm('expected_roi')} AS roi_rank_score, {norm('expected_incremental_profit')} AS profit_rank_score, {norm(value)} AS value_rank_score
 FROM (SELECT * REPLACE (p2 AS expected_incremental_profit, p2 / CASE WHEN coupon_cost > 0 THEN coupon_cost ELSE 1 END AS expected_roi),
         greatest(p2 + coupon_cost, 0) AS expected_revenue
  FROM (SELECT *, greatest(greatest(expected_incremental_profit, 0) * churn_timing_weight * eff - (coupon_cost - strategy_cost), -coupon_cost) AS p2
   FROM (SELECT *, {cl(f"{lv(0.88, 1.0, 0.98)} * {lv(0.96, 1.0, 1.02)} * segment_intensity_bias * fit * (1 + {lv(0.28, 0.22, 0.18)} * (rd - 0.5)) * guard", 0.30, 1.25)} AS eff
    FROM (SELECT *, CASE i WHEN 'low' THEN 0.86 + 0.18 * {cl('0.55 * ca + 0.45 * un')} + 0.08 * (1 - ug)
                  WHEN 'mid' THEN 0.94 + 0.12 * rd + 0.06 * ug
                  ELSE 0.72 + 0.18 * rd + 0.16 * ug + 0.08 * ca + 0.06 * ps - 0.14 * (1 - rd) END AS fit,
            {cl(f"1 - {lv(0.08, 0.14, 0.22)} * pr - 0.06 * br", 0.55, 1)} AS guard, {bias} AS segment_intensity_bias
     FROM (SELECT * REPLACE (round_even(strategy_cost * {lv(0.65, 1.0, 1.45)}, 2) AS coupon_cost),
             {cl('0.38 * ca + 0.20 * ps + 0.22 * un + 0.20 * timing_urgency_score')} AS rd,
             {cl('0.55 * timing_urgency_score + 0.25 * risk_percentile + 0.20 * (1 - window_rank_score)')} AS ug
      FROM (SELECT *, {norm('coupon_affinity')} AS ca, {norm('price_sensitivity')} AS ps, {norm('uplift_score')} AS un,
              {norm('intervention_window_days')} AS window_rank_score, {norm('discount_pressure_score')} AS pr, {norm('brand_sensitivity')} AS br
            FROM ({timing_sql(src)})), (SELECT unnest(['low', 'mid', 'high']) AS i)))))))"""


T_POOL_BASE = """
SELECT * REPLACE (profit AS expected_incremental_profit, coalesce(CASE WHEN expected_roi > 0 THEN expected_roi END, profit / strategy_cost) AS expected_roi, up AS uplift_score)
FROM (SELECT *, CASE WHEN expected_incremental_profit > 0 THEN expected_incremental_profit
        WHEN expected_roi > 0 THEN expected_roi * strategy_cost ELSE clv * up * greatest(churn_probability, 0.5) END AS profit
      FROM (SELECT *, coupon_cost AS strategy_cost, 'x' AS strategy_name,
              greatest(coalesce(CASE WHEN uplift_score > 0 THEN uplift_score END, CASE WHEN expected_incremental_profit > 0 THEN expected_incremental_profit / clv END, 0.03), 0.001) AS up
            FROM t_summary))
"""

T_POOL = f"""
SELECT *, 0.55 * pool_priority + 0.45 * opt AS selection_score
FROM (SELECT *, 0.18 * r1 + 0.18 * r2 + 0.14 * churn_probability + 0.10 * uplift_score + 0.10 * r3 + 0.12 * r4 + 0.08 * (1 - r5) + 0.10 * r6 AS pool_priority
 FROM (SELECT *, {norm('expected_roi')} AS r1, {norm('expected_incremental_profit')} AS r2, {norm('clv')} AS r3, {norm('timing_urgency_score')} AS r4,
         {norm('intervention_window_days')} AS r5, {norm('eff')} AS r6, {norm('expected_roi')} AS opt
  FROM (SELECT * FROM ({actions_sql('t_pool_base', 'uplift_segment')}) WHERE churn_probability >= 0.2 AND uplift_score > 0 AND expected_incremental_profit > 0 AND coupon_cost > 0
        AND uplift_segment <> 'Sleeping Dogs')))
"""

T_SEGMENTS = """
SELECT *, CASE WHEN is_new THEN 'New Customers'
   WHEN high THEN CASE uplift_segment WHEN 'Persuadables' THEN 'High Value-Persuadables' WHEN 'Sure Things' THEN 'High Value-Sure Things' ELSE 'High Value-Lost Causes' END
   ELSE CASE uplift_segment WHEN 'Persuadables' THEN 'Low Value-Persuadables' WHEN 'Sure Things' THEN 'Low Value-Sure Things' ELSE 'Low Value-Lost Causes' END END AS customer_segment
FROM (SELECT *, clv AS predicted_clv_12m, uplift_score AS predicted_uplift, clv >= quantile_cont(clv, 0.8) OVER () AS high,
        greatest(uplift_score, 0) * clv AS retention_priority_score,
        date_diff('day', signup_date, TIMESTAMP '1997-01-01') AS tenure_days, date_diff('day', signup_date, TIMESTAMP '1997-01-01') < 90 AS is_new FROM t_summary)
"""

T_STRATEGY = """
SELECT g.*, s.n AS strategy_name, CAST(s.c AS DOUBLE) AS strategy_cost, CAST(s.e AS DOUBLE) AS strategy_effect_multiplier FROM t_segments g JOIN (VALUES
 ('High Value-Persuadables', 'VIP 고객 전담 상담 및 맞춤 혜택 안내', 30000, 1.15), ('High Value-Sure Things', '충성 고객 감사 안내', 8000, 0.15),
 ('High Value-Lost Causes', '담당자 심층 상담', 12000, 0.10), ('Low Value-Persuadables', '맞춤 혜택 안내', 7000, 0.85),
 ('Low Value-Lost Causes', '미개입 관찰', 0, 0.0), ('Low Value-Sure Things', '가벼운 재방문 안내', 3000, 0.05),
 ('New Customers', '가입 초기 이용 안내', 5000, 0.20)) s(seg, n, c, e) ON s.seg = g.customer_segment
"""

T_POLICY = f"""
SELECT *, 0.55 * priority_score + 0.45 * {norm('expected_roi')} AS selection_score FROM ({actions_sql('t_strategy', 'customer_segment')})
"""


def greedy_sql(src, order, budgets, cap=None, high_cap="NULL", one=True, key="customer_id"):
    """Row-by-row walk as a recursive query; ``budgets`` is a list of (id, amount)."""
    vals = ", ".join(f"('{b}', CAST({v} AS BIGINT))" for b, v in budgets)
    dup = f"list_contains(w.used, r.{key})" if one else "false"
    stop = f" OR w.n >= {cap}" if cap else ""
    bad = f"({dup} OR r.cents > w.remain OR (r.hi = 1 AND w.h >= {high_cap}){stop})" if high_cap != "NULL" else f"({dup} OR r.cents > w.remain{stop})"
    return f"""WITH RECURSIVE b(budget_id, amount) AS (VALUES {vals}),
r AS (SELECT row_number() OVER (ORDER BY {order}) AS pos, {key}, CAST(round(coupon_cost * 100) AS BIGINT) AS cents, {"CASE WHEN i = 'high' THEN 1 ELSE 0 END" if high_cap != "NULL" else "0"} AS hi
      FROM {src} WHERE coupon_cost > 0),
w AS (SELECT budget_id, CAST(0 AS BIGINT) AS pos, amount * 100 AS remain, CAST([] AS BIGINT[]) AS used, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS h, false AS hit FROM b
      UNION ALL
      SELECT budget_id, r.pos, CASE WHEN {bad} THEN w.remain ELSE w.remain - r.cents END, CASE WHEN {bad} OR {'false' if one else 'true'} THEN w.used ELSE list_append(w.used, r.{key}) END,
             CASE WHEN {bad} THEN w.n ELSE w.n + 1 END, CASE WHEN {bad} THEN w.h ELSE w.h + r.hi END, NOT {bad}
      FROM w JOIN r ON r.pos = w.pos + 1),
g AS (SELECT budget_id, pos FROM w WHERE hit),
x AS (SELECT *, row_number() OVER (ORDER BY {order}) AS pos FROM {src} WHERE coupon_cost > 0),
sel AS (SELECT * FROM g JOIN x USING (pos))"""
