"""What each action would earn per customer, against doing nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import add, bound, chain
from ..functions.ordered import min_max_scaled
from .decisions import survival_timing

KEY = "customer_id"
# The action catalog as (id, label, cost, uplift multiplier, channel).
ACTIONS = (
    ("no_action", "무개입", 0.0, 0.0, "none"),
    ("coupon_5000", "5,000원 혜택", 5000.0, 1.00, "benefit"),
    ("consult_call", "상담 전화", 12000.0, 1.18, "call_center"),
    ("push_email", "푸시/이메일", 800.0, 0.42, "owned_message"),
    ("wait_7d", "7일 대기", 0.0, 0.0, "defer"),
)


def _aliases(df: DataFrame, names, default: str) -> str:
    have = [f"try_cast({n} AS double)" for n in names if n in df.columns]
    return f"coalesce({', '.join([*have, default])})"


def counterfactual_pool(customers: DataFrame, selected: DataFrame | None = None, survival: DataFrame | None = None, *, threshold: float = 0.5, top: int | None = None) -> DataFrame:
    """At-risk customers and already selected ones, one row each, best ranked first."""
    base = add(
        customers,
        churn_probability=bound(_aliases(customers, ["churn_probability", "realtime_churn_score", "churn_score"], "0D"), "0D", "1D"),
        uplift_score=bound(_aliases(customers, ["uplift_score", "expected_uplift", "incremental_retention_probability"], "0D"), -0.30, 0.60),
        clv=f"greatest({_aliases(customers, ['predicted_clv_12m', 'clv', 'customer_lifetime_value', 'monetary'], '0D')}, 0D)")
    if selected is not None:
        keep = [x for x in ("recommended_action", "intervention_intensity", "coupon_cost", "expected_incremental_profit", "expected_roi", "priority_score", "selection_score")
                if x in selected.columns]
        order = [f"-coalesce({x}, -1e300)" for x in ("selection_score", "priority_score", "expected_incremental_profit") if x in selected.columns]
        one = selected.groupBy(KEY).agg(F.expr(f"min_by(struct({', '.join(keep)}), struct({', '.join(order or ['0'])})) AS _s"))
        base = base.join(one, KEY, "left").where(f"churn_probability >= {threshold} OR _s IS NOT NULL")
        base = base.select(*[F.expr(f"coalesce({x}, _s.{x}) AS {x}") if x in keep else F.col(x) for x in base.columns if x != "_s"],
                           *[F.expr(f"_s.{x} AS {x}") for x in keep if x not in base.columns])
    else:
        base = base.where(f"churn_probability >= {threshold}")
    base = survival_timing(base, survival)
    base = min_max_scaled(base, {"_v": "clv"})
    base = base.withColumn("_rank", F.expr(
        "0.34 * churn_probability + 0.26 * greatest(uplift_score, 0D) + 0.20 * _v + 0.20 * least(greatest(timing_urgency_score, 0D), 1D)")).drop("_v")
    out = base.orderBy(F.desc("_rank"), F.desc("churn_probability"), F.desc("clv"), KEY)
    return (out.limit(top) if top else out).drop("_rank")


def counterfactual_scenarios(pool: DataFrame) -> DataFrame:
    """Customer x action with treated churn and expected net profit."""
    opt = lambda n, d="0D": f"coalesce(try_cast({n} AS double), {d})" if n in pool.columns else d
    base = min_max_scaled(pool, {"_v": "clv", "_ca": opt("coupon_affinity"), "_ps": opt("price_sensitivity"), "_fa": opt("discount_pressure_score"), "_br": opt("brand_sensitivity")})
    base = add(base, _c=bound("churn_probability", "0D", "1D"), _u=bound("uplift_score", -0.30, 0.60), _w=bound(opt("churn_timing_weight", "1D"), 0.60, 1.60),
               _g=bound(opt("timing_urgency_score"), "0D", "1D"), _d=f"greatest({opt('intervention_window_days', '90D')}, 1D)", clv="greatest(clv, 0D)")
    rows = ", ".join(f"struct({i} AS action_order, '{a}' AS action_id, '{label}' AS action_label, {cost}D AS action_cost, {m}D AS _m, '{ch}' AS channel)"
                     for i, (a, label, cost, m, ch) in enumerate(ACTIONS))
    s = base.selectExpr("*", f"inline(array({rows}))")
    s = chain(
        s,
        _fit=bound("""CASE action_id
            WHEN 'coupon_5000' THEN 0.82 + 0.22 * _ca + 0.22 * _ps + 0.12 * _g - 0.18 * _fa
            WHEN 'consult_call' THEN 0.78 + 0.25 * _v + 0.18 * _c + 0.14 * _g + 0.08 * _br - 0.08 * _ca
            WHEN 'push_email' THEN 0.68 + 0.18 * greatest(_u, 0D) + 0.12 * (1 - _fa) + 0.10 * (1 - _g)
            ELSE 1D END""", 0.25, 1.35),
        treated_churn_probability="""CASE action_id WHEN 'no_action' THEN _c
            WHEN 'wait_7d' THEN least(greatest(_c + least(7 / _d, 1D) * (0.05 + 0.22 * _g + 0.20 * _c), 0D), 1D)
            ELSE least(greatest(_c - least(least(greatest(_u * _m * _w * _fit, -0.25), 0.45), _c), 0D), 1D) END""",
        estimated_retention_lift="""CASE action_id WHEN 'no_action' THEN 0D WHEN 'wait_7d' THEN _c - treated_churn_probability
            ELSE least(least(greatest(_u * _m * _w * _fit, -0.25), 0.45), _c) END""",
        option_value="CASE WHEN action_id = 'wait_7d' THEN greatest(0.018 * clv * (1 - _g) * greatest(_u, 0D), 0D) ELSE 0D END",
        expected_net_profit="clv * (1 - treated_churn_probability) + option_value - action_cost",
        incremental_vs_no_action="expected_net_profit - clv * (1 - _c)",
        scenario_roi="CASE WHEN action_cost > 0 THEN incremental_vs_no_action / action_cost END",
        estimated_churn_delta="treated_churn_probability - _c")
    return s.drop("_v", "_ca", "_ps", "_fa", "_br", "_c", "_w", "_g", "_d", "_m", "_fit")


def best_action(scenarios: DataFrame) -> DataFrame:
    """Best action per customer (ties: catalog order), margin, confidence and A/B flag. Groups hold five rows."""
    g = scenarios.groupBy(KEY).agg(*[F.expr(x) for x in (
        "min_by(struct(action_id, action_label, expected_net_profit, incremental_vs_no_action), struct(-expected_net_profit, action_order)) AS b",
        "sort_array(collect_list(expected_net_profit), false)[1] AS _second", "max(clv) AS _v", "max(_u) AS _u", "max(churn_probability) AS churn_probability")])
    return chain(
        g.selectExpr(KEY, "churn_probability", "b.action_id AS best_action_id", "b.action_label AS final_recommendation", "b.expected_net_profit AS best_expected_net_profit",
                     "b.incremental_vs_no_action", "greatest(b.expected_net_profit - _second, 0D) AS decision_margin", "_v", "_u"),
        confidence_score=bound("0.55 * 1.00 + 0.25 * least(greatest(decision_margin / CASE WHEN _v > 0 THEN _v ELSE 1D END, 0D), 0.35) / 0.35 "
                               "+ 0.20 * least(abs(_u), 0.20) / 0.20", "0D", "1D"),
        confidence="CASE WHEN confidence_score >= 0.74 THEN '높음' WHEN confidence_score >= 0.50 THEN '중간' ELSE '낮음' END",
        ab_test_recommended="confidence <> '높음' OR abs(incremental_vs_no_action) < CASE WHEN _v > 0 THEN _v ELSE 1D END * 0.02").drop("_v", "_u")


def counterfactual_summary(best: DataFrame) -> DataFrame:
    return best.agg(*[F.expr(x) for x in (
        "count(1) AS customer_count", f"count(1) * {len(ACTIONS)} AS scenario_count", "coalesce(avg(incremental_vs_no_action), 0D) AS avg_incremental",
        "count_if(incremental_vs_no_action > 0) AS positive_recommendations", "count_if(ab_test_recommended) AS ab_test_recommended_count",
        "avg(confidence_score) AS avg_confidence_score", *[f"count_if(best_action_id = '{a[0]}') AS n_{a[0]}" for a in ACTIONS])])
