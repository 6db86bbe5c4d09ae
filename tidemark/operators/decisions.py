"""When to act, on whom, how strongly: timing, segments, actions and candidate pools."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import add, bound, chain
from ..functions.ordered import cheap, min_max_scaled, quantile_row, shared
from .scoring import customer_segment

KEY = "customer_id"
HORIZON = 90
# Intensity profiles, intensity bias by segment, window labels, strategies by segment.
INTENSITY = {
    "low": {"label": "저강도", "cost": 0.65, "effect": 0.88, "timing": 0.96, "elasticity": 0.28, "pressure": 0.08},
    "mid": {"label": "중강도", "cost": 1.00, "effect": 1.00, "timing": 1.00, "elasticity": 0.22, "pressure": 0.14},
    "high": {"label": "고강도", "cost": 1.45, "effect": 0.98, "timing": 1.02, "elasticity": 0.18, "pressure": 0.22},
}
SEGMENT_BIAS = {
    "High Value-Persuadables": (0.95, 1.08, 1.18),
    "High Value-Sure Things": (1.05, 0.92, 0.78),
    "High Value-Lost Causes": (0.88, 0.80, 0.68),
    "Low Value-Persuadables": (1.10, 0.98, 0.84),
    "Low Value-Sure Things": (1.06, 0.90, 0.74),
    "Low Value-Lost Causes": (0.82, 0.72, 0.58),
    "New Customers": (1.02, 0.94, 0.86),
}
UPLIFT_BIAS = {
    "Persuadables": (1.02, 1.08, 1.12),
    "Sure Things": (1.04, 0.92, 0.76),
    "Lost Causes": (0.84, 0.74, 0.60),
    "Sleeping Dogs": (0.84, 0.74, 0.60),
}
WINDOW_LABELS = ((14, "14일 이내 즉시 연락", "immediate"), (30, "15~30일 안에 연락", "near_term"), (60, "31~60일 안에 계획적으로 연락", "planned"))
STRATEGIES = {
    "High Value-Persuadables": ("VIP 고객 전담 상담 및 맞춤 혜택 안내", 30000, 1.15),
    "High Value-Sure Things": ("충성 고객 감사 안내", 8000, 0.15),
    "High Value-Lost Causes": ("담당자 심층 상담", 12000, 0.10),
    "Low Value-Persuadables": ("맞춤 혜택 안내", 7000, 0.85),
    "Low Value-Lost Causes": ("미개입 관찰", 0, 0.0),
    "Low Value-Sure Things": ("가벼운 재방문 안내", 3000, 0.05),
    "New Customers": ("가입 초기 이용 안내", 5000, 0.20),
}
DEFAULT_STRATEGY = "기본 고객 유지 혜택 안내"


def _num(df: DataFrame, name: str, default: str) -> str:
    return f"coalesce(try_cast({name} AS double), {default})" if name in df.columns else default


# ---- timing -----------------------------------------------------------
def _nearest(days: list[int], target: int) -> int:
    return min(days, key=lambda d: (abs(d - target), d))


def survival_timing(df: DataFrame, survival: DataFrame | None = None, *, horizon: int = HORIZON) -> DataFrame:
    """Adds urgency, timing weight and contact window from survival predictions."""
    found = sorted(int(m.group(1)) for x in (survival.columns if survival is not None else []) if (m := re.fullmatch(r"survival_prob_(\d+)d", x)))
    tail = min(horizon, 60)
    if survival is None:
        return add(
            df, predicted_hazard_ratio="1D", predicted_median_time_to_churn_days=f"{horizon}D", risk_percentile="0D", risk_group="'Unknown'",
            short_term_survival_probability="1D", short_term_churn_probability="0D", mid_term_survival_probability="1D",
            mid_term_churn_probability="0D", timing_urgency_score="0D", churn_timing_weight="1D", intervention_window_days=f"{horizon}",
            recommended_intervention_window=f"'{tail}일 이후 관찰'", timing_priority_bucket="'monitor'")
    keep = [KEY, *[x for x in ("predicted_hazard_ratio", "predicted_median_time_to_churn_days", "risk_percentile", "risk_group") if x in survival.columns],
            *[f"survival_prob_{d}d" for d in found]]
    out = df.join(survival.select(*keep), KEY, "left")
    ref = found[-1] if found else horizon
    short = f"survival_prob_{_nearest(found, min(30, ref))}d" if found else None
    mid = f"survival_prob_{_nearest(found, min(60, ref))}d" if found else None
    prob = lambda n: bound(f"coalesce({n}, 1D)", "0D", "1D") if n else "1D"
    out = add(out, predicted_hazard_ratio=f"greatest({_num(out, 'predicted_hazard_ratio', '1D')}, 0D)",
              predicted_median_time_to_churn_days=bound(_num(out, "predicted_median_time_to_churn_days", f"{ref}D"), "1D", f"{ref}D"),
              risk_group="coalesce(risk_group, 'Unknown')" if "risk_group" in out.columns else "'Unknown'",
              short_term_survival_probability=prob(short), mid_term_survival_probability=prob(mid))
    out = min_max_scaled(out, {"_hz": "log1p(predicted_hazard_ratio)"})
    given = "risk_percentile" if "risk_percentile" in out.columns else "NULL"
    out = add(out, risk_percentile=bound(f"coalesce({given}, _hz)", "0D", "1D"),
              short_term_churn_probability="1 - short_term_survival_probability", mid_term_churn_probability="1 - mid_term_survival_probability")
    urgency = bound(f"0.45 * risk_percentile + 0.35 * (1 - short_term_survival_probability) "
                    f"+ 0.20 * (1 - least(greatest(predicted_median_time_to_churn_days / {max(ref, 1)}D, 0D), 1D))", "0D", "1D")
    out = out.withColumn("_u", F.expr(urgency))
    out = add(out, timing_urgency_score="bround(_u, 6)", churn_timing_weight="bround(0.85 + 0.60 * _u, 6)",
              intervention_window_days=bound("cast(bround(predicted_median_time_to_churn_days, 0) AS int)", 1, ref)).drop("_u", "_hz")
    pick = lambda i, rest: "CASE " + " ".join(f"WHEN intervention_window_days <= {w[0]} THEN '{w[i]}'" for w in WINDOW_LABELS) + f" ELSE '{rest}' END"
    return add(out, recommended_intervention_window=pick(1, f"{min(ref, 60)}일 이후 관찰"), timing_priority_bucket=pick(2, "monitor"))


# ---- segments ---------------------------------------------------------
def assign_segments(df: DataFrame) -> DataFrame:
    """Needs predicted_uplift, uplift_segment, predicted_clv_12m, is_high_value_top20pct, tenure_days, persona."""
    return chain(df, is_new_customer="coalesce(tenure_days, 0) < 90 OR coalesce(persona = 'new_signup', false)",
                 retention_priority_score="greatest(coalesce(predicted_uplift, 0D), 0D) * coalesce(predicted_clv_12m, 0D)",
                 customer_segment=customer_segment("is_high_value_top20pct", "uplift_segment", "is_new_customer"))


def segment_summary(df: DataFrame) -> DataFrame:
    total = df.agg(F.expr("greatest(count(1), 1) AS _t"))
    g = df.groupBy(F.col("customer_segment").alias("segment_name")).agg(
        F.count(F.lit(1)).alias("customer_count"), F.avg("predicted_clv_12m").alias("avg_clv"), F.avg("churn_probability").alias("avg_churn_probability"),
        F.avg("predicted_uplift").alias("avg_uplift"), F.avg("retention_priority_score").alias("avg_priority_score"))
    return g.crossJoin(F.broadcast(total)).withColumn("customer_ratio", F.expr("customer_count / _t")).drop("_t")


def strategy_join(df: DataFrame) -> DataFrame:
    table = df.sparkSession.createDataFrame(
        [(k, n, float(cost), float(eff)) for k, (n, cost, eff) in STRATEGIES.items()],
        "customer_segment string, strategy_name string, strategy_cost double, strategy_effect_multiplier double")
    return df.join(F.broadcast(table), "customer_segment", "left")


# ---- actions ----------------------------------------------------------
def _bias(df: DataFrame) -> str:
    """Intensity bias as SQL text over ``intervention_intensity``."""
    def table(col, rows):
        return [f"WHEN {col} = '{k}' THEN CASE intervention_intensity WHEN 'low' THEN {a}D WHEN 'mid' THEN {b}D ELSE {c}D END" for k, (a, b, c) in rows.items()]
    arms = table("customer_segment", SEGMENT_BIAS) if "customer_segment" in df.columns else []
    arms += table("uplift_segment", UPLIFT_BIAS) if "uplift_segment" in df.columns else []
    return "CASE " + " ".join(arms) + " ELSE 1D END" if arms else "1D"


def _per_intensity(field: str) -> str:
    return "CASE intervention_intensity " + " ".join(f"WHEN '{k}' THEN {p[field]}D" for k, p in INTENSITY.items()) + " END"


def action_candidates(df: DataFrame, survival: DataFrame | None = None, *, dose: DataFrame | None = None, timed: bool = False) -> DataFrame:
    """Customer x intensity actions with cost, effect, profit, revenue, ROI and priority.

    ``dose`` (customer_id, intervention_intensity, incremental_effect, and optionally
    cost_multiplier) switches from the heuristic effect to a learned one.
    """
    base = add(
        df,
        strategy_name=f"coalesce(strategy_name, '{DEFAULT_STRATEGY}')" if "strategy_name" in df.columns else f"'{DEFAULT_STRATEGY}'",
        strategy_effect_multiplier="greatest(" + (_num(df, "strategy_effect_multiplier", "1D") if "strategy_effect_multiplier" in df.columns
                                                  else _num(df, "effect_multiplier", "1D")) + ", 0.1)",
        strategy_cost="greatest(" + (_num(df, "strategy_cost", "0D") if "strategy_cost" in df.columns else _num(df, "coupon_cost", "0D")) + ", 0D)")
    base = base if timed else survival_timing(base, survival)
    base = min_max_scaled(base, {
        "coupon_affinity_norm": _num(base, "coupon_affinity", "0D"), "price_sensitivity_norm": _num(base, "price_sensitivity", "0D"),
        "uplift_score_norm": _num(base, "uplift_score", "0D"), "window_rank_score": _num(base, "intervention_window_days", "90D"),
        "_pressure": _num(base, "discount_pressure_score", "0D"), "_brand": _num(base, "brand_sensitivity", "0D")})
    profit = _num(base, "expected_incremental_profit", "0D")
    revenue = "base_expected_revenue" if "base_expected_revenue" in base.columns else "NULL"
    base = add(base, base_expected_revenue=f"greatest(coalesce({revenue}, {profit} + strategy_cost), 0D)", base_net_incremental_profit=f"greatest({profit}, 0D)")
    actions = base.withColumn("intervention_intensity", F.expr("explode(array('low', 'mid', 'high'))"))
    actions = add(
        actions, action_id=f"concat(cast({KEY} AS string), '::', intervention_intensity)",
        intervention_intensity_label="CASE intervention_intensity " + " ".join(f"WHEN '{k}' THEN '{p['label']}'" for k, p in INTENSITY.items()) + " END")
    value = f"coalesce({_num(base, 'predicted_clv_12m', 'NULL')}, {_num(base, 'clv', 'NULL')}, base_expected_revenue)"
    if dose is None:
        actions = chain(
            actions,
            intensity_cost_multiplier=_per_intensity("cost"),
            coupon_cost="bround(strategy_cost * intensity_cost_multiplier, 2)",
            segment_intensity_bias=_bias(actions),
            _ready=bound("0.38 * coupon_affinity_norm + 0.20 * price_sensitivity_norm + 0.22 * uplift_score_norm + 0.20 * timing_urgency_score", "0D", "1D"),
            _urgent=bound("0.55 * timing_urgency_score + 0.25 * risk_percentile + 0.20 * (1 - window_rank_score)", "0D", "1D"),
            fatigue_guardrail_multiplier=bound(f"1 - {_per_intensity('pressure')} * _pressure - 0.06 * _brand", 0.55, "1D"),
            _fit="""CASE intervention_intensity
                WHEN 'low' THEN 0.86 + 0.18 * least(greatest(0.55 * coupon_affinity_norm + 0.45 * uplift_score_norm, 0D), 1D) + 0.08 * (1 - _urgent)
                WHEN 'mid' THEN 0.94 + 0.12 * _ready + 0.06 * _urgent
                ELSE 0.72 + 0.18 * _ready + 0.16 * _urgent + 0.08 * coupon_affinity_norm + 0.06 * price_sensitivity_norm - 0.14 * (1 - _ready) END""",
            intensity_effect_multiplier=bound(
                f"{_per_intensity('effect')} * {_per_intensity('timing')} * segment_intensity_bias * _fit "
                f"* (1 + {_per_intensity('elasticity')} * (_ready - 0.5)) * fatigue_guardrail_multiplier", 0.30, 1.25),
            expected_incremental_profit="greatest(base_net_incremental_profit * churn_timing_weight * intensity_effect_multiplier - (coupon_cost - strategy_cost), -coupon_cost)",
        ).drop("_ready", "_urgent", "_fit")
    else:
        has_cost = "cost_multiplier" in dose.columns
        actions = actions.join(dose.select(KEY, "intervention_intensity", "incremental_effect", *(["cost_multiplier"] if has_cost else [])),
                               [KEY, "intervention_intensity"], "left")
        actions = chain(
            actions,
            intensity_cost_multiplier=bound(f"coalesce(cost_multiplier, {_per_intensity('cost')})", 0.35, 2.10) if has_cost else _per_intensity("cost"),
            coupon_cost="bround(strategy_cost * intensity_cost_multiplier, 2)",
            dose_response_incremental_effect=bound("coalesce(incremental_effect, 0D)", -0.35, 0.75),
            intensity_effect_multiplier=bound(f"abs(dose_response_incremental_effect) / greatest(abs({_num(base, 'uplift_score', '0D')}), 0.02)", 0.20, 2.50),
            fatigue_guardrail_multiplier=bound("1 - 0.18 * _pressure - 0.05 * _brand", 0.55, "1D"),
            expected_incremental_profit=f"greatest(greatest(dose_response_incremental_effect * strategy_effect_multiplier * greatest({value}, 0D) * churn_timing_weight, 0D) "
                                        "* fatigue_guardrail_multiplier - coupon_cost, -coupon_cost)",
        ).drop("incremental_effect", "cost_multiplier")
    actions = add(
        actions, expected_revenue="greatest(expected_incremental_profit + coupon_cost, 0D)",
        expected_roi="expected_incremental_profit / CASE WHEN coupon_cost > 0 THEN coupon_cost ELSE 1D END",
        recommended_action="concat(strategy_name, ' · ', intervention_intensity_label, ' · ', recommended_intervention_window)")
    worth = f"coalesce({_num(base, 'predicted_clv_12m', 'NULL')}, {_num(base, 'clv', '0D')})"
    actions = min_max_scaled(actions, {"roi_rank_score": "expected_roi", "profit_rank_score": "expected_incremental_profit", "value_rank_score": worth})
    churn = bound(_num(base, "churn_probability", "0D"), "0D", "1D")
    return actions.withColumn("priority_score", F.expr(
        f"0.26 * roi_rank_score + 0.24 * profit_rank_score + 0.14 * {churn} + 0.10 * greatest({_num(base, 'uplift_score', '0D')}, 0D) "
        "+ 0.12 * timing_urgency_score + 0.08 * (1 - window_rank_score) + 0.06 * value_rank_score - 0.08 * _pressure")).drop("_pressure", "_brand")


def policy_candidates(segments: DataFrame, survival: DataFrame | None = None, dose: DataFrame | None = None) -> DataFrame:
    """Segment strategies turned into scored actions, ready for the budget selection."""
    a = action_candidates(strategy_join(segments), survival, dose=dose)
    a = a.withColumn("optimization_score", F.expr("expected_incremental_profit / CASE WHEN coupon_cost > 0 THEN coupon_cost ELSE 1D END"))
    a = min_max_scaled(a, {"_opt": "optimization_score"})
    return a.withColumn("selection_score", F.expr("0.55 * priority_score + 0.45 * _opt")).drop("_opt")


POLICY_ORDER = [("selection_score", False), ("priority_score", False), ("optimization_score", False), ("timing_urgency_score", False),
                ("expected_revenue", False), ("retention_priority_score", False), ("customer_id", True), ("coupon_cost", True)]
POLICY_ELIGIBLE = ("coupon_cost > 0 AND expected_revenue > 0 AND expected_incremental_profit > 0 "
                   "AND coalesce(uplift_segment, '') <> 'Sleeping Dogs'")


# ---- candidate pool of the budget view --------------------------------
def _first(df: DataFrame, names, positive: bool = False) -> str:
    vals = []
    for n in names:
        if n in df.columns:
            v = f"try_cast({n} AS double)"
            vals.append(f"CASE WHEN {v} > 0 THEN {v} END" if positive else v)
    return f"coalesce({', '.join(vals)})" if vals else "cast(NULL AS double)"


def fill_economics(df: DataFrame) -> DataFrame:
    """Fills only missing or zero economics from aliases and fallbacks."""
    monetary = "CASE WHEN try_cast(monetary AS double) > 0 THEN try_cast(monetary AS double) * 6 END" if "monetary" in df.columns else "NULL"
    out = add(
        df,
        churn_probability=bound(f"coalesce({_first(df, ['churn_probability', 'churn_score', 'risk_score'])}, 0D)", "0D", "1D"),
        _clv=f"greatest(coalesce({_first(df, ['clv', 'predicted_clv_12m', 'predicted_clv', 'customer_lifetime_value', 'ltv'], True)}, {monetary}, 50000D), 1D)",
        _uplift=_first(df, ["uplift_score", "uplift", "incremental_response", "treatment_effect"], True),
        _profit=_first(df, ["expected_incremental_profit", "expected_profit", "incremental_profit", "expected_net_profit"], True),
        _roi=_first(df, ["expected_roi", "roi"], True),
        _cost=_first(df, ["strategy_cost", "coupon_cost", "action_cost", "intervention_cost", "cost"], True),
        _coupon=_first(df, ["coupon_cost"], True))
    seg = "trim(coalesce(uplift_segment, ''))" if "uplift_segment" in df.columns else None
    out = chain(
        out, clv="_clv",
        uplift_score="greatest(coalesce(_uplift, CASE WHEN _profit / clv > 0 THEN _profit / clv END, 0.03), 0.001)",
        strategy_cost="greatest(coalesce(_cost, try_divide(_profit, _roi), least(greatest(clv * 0.12, 10000D), 80000D)), 1D)",
        coupon_cost="coalesce(_coupon, strategy_cost)",
        expected_incremental_profit="coalesce(_profit, _roi * strategy_cost, clv * uplift_score * greatest(churn_probability, 0.50))",
        expected_roi="coalesce(_roi, try_divide(expected_incremental_profit, strategy_cost), 0D)",
        uplift_segment="'Persuadables'" if seg is None else
        f"CASE WHEN lower({seg}) NOT IN ('', 'nan', 'none', 'unknown', 'live', 'unknown_segment') THEN {seg} "
        "WHEN expected_incremental_profit <= 0 THEN 'Lost Causes' WHEN uplift_score < 0.02 THEN 'Sure Things' ELSE 'Persuadables' END")
    return out.drop("_clv", "_uplift", "_profit", "_roi", "_cost", "_coupon")


def candidate_pool(df: DataFrame, *, threshold: float = 0.5, survival: DataFrame | None = None) -> DataFrame:
    a = action_candidates(fill_economics(df), survival)
    a = a.withColumn("optimization_score", F.expr("expected_incremental_profit / CASE WHEN coupon_cost > 0 THEN coupon_cost ELSE 1D END"))
    pool = a.where(f"churn_probability >= {threshold} AND uplift_score > 0 AND expected_incremental_profit > 0 AND coupon_cost > 0 AND uplift_segment <> 'Sleeping Dogs'")
    pool = min_max_scaled(pool, {
        "roi_rank_score": "expected_roi", "profit_rank_score": "expected_incremental_profit", "clv_rank_score": "clv",
        "timing_rank_score": "timing_urgency_score", "_window": "intervention_window_days", "intensity_fit_rank_score": "intensity_effect_multiplier",
        "optimization_rank_score": "optimization_score"})
    return cheap(chain(
        pool, window_rank_score="1 - _window",
        priority_score="0.18 * roi_rank_score + 0.18 * profit_rank_score + 0.14 * churn_probability + 0.10 * uplift_score + 0.10 * clv_rank_score "
                       "+ 0.12 * timing_rank_score + 0.08 * window_rank_score + 0.10 * intensity_fit_rank_score",
        selection_score="0.55 * priority_score + 0.45 * optimization_rank_score").drop("_window"))


POOL_ORDER = [("selection_score", False), ("priority_score", False), ("optimization_score", False), ("timing_urgency_score", False),
              ("expected_roi", False), ("expected_incremental_profit", False), ("intervention_window_days", True), ("coupon_cost", True), ("customer_id", True)]


# ---- status and rankings ----------------------------------------------
def churn_status(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    p = "coalesce(try_cast(churn_probability AS double), 0D)"
    return df.agg(*[F.expr(x) for x in (
        "count(1) AS total_customers", f"count_if({p} >= {threshold}) AS at_risk_customers",
        f"coalesce(avg(CASE WHEN {p} >= {threshold} THEN 1D ELSE 0D END), 0D) AS risk_rate", f"coalesce(avg({p}), 0D) AS avg_churn_prob")])


def at_risk_customers(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.where(f"coalesce(churn_probability, 0) >= {threshold}").orderBy(F.desc("churn_probability"), F.desc("clv"), KEY)


def distribution_table(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    total = df.agg(F.expr("greatest(count(1), 1) AS _t"))
    g = df.groupBy(F.expr(f"coalesce(cast({column} AS string), 'Unknown')").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    out = g.crossJoin(F.broadcast(total)).selectExpr("name", "count", "count / _t AS share").orderBy(F.desc("count"), "name")
    return out.limit(limit) if limit else out


def high_value_rank(df: DataFrame, top: int | None = None) -> DataFrame:
    out = df.withColumn("value_score", F.expr("coalesce(clv, 0D) * coalesce(uplift_score, 0D)")).orderBy(F.desc("value_score"), F.desc("clv"), KEY)
    return out.limit(top) if top else out


def retention_targets(df: DataFrame, threshold: float = 0.5, top: int | None = None) -> DataFrame:
    df = shared(df)
    med = quantile_row(df, {"_clv": "coalesce(clv, 0D)"}, [0.5])
    t = df.crossJoin(F.broadcast(med)).where(
        f"churn_probability >= {threshold} AND uplift_score > 0.08 AND clv > _clv_0 AND coalesce(uplift_segment, '') <> 'Sleeping Dogs'").drop("_clv_0")
    t = shared(t)
    best = t.agg(F.expr("greatest(max(clv), 1D) AS _max"))
    out = t.crossJoin(F.broadcast(best)).withColumn("priority_score", F.expr(
        "0.45 * churn_probability + 0.25 * uplift_score + 0.30 * (clv / _max)")).drop("_max").orderBy(F.desc("priority_score"), F.desc("expected_roi"), KEY)
    return out.limit(top) if top else out


def churn_timing_table(df: DataFrame, survival: DataFrame, *, base_date: str, top: int | None = None) -> DataFrame:
    """Expected days to churn, 30-day churn, expected loss and date."""
    t = survival_timing(df, survival)
    out = chain(t, expected_days="predicted_median_time_to_churn_days", churn_30d="1 - short_term_survival_probability",
                expected_loss="greatest(coalesce(clv, 0D), 0D) * churn_probability",
                expected_churn_date=f"date_add(date'{base_date}', cast(ceil(expected_days) AS int))").orderBy(
        "expected_days", F.desc("expected_loss"), KEY)
    return out.limit(top) if top else out
