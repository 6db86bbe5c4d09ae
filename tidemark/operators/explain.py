"""Reasons behind a decision, from percent ranks or fixed thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import add, first_rows
from ..functions.ordered import pct_ranks, shared

KEY = "customer_id"
# Rules as (feature, direction, percent-rank threshold, code).
RISK_RULES = (
    ("inactivity_days", "high", 0.80, "extended_inactivity"),
    ("recency_days", "high", 0.80, "purchase_recency_drop"),
    ("visit_change_rate_14d", "low", 0.20, "visit_decline"),
    ("purchase_change_rate_14d", "low", 0.20, "purchase_decline"),
    ("support_contact_30d", "high", 0.80, "support_contact_spike"),
    ("cart_conversion_change_rate", "low", 0.20, "cart_conversion_drop"),
    ("purchase_cycle_anomaly", "high", 0.80, "purchase_cycle_break"),
)
LEVER_RULES = (
    ("uplift_score", "high", 0.70, "high_uplift"),
    ("coupon_affinity", "high", 0.70, "coupon_affinity"),
    ("clv", "high", 0.75, "high_clv"),
    ("timing_urgency_score", "high", 0.70, "timing_urgent"),
)
GUARDRAIL_RULES = (
    ("discount_pressure_score", "high", 0.75, "discount_pressure"),
    ("coupon_fatigue_score", "high", 0.75, "coupon_fatigue"),
    ("brand_sensitivity", "high", 0.70, "brand_sensitivity"),
)
NO_REASON = "핵심 신호를 종합해 관찰 대상에 포함"
NO_WATCHOUT = "가격·서비스·타이밍 리스크를 함께 점검"
HIGH_NOTE = "고강도 개입 전 빈도 캡 필요"


def _hits(rules, have, take: str) -> str:
    items = [f"CASE WHEN _p_{f} {'>=' if d == 'high' else '<='} {t} THEN '{f if take == 'feature' else code}' END" for f, d, t, code in rules if f in have]
    return f"filter(array({', '.join(items)}), x -> x IS NOT NULL)" if items else "cast(array() AS array<string>)"


def operational_reasons(df: DataFrame) -> DataFrame:
    """First three risk, two lever and two guardrail reasons in rule order, with fallbacks."""
    have = [f for f, *_ in (*RISK_RULES, *LEVER_RULES, *GUARDRAIL_RULES) if f in df.columns]
    df = shared(df)
    ranks = pct_ranks(df, KEY, {f"_p_{f}": f"coalesce({f}, 0)" for f in have})
    out = df.join(ranks, KEY)
    out = add(out, _risk=_hits(RISK_RULES, have, "code"), _lever=_hits(LEVER_RULES, have, "code"), _guard=_hits(GUARDRAIL_RULES, have, "code"),
              _rf=_hits(RISK_RULES, have, "feature"), _lf=_hits(LEVER_RULES, have, "feature"))
    empty_risk = "size(_risk) = 0 AND coalesce(churn_probability, 0) >= 0.5"
    empty_lever = "size(_lever) = 0 AND coalesce(expected_roi, 0) > 0"
    out = add(out, _rf=f"CASE WHEN {empty_risk} THEN array('churn_probability') ELSE _rf END", _lf=f"CASE WHEN {empty_lever} THEN array('expected_roi') ELSE _lf END",
              _risk=f"CASE WHEN {empty_risk} THEN array('high_churn_score') ELSE _risk END",
              _lever=f"CASE WHEN {empty_lever} THEN array('positive_expected_roi') ELSE _lever END")
    note = "coalesce(recommended_action, '')" if "recommended_action" in df.columns else "''"
    high = "coalesce(intervention_intensity = 'high', false)" if "intervention_intensity" in df.columns else "false"
    return out.selectExpr(
        KEY, "concat_ws(', ', slice(_risk, 1, 3)) AS risk_reason_codes", "concat_ws(', ', slice(_lever, 1, 2)) AS action_reason_codes",
        "concat_ws(', ', slice(_guard, 1, 2)) AS guardrail_codes", "concat_ws(', ', concat(slice(_rf, 1, 2), slice(_lf, 1, 2))) AS dominant_features",
        f"CASE WHEN size(_guard) > 0 AND {high} THEN concat_ws(' | ', nullif({note}, ''), '{HIGH_NOTE}') ELSE {note} END AS recommended_action_note",
        "coalesce(expected_roi, 0D) AS expected_roi", "coalesce(expected_incremental_profit, 0D) AS expected_incremental_profit")


def reason_frequency(explained: DataFrame, column: str, top: int | None = None) -> DataFrame:
    out = explained.selectExpr(f"explode(split({column}, ', ')) AS code").where("code <> ''").groupBy("code").agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.desc("count"), "code")
    return out.limit(top) if top else out


def customer_explanations(customers: DataFrame, extras: list[DataFrame], top: int | None = None) -> DataFrame:
    """Joins decision, recommendation, survival and live rows; reasons by fixed thresholds."""
    df = customers
    for e in extras:
        df = df.join(e.select(KEY, *[x for x in e.columns if x not in df.columns]), KEY, "left")
    z = lambda *names: "coalesce(" + ", ".join([*[n for n in names if n in df.columns], "0D"]) + ")"
    window = [n for n in ("intervention_window_days", "predicted_median_time_to_churn_days") if n in df.columns]
    # fixed values: limits and texts of the reasons and of the points to watch
    reasons = [
        (f"{z('churn_probability', 'realtime_churn_score')} >= 0.6", "이탈 위험이 높음"),
        (f"{z('uplift_score', 'predicted_uplift')} >= 0.02", "개입 반응 가능성이 큼"),
        (f"{z('clv')} >= 1000000", "고객 가치가 높음"),
        (f"coalesce({', '.join(window)}) <= 7" if window else "false", "개입 시한이 촉박함"),
        (f"{z('expected_roi')} >= 0.3", "예상 ROI가 양호함"),
        (f"{z('coupon_affinity')} >= 0.7 AND {z('price_sensitivity')} >= 0.7", "할인 반응성이 높은 편"),
        (f"{z('coupon_exposure_count')} >= 3", "최근 쿠폰 노출이 누적됨"),
    ]
    risk = "lower(coalesce(risk_group, '')) LIKE 'high%'" if "risk_group" in df.columns else "false"
    watch = [
        (f"{z('coupon_exposure_count')} >= 3", "과도한 쿠폰 학습 가능성"), (f"{z('price_sensitivity')} >= 0.8", "할인 없이는 반응 저하 가능"),
        (f"{z('support_contact_propensity')} >= 0.5", "서비스 이슈형 대응 검토"), (risk, "단기 이탈 가속 주의"),
    ]
    def text(rules, n, empty):
        arr = f"slice(filter(array({', '.join(f'CASE WHEN {c} THEN {chr(39)}{t}{chr(39)} END' for c, t in rules)}), x -> x IS NOT NULL), 1, {n})"
        return f"CASE WHEN size({arr}) > 0 THEN concat_ws(', ', {arr}) ELSE '{empty}' END"
    sort = [F.desc(x) for x in ("selection_score", "realtime_churn_score", "churn_probability", "uplift_score", "clv") if x in df.columns]
    return add(first_rows(df.orderBy(*sort, KEY), top), selection_reason=text(reasons, 4, NO_REASON), watchout=text(watch, 3, NO_WATCHOUT))


# ---- dimensions of live rows ------------------------------------------
# Texts that stand for nothing, and the column names a dimension may have.
PLACEHOLDERS = ("", "live", "live_user", "unknown", "unknown_segment", "nan", "none", "null")
PERSONA_ALIASES = ("persona", "customer_persona", "customer_segment", "lifecycle_segment", "marketing_segment", "segment_name", "membership_tier",
                   "member_tier", "membership_grade", "tier", "grade")
UPLIFT_ALIASES = ("uplift_segment", "uplift_group", "uplift_bucket", "treatment_segment", "campaign_segment", "response_segment", "persuadable_segment")


def restore_dimensions(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Persona and uplift segment from row or JSON payload, else derived, else a fallback label."""
    marks = ", ".join(f"'{p}'" for p in PLACEHOLDERS)

    def lookup(names):
        src = []
        for n in names:
            src += ([f"cast({n} AS string)"] if n in df.columns else []) + ([f"get_json_object({payload}, '$.{n}')"] if payload in df.columns else [])
        return "coalesce(" + ", ".join(f"nullif(trim({s}), '')" for s in src) + ")" if src else "cast(NULL AS string)"

    good = lambda x: f"({x} IS NOT NULL AND lower(trim({x})) NOT IN ({marks}))"
    out = add(df, _p=lookup(PERSONA_ALIASES), _u=lookup(UPLIFT_ALIASES), _tier=lookup(PERSONA_ALIASES[6:]), _age=lookup(("age_group", "age_band", "age_segment")),
              _region=lookup(("region", "area", "city", "province")), _gender=lookup(("gender", "sex")),
              _score=f"try_cast({lookup(('uplift_score', 'uplift', 'predicted_uplift', 'treatment_effect'))} AS double)")
    parts = "filter(array(_tier, _age, _region, _gender), x -> x IS NOT NULL AND lower(trim(x)) NOT IN (" + marks + "))"
    band = ("CASE WHEN _score IS NULL OR isnan(_score) THEN 'unknown_segment' WHEN _score >= 0.08 THEN 'very_high_uplift' WHEN _score >= 0.05 THEN 'high_uplift' "
            "WHEN _score >= 0.02 THEN 'medium_uplift' WHEN _score >= 0 THEN 'low_uplift' ELSE 'negative_uplift' END")
    out = add(out, persona=f"CASE WHEN {good('_p')} THEN _p WHEN size({parts}) > 0 THEN concat_ws(' / ', slice({parts}, 1, 3)) ELSE 'unknown_persona' END",
              persona_source=f"CASE WHEN {good('_p')} THEN 'payload' WHEN size({parts}) > 0 THEN 'derived' ELSE 'fallback' END",
              uplift_segment=f"CASE WHEN {good('_u')} THEN _u ELSE {band} END",
              uplift_segment_source=f"CASE WHEN {good('_u')} THEN 'payload' WHEN _score IS NULL THEN 'fallback' ELSE 'derived_from_uplift_score' END")
    return out.drop("_p", "_u", "_tier", "_age", "_region", "_gender", "_score")
