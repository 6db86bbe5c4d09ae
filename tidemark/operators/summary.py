"""Customer summary over day-inclusive windows and its rank-calibrated churn."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import at, bound, chain
from ..functions.ordered import pct_ranks, quantile_row, shared
from .scoring import uplift_band

KEY = "customer_id"
# Churn boost by persona.
PERSONA_BOOST = {"vip_loyal": -0.12, "regular_loyal": -0.06, "price_sensitive": 0.04, "explorer": 0.06, "churn_progressing": 0.18, "new_signup": 0.05}
UPLIFT_ADJUST = {"persuadable": 0.05, "sure_thing": -0.01, "lost_cause": -0.04, "sleeping_dog": -0.09}


def _case(col: str, values: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 0D END"


def calibrate_by_rank(df: DataFrame, raw: str, inactivity: str, threshold: int, out: str = "churn_probability") -> DataFrame:
    """Logistic of the percent rank, centred so that the share above one half fits the observed inactivity."""
    df = shared(df)
    share = df.agg(F.expr(f"least(greatest(avg(CASE WHEN {inactivity} >= {threshold} THEN 1D ELSE 0D END), 0.15), 0.25) AS _share"))
    ranks = pct_ranks(df, KEY, {"_pct": raw})
    j = df.join(ranks, KEY, "left").crossJoin(F.broadcast(share))
    return j.withColumn(out, F.expr(bound("1 / (1 + exp(-(_pct - (1 - _share)) / 0.10))", 0.01, 0.99))).drop("_pct", "_share")


def inclusive_counts(df: DataFrame, time: str, end: str, windows: dict[str, tuple[int, int]]) -> list:
    """windows: name -> (first day back, last day back), both included, on whole dates."""
    return [F.expr(f"count_if(to_date({time}) BETWEEN date_sub(to_date({end}), {a}) AND date_sub(to_date({end}), {b})) AS {name}")
            for name, (a, b) in windows.items()]


def build_customer_summary(customers: DataFrame, assignments: DataFrame, events: DataFrame, orders: DataFrame, exposures: DataFrame,
                           final_state: DataFrame, *, end_date: str, churn_days: int = 30) -> DataFrame:
    """``final_state``: customer_id, recency_days, inactivity_days, frequency, monetary and the fatigue scores it has."""
    end = at(end_date)
    ev = events.groupBy(KEY).agg(
        F.expr(f"count_if(event_type = 'visit' AND to_date(timestamp) BETWEEN date_sub(to_date({end}), 6) AND to_date({end})) AS visits_last_7"),
        F.expr(f"count_if(event_type = 'visit' AND to_date(timestamp) BETWEEN date_sub(to_date({end}), 13) AND date_sub(to_date({end}), 7)) AS visits_prev_7"),
        F.expr("count_if(event_type = 'coupon_redeem') AS coupon_redeem_count"))
    od = orders.groupBy(KEY).agg(*inclusive_counts(orders, "order_time", end, {"purchase_last_30": (29, 0), "purchase_prev_30": (59, 30)}))
    ex = exposures.groupBy(KEY).agg(F.count(F.lit(1)).alias("coupon_exposure_count"))
    df = customers.join(assignments, KEY, "left").join(final_state, KEY, "left").join(ev, KEY, "left").join(od, KEY, "left").join(ex, KEY, "left")
    have = set(df.columns)
    opt = lambda n: n if n in have else "0D"
    zero = ("frequency", "monetary", "visits_last_7", "visits_prev_7", "purchase_last_30", "purchase_prev_30", "coupon_redeem_count", "coupon_exposure_count")
    df = df.withColumns({n: F.expr(f"coalesce({n}, 0)") for n in zero})
    latent = (f"{opt('treatment_lift_base')} + 0.05 * coupon_affinity - 0.04 * price_sensitivity"
              + (f" + {_case('uplift_segment_true', UPLIFT_ADJUST)}" if "uplift_segment_true" in have else ""))
    df = chain(
        df,
        visit_change_rate="(visits_last_7 - visits_prev_7) / greatest(visits_prev_7, 1)",
        purchase_change_rate="(purchase_last_30 - purchase_prev_30) / greatest(purchase_prev_30, 1)",
        uplift_score=bound(f"0.55 * ({latent}) + 0.20 * (coupon_redeem_count + 1D) / (coupon_exposure_count + 4D) "
                           "+ CASE WHEN coupon_exposure_count > 0 THEN 0.08 ELSE 0D END", -0.15, 0.42),
    )
    df = shared(df)
    p95 = quantile_row(df, {"_m95": "monetary", "_f95": "frequency"}, [0.95])
    scaled = lambda x, top: bound(f"{x} / greatest({top}, 1D)", "0D", "1D")
    raw = (
        f"0.34 * {bound(f'recency_days / {max(churn_days * 1.5, 1)}D', '0D', '1D')} + 0.20 * (1 - {scaled('frequency', '_f95_0')})"
        f" + 0.16 * (1 - {scaled('monetary', '_m95_0')}) + CASE WHEN visit_change_rate < 0 THEN 0.13 ELSE 0D END"
        f" + CASE WHEN purchase_change_rate < 0 THEN 0.13 ELSE 0D END + 0.04 * {bound(f'inactivity_days / {max(churn_days, 1)}D', '0D', '1D')}"
        f" + 0.05 * CASE WHEN persona = 'new_signup' THEN {bound(f'(120 - greatest(datediff({end}, signup_date), 0)) / 120D', '0D', '1D')} ELSE 0D END"
        f" + {_case('persona', PERSONA_BOOST)}")
    df = df.crossJoin(F.broadcast(p95)).withColumn("_raw", F.expr(bound(raw, 0.01, 0.99))).drop("_m95_0", "_f95_0")
    df = calibrate_by_rank(df, "_raw", "inactivity_days", churn_days).drop("_raw")
    z = lambda n: f"coalesce({opt(n)}, 0D)"
    df = chain(
        df,
        clv="greatest(monetary * (1.30 + 1.25 * least(greatest(1.15 - churn_probability, 0.20), 1.15)) "
            "+ frequency * greatest(monetary / greatest(frequency, 1), 20000D) * 0.55, 15000D)",
        discount_pressure_score=f"greatest({z('coupon_fatigue_score')} * (0.55 + 0.45 * {z('discount_fatigue_sensitivity')}) + 0.60 * {z('discount_dependency_score')}, 0D)",
        discount_effect_penalty=bound(f"1 - 0.08 * discount_pressure_score - 0.05 * {z('brand_sensitivity')}", 0.55, "1D"),
        expected_incremental_profit="greatest(clv * uplift_score * discount_effect_penalty, -50000D)",
        expected_roi="(expected_incremental_profit - coupon_cost) / greatest(coupon_cost, 1)",
        uplift_segment=uplift_band(),
    )
    return df
