"""A/B read-out on per-arm aggregates."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import chain

Z_ALPHA, Z_BETA = 1.959963984540054, 0.8416212335729143


def arm_totals(df: DataFrame) -> DataFrame:
    """One row with both arms: the only pass over customer rows."""
    arm = lambda a: f"FILTER (WHERE treatment_group = '{a}')"
    cols = []
    for s, a in (("t", "treatment"), ("c", "control")):
        cols += [f"count(1) {arm(a)} AS n_{s}", f"coalesce(sum(1 - least(greatest(coalesce(retained_60d, 0), 0), 1)) {arm(a)}, 0) AS churn_{s}",
                 f"coalesce(sum(coupon_cost) {arm(a)}, 0D) AS cost_{s}", f"coalesce(avg(revenue_post_60d) {arm(a)}, 0D) AS rev_{s}"]
    return df.agg(*[F.expr(x) for x in cols])


def ab_statistics(df: DataFrame) -> DataFrame:
    """z test, confidence interval, chi-square with continuity correction, sample size, MDE and money."""
    one = chain(
        arm_totals(df),
        p_t="churn_t / greatest(n_t, 1)", p_c="churn_c / greatest(n_c, 1)",
        difference="p_t - p_c",
        _pool="(churn_t + churn_c) / greatest(n_t + n_c, 1)",
        z_stat="difference / sqrt(greatest(_pool * (1 - _pool) * (1 / greatest(n_t, 1) + 1 / greatest(n_c, 1)), 1e-12D))",
        _ci="sqrt(greatest(p_t * (1 - p_t) / greatest(n_t, 1) + p_c * (1 - p_c) / greatest(n_c, 1), 1e-12D))",
        ci_low="difference - 1.96 * _ci", ci_high="difference + 1.96 * _ci",
        _det="abs(cast(churn_t AS double) * (n_c - churn_c) - cast(churn_c AS double) * (n_t - churn_t))",
        chi_square="(n_t + n_c) * pow(greatest(_det - (n_t + n_c) / 2D, 0D), 2) / "
                   "nullif(cast(n_t AS double) * n_c * (churn_t + churn_c) * (n_t + n_c - churn_t - churn_c), 0D)",
        _pt="least(greatest(p_t, 1e-6D), 1 - 1e-6D)", _pc="least(greatest(p_c, 1e-6D), 1 - 1e-6D)", _pb="(_pt + _pc) / 2",
        required_sample_size_per_group=f"cast(ceil(pow({Z_ALPHA}D * sqrt(2 * _pb * (1 - _pb)) + {Z_BETA}D * sqrt(_pc * (1 - _pc) + _pt * (1 - _pt)), 2) "
                                       "/ greatest(pow(_pt - _pc, 2), 1e-9D)) AS bigint)",
        minimum_detectable_effect=f"({Z_ALPHA}D + {Z_BETA}D) * sqrt(2 * _pc * (1 - _pc) / greatest(least(n_t, n_c), 1))",
        relative_change="difference / greatest(p_c, 1e-9D)",
        incremental_retention_lift="p_c - p_t", incremental_retained_customers="incremental_retention_lift * n_t",
        revenue_per_customer="rev_t - rev_c", incremental_revenue="revenue_per_customer * n_t",
        incremental_profit="incremental_revenue - cost_t",
        cost_per_retained="CASE WHEN incremental_retained_customers > 0 THEN cost_t / incremental_retained_customers END",
        incremental_roi="CASE WHEN cost_t > 0 THEN incremental_profit / cost_t END",
        meets_required_sample_size="least(n_t, n_c) >= required_sample_size_per_group",
        smaller_than_mde="abs(difference) < minimum_detectable_effect",
    )
    return one.select(*[x for x in one.columns if not x.startswith("_")])


def ab_test(df: DataFrame) -> DataFrame:
    """Adds p-values and achieved power: closed forms on the single aggregate row."""
    stats = ab_statistics(df)
    row = stats.first().asDict()
    n = NormalDist()
    pt, pc = (min(max(row[k], 1e-6), 1 - 1e-6) for k in ("p_t", "p_c"))
    pool = (pt + pc) / 2
    se0 = math.sqrt(max(pool * (1 - pool) * (1 / max(row["n_c"], 1) + 1 / max(row["n_t"], 1)), 1e-12))
    se1 = math.sqrt(max(pc * (1 - pc) / max(row["n_c"], 1) + pt * (1 - pt) / max(row["n_t"], 1), 1e-12))
    effect, critical = abs(pt - pc), n.inv_cdf(0.975) * se0
    power = n.cdf((-critical - effect) / se1) + 1 - n.cdf((critical - effect) / se1)
    p_value = 2 * (1 - n.cdf(abs(row["z_stat"])))
    chi_p = math.erfc(math.sqrt(row["chi_square"] / 2)) if row["chi_square"] is not None else None
    return stats.selectExpr("*", f"{p_value!r}D AS p_value", f"{chi_p!r}D AS chi_square_p_value" if chi_p is not None else "cast(NULL AS double) AS chi_square_p_value",
                            f"{max(0.0, min(power, 1.0))!r}D AS achieved_power", f"{p_value < 0.05} AS is_significant", f"{power < 0.8} AS underpowered")
