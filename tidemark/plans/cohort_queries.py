"""Cohorts, journeys, snapshots and the customer summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts as co, features as fe, journey as jo, snapshots as sn, summary as su
from .registry import query, rounded

_COLS = ("cohort_month, period, cohort_size, retained_customers, round(retention_rate, 6) AS retention_rate, observed, activity_definition, "
         "retention_mode, min_events_per_period")
_CORE = "activity_definition = 'core_engagement' AND retention_mode = 'rolling'"


def all_cohorts(v, **kw):
    return co.cohort_retention_all(v.customers(), v.events(), periods=13, **kw)


@query("cohort_retention_point", f"SELECT {_COLS} FROM t_cohorts WHERE activity_definition = 'core_engagement' AND retention_mode = 'point'")
def _(v):
    return rounded(co.cohort_retention(v.customers(), v.events(), periods=13, mode="point"))


@query("cohort_retention_rolling", f"SELECT {_COLS} FROM t_cohorts WHERE {_CORE}")
def _(v):
    return rounded(co.cohort_retention(v.customers(), v.events(), periods=13))


@query("cohort_retention_all", f"SELECT {_COLS} FROM t_cohorts")
def _(v):
    return rounded(all_cohorts(v))


@query("retention_milestones", f"""SELECT cohort_month, period, cohort_size, round(retention_rate, 6) AS retention_rate, round(1 - retention_rate, 6) AS churn_rate, observed
FROM t_cohorts WHERE {_CORE} AND period IN (1, 3, 6, 12)""")
def _(v):
    return rounded(co.milestones(co.cohort_retention(v.customers(), v.events(), periods=13)))


@query("retention_average_curve", f"SELECT period, round(avg(retention_rate), 6) AS avg_retention, round(avg(1 - retention_rate), 6) AS avg_churn FROM t_cohorts WHERE {_CORE} AND observed GROUP BY 1")
def _(v):
    return rounded(co.average_curve(co.cohort_retention(v.customers(), v.events(), periods=13)))


@query("churn_heatmap", "SELECT cohort_month, " + ", ".join(f"round(max(1 - retention_rate) FILTER (period = {p}), 6) AS m{p}" for p in co.MILESTONES) + f" FROM t_cohorts WHERE {_CORE} GROUP BY 1")
def _(v):
    return rounded(co.churn_heatmap(co.milestones(co.cohort_retention(v.customers(), v.events(), periods=13))))


@query("cohort_curve", f"SELECT {_COLS} FROM t_cohorts WHERE {_CORE} AND observed AND cohort_size >= 5")
def _(v):
    return rounded(co.cohort_curve(all_cohorts(v), min_size=5))


@query("cohort_pivot", "SELECT cohort_month, " + ", ".join(f"round(max(retention_rate) FILTER (period = {p}), 6) AS p{p}" for p in range(7)) +
       " FROM t_cohorts WHERE activity_definition = 'purchase_only' AND retention_mode = 'point' AND observed GROUP BY 1")
def _(v):
    return rounded(co.cohort_pivot(co.cohort_curve(all_cohorts(v), definition="purchase_only", mode="point")))


@query("cohort_summary", """
WITH f AS (SELECT *, retention_rate - lag(retention_rate) OVER (PARTITION BY cohort_month ORDER BY period) AS dx FROM t_cohorts
           WHERE activity_definition = 'core_engagement' AND retention_mode = 'point' AND observed),
p AS (SELECT cohort_month, max(cohort_size) AS size, max(period) AS lp, arg_max(retention_rate, period) AS lr, max(retention_rate) FILTER (period = 1) AS m1,
        count(*) >= 3 AND coalesce(bool_or(dx > 1e-12), false) AS rises FROM f GROUP BY 1),
k AS (SELECT coalesce(min(lp) FILTER (lp >= 1), 0) AS cp FROM p), s AS (SELECT f.* FROM f, k WHERE period = cp)
SELECT (SELECT count(*) FROM p) AS cohort_count, (SELECT round(avg(size), 6) FROM p) AS avg_cohort_size, (SELECT round(avg(m1), 6) FROM p) AS month1_avg_retention,
  (SELECT round(avg(lr), 6) FROM p) AS last_observed_avg_retention, (SELECT cohort_month FROM p ORDER BY lr DESC, cohort_month DESC LIMIT 1) AS best_last_cohort,
  (SELECT cohort_month FROM p ORDER BY lr, cohort_month LIMIT 1) AS worst_last_cohort, (SELECT count(*) FROM p WHERE rises) AS non_monotonic_cohort_count,
  (SELECT cp FROM k) AS comparable_period, (SELECT round(avg(retention_rate), 6) FROM s) AS comparable_avg_retention,
  (SELECT cohort_month FROM s ORDER BY retention_rate DESC, cohort_month DESC LIMIT 1) AS best_comparable_cohort,
  (SELECT cohort_month FROM s ORDER BY retention_rate, cohort_month LIMIT 1) AS worst_comparable_cohort, (SELECT count(DISTINCT period) FROM f) AS observed_periods""")
def _(v):
    return rounded(co.cohort_summary(co.cohort_curve(all_cohorts(v), definition="core_engagement", mode="point")))


_SN = ("customer_id, snapshot_date, last_visit_date, last_purchase_date, visits_total, purchases_total, round(monetary_total, 6) AS monetary_total, inactivity_days, "
       "current_status, recent_visit_score, recent_purchase_score, recent_exposure_score")


@query("activity_snapshots", f"SELECT {_SN} FROM t_snapshots")
def _(v):
    return rounded(v.snapshots())


@query("monthly_snapshots", """
SELECT customer_id, signup_date + to_days(CAST(30 * m AS INTEGER)) AS snapshot_date, signup_date + to_days(CAST(30 * m AS INTEGER)) - to_days(CAST(recency_days AS INTEGER)) AS last_visit_date,
  signup_date + to_days(CAST(30 * m AS INTEGER)) - to_days(CAST(recency_days AS INTEGER)) AS last_purchase_date, frequency * 3 AS visits_total, frequency AS purchases_total,
  round(monetary, 2) AS monetary_total, recency_days AS inactivity_days,
  CASE WHEN recency_days >= 60 OR churn_probability >= 0.7 THEN 'churn_risk' WHEN recency_days >= 30 OR churn_probability >= 0.5 THEN 'dormant' ELSE 'active' END AS current_status
FROM t_summary, (SELECT unnest(range(12)) AS m)""")
def _(v):
    return rounded(sn.monthly_snapshots(v.summary().withColumn("inactivity_days", F.col("recency_days")), threshold=60), default=2)


@query("journey_stage", """
WITH h AS (SELECT * FROM t_snapshots WHERE snapshot_date <= TIMESTAMP '2001-06-17'),
l AS (SELECT customer_id, arg_max(current_status, snapshot_date) AS st, max(snapshot_date) AS z, arg_max(inactivity_days, snapshot_date) AS inact,
  arg_max(recent_visit_score, snapshot_date) AS rv, arg_max(recent_purchase_score, snapshot_date) AS rp, arg_max(recent_exposure_score, snapshot_date) AS re FROM h GROUP BY 1),
o AS (SELECT h.customer_id, max(snapshot_date) AS o FROM h JOIN l USING (customer_id) WHERE current_status <> st GROUP BY 1)
SELECT l.customer_id, st AS current_journey_stage, date_diff('day', (SELECT min(snapshot_date) FROM h WHERE h.customer_id = l.customer_id AND (o.o IS NULL OR snapshot_date > o.o)), z) + 1 AS journey_stage_days,
  inact AS inactivity_days, rv AS recent_visit_score, rp AS recent_purchase_score, re AS recent_exposure_score FROM l LEFT JOIN o USING (customer_id)""")
def _(v):
    return fe.journey_stage(v.snapshots(), "2001-06-17 00:00:00")


@query("final_churn_run", "SELECT * FROM t_churners")
def _(v):
    return v.churners()


@query("behavior_anchor", "SELECT * FROM t_anchors")
def _(v):
    return jo.behavior_anchor(v.events(), v.churners())


_WIN = """w AS (SELECT e.customer_id, "timestamp", event_type FROM t_events e JOIN t_anchors a USING (customer_id)
      WHERE "timestamp" <= behavior_anchor_time AND "timestamp" >= behavior_anchor_time - INTERVAL 30 DAY)"""


@query("pre_churn_patterns", f"""
WITH {_WIN}, k AS (SELECT *, lag(event_type) OVER (PARTITION BY customer_id ORDER BY "timestamp", event_type) AS pv FROM w),
r AS (SELECT customer_id, event_type, row_number() OVER (PARTITION BY customer_id ORDER BY "timestamp" DESC, event_type DESC) AS rn FROM k WHERE pv IS NULL OR pv <> event_type),
s AS (SELECT customer_id, string_agg(event_type, ' > ' ORDER BY rn DESC) AS pattern FROM r WHERE rn <= 5 GROUP BY 1),
g AS (SELECT coalesce(pattern, 'no_history') AS pattern, count(*) AS customer_count FROM t_anchors LEFT JOIN s USING (customer_id) GROUP BY 1)
SELECT row_number() OVER (ORDER BY customer_count DESC, pattern) AS rank, pattern, customer_count, customer_count / CAST((SELECT count(*) FROM t_anchors) AS DOUBLE) AS share_of_churn_customers
FROM g ORDER BY customer_count DESC, pattern LIMIT 5""")
def _(v):
    e = v.events()
    return jo.pre_churn_patterns(e, jo.behavior_anchor(e, v.churners()))


@query("pre_churn_event_frequency", f"""
WITH {_WIN}, t(event_type) AS (VALUES {", ".join(f"('{x}')" for x in jo.MAJOR_TYPES)})
SELECT t.event_type, count(w.customer_id) AS event_count, count(DISTINCT w.customer_id) AS customer_count,
  count(DISTINCT w.customer_id) / CAST((SELECT count(*) FROM t_anchors) AS DOUBLE) AS customer_share FROM t LEFT JOIN w USING (event_type) GROUP BY 1""")
def _(v):
    e = v.events()
    return jo.pre_churn_event_frequency(e, jo.behavior_anchor(e, v.churners()))


@query("journey_funnel", """
WITH n AS (SELECT c.customer_id, coalesce(k, 0) AS k, x.customer_id IS NOT NULL AS ch FROM t_customers c LEFT JOIN (SELECT customer_id, count(*) AS k FROM t_orders GROUP BY 1) USING (customer_id)
  LEFT JOIN t_churners x ON x.customer_id = c.customer_id),
a AS (SELECT count(*) AS n0, count(*) FILTER (k >= 1) AS n1, count(*) FILTER (k >= 2) AS n2, count(*) FILTER (k >= 3) AS n3, count(*) FILTER (ch) AS n4 FROM n)
SELECT '가입' AS stage, n0 AS customer_count, 1.0 AS stage_rate_from_signup, 1.0 AS transition_rate_from_prev FROM a
UNION ALL SELECT '첫구매', n1, n1 / CAST(n0 AS DOUBLE), n1 / CAST(n0 AS DOUBLE) FROM a UNION ALL SELECT '재구매', n2, n2 / CAST(n0 AS DOUBLE), n2 / CAST(n1 AS DOUBLE) FROM a
UNION ALL SELECT '충성', n3, n3 / CAST(n0 AS DOUBLE), n3 / CAST(n2 AS DOUBLE) FROM a UNION ALL SELECT '이탈', n4, n4 / CAST(n0 AS DOUBLE), n4 / CAST(n3 AS DOUBLE) FROM a""")
def _(v):
    return jo.journey_funnel(v.customers(), v.orders(), v.churners())


@query("churn_timing_by_stage", """
WITH b AS (SELECT customer_id, count(*) AS n FROM t_orders JOIN t_churners USING (customer_id) WHERE order_time <= final_churn_start_date GROUP BY 1),
t AS (SELECT c.customer_id, CASE WHEN n >= 3 THEN '충성' WHEN n = 2 THEN '재구매' WHEN n = 1 THEN '첫구매' ELSE '가입' END AS churn_stage,
   greatest(date_diff('day', signup_date, final_churn_start_date), 0) AS d FROM t_churners c LEFT JOIN t_customers USING (customer_id) LEFT JOIN b USING (customer_id))
SELECT churn_stage, count(*) AS churned_customers, round(avg(d), 6) AS avg_days_to_churn, round(quantile_cont(d, 0.5), 6) AS median_days_to_churn,
  round(count(*) / CAST((SELECT count(*) FROM t) AS DOUBLE), 6) AS share_of_churn_customers FROM t GROUP BY 1""")
def _(v):
    return rounded(jo.churn_timing_by_stage(v.customers(), v.orders(), v.churners()))


_STATE = "date_diff('day', last_order, TIMESTAMP '2001-08-01')"


@query("customer_summary", """
WITH st AS (SELECT o_custkey AS customer_id, date_diff('day', max(o_orderdate), TIMESTAMP '2001-08-01') AS inact, count(*) AS f, sum(o_totalprice) AS m FROM orders GROUP BY 1),
ev AS (SELECT customer_id, count(*) FILTER (event_type = 'visit' AND CAST("timestamp" AS DATE) BETWEEN DATE '2001-07-26' AND DATE '2001-08-01') AS v7,
        count(*) FILTER (event_type = 'visit' AND CAST("timestamp" AS DATE) BETWEEN DATE '2001-07-19' AND DATE '2001-07-25') AS p7 FROM t_events GROUP BY 1),
od AS (SELECT customer_id, count(*) FILTER (CAST(order_time AS DATE) BETWEEN DATE '2001-07-03' AND DATE '2001-08-01') AS b30,
        count(*) FILTER (CAST(order_time AS DATE) BETWEEN DATE '2001-06-03' AND DATE '2001-07-02') AS p30 FROM t_orders GROUP BY 1),
ex AS (SELECT customer_id, count(*) AS x FROM t_exposures GROUP BY 1),
b AS (SELECT c.customer_id, persona, price_sensitivity, coupon_affinity, signup_date, coupon_cost, inact, coalesce(f, 0) AS f, coalesce(m, 0) AS m, coalesce(v7, 0) AS v7, coalesce(p7, 0) AS p7,
       coalesce(b30, 0) AS b30, coalesce(p30, 0) AS p30, coalesce(x, 0) AS x FROM t_customers c LEFT JOIN t_assign USING (customer_id) LEFT JOIN st USING (customer_id)
       LEFT JOIN ev USING (customer_id) LEFT JOIN od USING (customer_id) LEFT JOIN ex USING (customer_id) WHERE f IS NOT NULL),
u AS (SELECT *, (v7 - p7) / greatest(CAST(p7 AS DOUBLE), 1) AS vcr, (b30 - p30) / greatest(CAST(p30 AS DOUBLE), 1) AS pcr,
       least(greatest(0.55 * (0.05 * coupon_affinity - 0.04 * price_sensitivity) + 0.20 * 1 / CAST(x + 4 AS DOUBLE) + CASE WHEN x > 0 THEN 0.08 ELSE 0 END, -0.15), 0.42) AS up FROM b),
q AS (SELECT quantile_cont(m, 0.95) AS m95, quantile_cont(f, 0.95) AS f95, least(greatest(avg(CASE WHEN inact >= 30 THEN 1.0 ELSE 0 END), 0.15), 0.25) AS sh FROM u),
r AS (SELECT *, least(greatest(0.34 * least(greatest(inact / CAST(45 AS DOUBLE), 0), 1) + 0.20 * (1 - least(f / greatest(f95, 1), 1)) + 0.16 * (1 - least(m / greatest(m95, 1), 1))
   + CASE WHEN vcr < 0 THEN 0.13 ELSE 0 END + CASE WHEN pcr < 0 THEN 0.13 ELSE 0 END + 0.04 * least(greatest(inact / CAST(30 AS DOUBLE), 0), 1)
   + CASE persona WHEN 'vip_loyal' THEN -0.12 WHEN 'regular_loyal' THEN -0.06 WHEN 'price_sensitive' THEN 0.04 WHEN 'explorer' THEN 0.06 WHEN 'churn_progressing' THEN 0.18 ELSE 0 END, 0.01), 0.99) AS raw FROM u, q),
k AS (SELECT *, (rank() OVER (ORDER BY round(raw, 9)) + (count(*) OVER (PARTITION BY round(raw, 9)) - 1) / 2.0) / count(*) OVER () AS pct FROM r),
c AS (SELECT *, least(greatest(1 / (1 + exp(-(pct - (1 - sh)) / 0.10)), 0.01), 0.99) AS cp FROM k),
v AS (SELECT *, greatest(m * (1.30 + 1.25 * least(greatest(1.15 - cp, 0.20), 1.15)) + f * greatest(m / greatest(CAST(f AS DOUBLE), 1), 20000) * 0.55, 15000) AS cl FROM c)
SELECT customer_id, v7 AS visits_last_7, p7 AS visits_prev_7, b30 AS purchase_last_30, p30 AS purchase_prev_30, round(vcr, 6) AS visit_change_rate, round(pcr, 6) AS purchase_change_rate,
  round(up, 6) AS uplift_score, round(cp, 5) AS churn_probability, round(cl, 0) AS clv, round((greatest(cl * up, -50000) - coupon_cost) / coupon_cost, 4) AS expected_roi,
  CASE WHEN up >= 0.12 THEN 'Persuadables' WHEN up >= 0.02 THEN 'Sure Things' WHEN up >= -0.03 THEN 'Lost Causes' ELSE 'Sleeping Dogs' END AS uplift_segment FROM v""")
def _(v):
    state = v.orders().groupBy("customer_id").agg(
        F.expr("datediff(timestamp_ntz'2001-08-01 00:00:00', max(order_time)) AS inactivity_days"), F.count(F.lit(1)).alias("frequency"),
        F.expr("sum(net_amount) AS monetary")).withColumn("recency_days", F.col("inactivity_days"))
    cu = v.customers().join(state.select("customer_id"), "customer_id", "left_semi")
    s = su.build_customer_summary(cu, v.assignments(), v.events(), v.orders(), v.exposures(), state, end_date="2001-08-01 00:00:00")
    return rounded(s.select("customer_id", "visits_last_7", "visits_prev_7", "purchase_last_30", "purchase_prev_30", "visit_change_rate", "purchase_change_rate",
                            "uplift_score", "churn_probability", "clv", "expected_roi", "uplift_segment"), {"churn_probability": 5, "clv": 0, "expected_roi": 4})


@query("calibrate_by_rank", """
WITH s AS (SELECT least(greatest(avg(CASE WHEN recency_days >= 90 THEN 1.0 ELSE 0 END), 0.15), 0.25) AS sh FROM t_summary),
k AS (SELECT customer_id, sh, (rank() OVER (ORDER BY discount_pressure_score) + (count(*) OVER (PARTITION BY discount_pressure_score) - 1) / 2.0) / count(*) OVER () AS pct FROM t_summary, s)
SELECT customer_id, round(least(greatest(1 / (1 + exp(-(pct - (1 - sh)) / 0.10)), 0.01), 0.99), 6) AS calibrated FROM k""")
def _(v):
    s = v.summary().select("customer_id", "discount_pressure_score", "recency_days")
    return rounded(su.calibrate_by_rank(s, "discount_pressure_score", "recency_days", 90, out="calibrated").select("customer_id", "calibrated"))
