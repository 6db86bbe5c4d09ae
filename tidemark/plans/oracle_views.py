"""DuckDB text of the shared views, in dependency order."""

from . import decision_sql as ds

VIEWS: dict[str, str] = {
    "t_orders": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_time, o_orderpriority AS item_category,
       coalesce(q, 1.0) AS quantity, o_totalprice AS net_amount,
       CASE WHEN o_orderkey % 10 < 3 THEN 1 ELSE 0 END * CAST(0.1 AS DOUBLE) * o_totalprice AS discount_amount,
       CASE WHEN o_orderkey % 10 < 3 THEN 1 ELSE 0 END AS coupon_used
FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""",
    "t_customers": """
SELECT c_custkey AS customer_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'vip_loyal' WHEN 'AUTOMOBILE' THEN 'regular_loyal'
            WHEN 'MACHINERY' THEN 'price_sensitive' WHEN 'HOUSEHOLD' THEN 'explorer'
            WHEN 'FURNITURE' THEN 'churn_progressing' ELSE 'unknown' END AS persona,
       coalesce(f, TIMESTAMP '1995-01-01') AS signup_date,
       strftime(coalesce(f, TIMESTAMP '1995-01-01'), '%Y-%m') AS acquisition_month,
       r_name AS region, (c_custkey % 100) / CAST(100 AS DOUBLE) AS price_sensitivity,
       (c_custkey % 37) / CAST(37 AS DOUBLE) AS coupon_affinity
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
""",
    "t_events": """
SELECT customer_id, "timestamp", event_type, item_category,
       customer_id || '-' || strftime("timestamp", '%Y%m%d') AS session_id
FROM (SELECT o_custkey AS customer_id, o_orderdate AS "timestamp", 'purchase' AS event_type, o_orderpriority AS item_category FROM orders
      UNION ALL
      SELECT o_custkey, l_shipdate, CASE l_returnflag WHEN 'N' THEN 'visit' WHEN 'R' THEN 'support_contact' WHEN 'A' THEN 'page_view' END, o_orderpriority
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag IN ('N', 'R', 'A'))
""",
    "t_assign": """
SELECT c_custkey AS customer_id, CAST(c_custkey % 2 AS INTEGER) AS treatment_flag,
       CASE WHEN c_custkey % 2 = 1 THEN 'treatment' ELSE 'control' END AS treatment_group,
       TIMESTAMP '2001-01-01' AS assigned_at, CAST(3000 + (c_custkey % 13) * 1000 AS DOUBLE) AS coupon_cost
FROM customer
""",
    "t_exposures": """
SELECT customer_id, assigned_at + to_days(CAST(7 * n AS INTEGER)) AS exposure_time, coupon_cost
FROM t_assign, (SELECT unnest([0, 1, 2]) AS n) WHERE treatment_flag = 1 AND n <= customer_id % 3
""",
    "t_scores": """
SELECT customer_id, churn_probability, uplift_score, clv,
       least(greatest(4 + CAST(0.015 AS DOUBLE) * clv + 2.0 * churn_probability, 3.0), 75.0) AS score_cost
FROM (SELECT customer_id, churn_probability,
             least(greatest(CAST(0.02 AS DOUBLE) + CAST(0.22 AS DOUBLE) * churn_probability + CAST(0.015 AS DOUBLE) * ln(1 + f), 0.01), 0.35) AS uplift_score,
             greatest(25 + CAST(1.8 AS DOUBLE) * m + 8 * f, 20.0) AS clv
      FROM (SELECT customer_id, f, m, 1 / (1 + exp(-(-CAST(0.035 AS DOUBLE) * f - CAST(0.0007 AS DOUBLE) * m + CAST(0.8 AS DOUBLE)))) AS churn_probability
            FROM (SELECT o_custkey AS customer_id, CAST(count(*) AS DOUBLE) AS f, sum(o_totalprice / 1000) AS m FROM orders GROUP BY 1)))
""",
    "t_summary": """
SELECT *, CASE WHEN uplift_score >= 0.12 THEN 'Persuadables' WHEN uplift_score >= 0.02 THEN 'Sure Things'
               WHEN uplift_score >= -0.03 THEN 'Lost Causes' ELSE 'Sleeping Dogs' END AS uplift_segment
FROM (SELECT customer_id, persona, region, signup_date, acquisition_month, treatment_group, treatment_flag, price_sensitivity, coupon_affinity,
             coalesce(frequency, 0) AS frequency, coalesce(monetary, 0.0) AS monetary,
             coalesce(date_diff('day', last_order, TIMESTAMP '2001-08-01'), 999) AS recency_days,
             churn_probability,
             uplift_raw - CASE WHEN customer_id % 5 = 0 THEN CAST(0.04 AS DOUBLE) * 3 ELSE 0 END AS uplift_score,
             clv, coupon_cost,
             clv * uplift_raw * (CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE) * coupon_affinity) AS expected_incremental_profit,
             (clv * uplift_raw * (CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE) * coupon_affinity) - coupon_cost) / coupon_cost AS expected_roi,
             (customer_id % 11) / CAST(5 AS DOUBLE) AS discount_pressure_score, (customer_id % 7) / CAST(7 AS DOUBLE) AS brand_sensitivity
      FROM (SELECT c.*, a.treatment_group, a.treatment_flag, a.coupon_cost, o.frequency, o.monetary, o.last_order,
                   coalesce(s.churn_probability, 0.5) AS churn_probability, coalesce(s.uplift_score, 0.02) AS uplift_raw,
                   coalesce(s.clv * 100, 2000.0) AS clv
            FROM t_customers c LEFT JOIN t_assign a USING (customer_id) LEFT JOIN t_scores s USING (customer_id)
            LEFT JOIN (SELECT o_custkey AS customer_id, max(o_orderdate) AS last_order, count(*) AS frequency, sum(o_totalprice) AS monetary
                       FROM orders GROUP BY 1) o USING (customer_id)))
""",
    "t_survival": """
SELECT customer_id, hr AS predicted_hazard_ratio, exp(-0.25 * hr) AS survival_prob_30d, exp(-0.5 * hr) AS survival_prob_60d,
       exp(-0.75 * hr) AS survival_prob_90d,
       least(greatest(90 * CAST(0.6931471805599453 AS DOUBLE) / (0.75 * hr), 1.0), 90.0) AS predicted_median_time_to_churn_days
FROM (SELECT customer_id, exp(CAST(1.2 AS DOUBLE) * (churn_probability - CAST(0.3 AS DOUBLE)) + CAST(0.002 AS DOUBLE) * least(recency_days, 400)) AS hr FROM t_summary)
""",
    "t_pool_base": ds.T_POOL_BASE,
    "t_pool": ds.T_POOL,
    "t_segments": ds.T_SEGMENTS,
    "t_strategy": ds.T_STRATEGY,
    "t_policy": ds.T_POLICY,
    "t_activity": """
SELECT customer_id, "timestamp" AS t, event_type AS kind FROM t_events WHERE event_type IN ('visit', 'purchase')
UNION ALL SELECT customer_id, order_time, 'purchase' FROM t_orders
""",
    "t_snapshots": """
WITH sp AS (SELECT customer_id, min(t) AS a, max(t) AS b FROM t_activity GROUP BY 1), ge AS (SELECT date_trunc('day', max(t)) AS ge FROM t_activity),
ba AS (SELECT s.customer_id, coalesce(signup_date, a, ge) AS su, a, b, ge, CASE WHEN frequency > 0 THEN monetary / frequency ELSE 0 END AS amt
       FROM t_summary s LEFT JOIN sp USING (customer_id), ge),
bo AS (SELECT *, date_trunc('day', CASE WHEN a < su THEN a ELSE su END) AS lo, date_trunc('day', CASE WHEN b > ge THEN b ELSE ge END) AS hi FROM ba),
gr AS (SELECT DISTINCT customer_id, su, amt, unnest(list_append(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY), CAST(hi AS TIMESTAMP))) AS d FROM bo),
an AS (SELECT DISTINCT customer_id, t AS ta FROM t_activity), bu AS (SELECT DISTINCT customer_id, t AS tb FROM t_activity WHERE kind = 'purchase'),
dy AS (SELECT customer_id, day, sum(v) OVER w AS v, sum(p) OVER w AS p FROM (
        SELECT customer_id, date_trunc('day', t) AS day, count(*) FILTER (kind = 'visit') AS v, count(*) FILTER (kind = 'purchase') AS p FROM t_activity GROUP BY 1, 2)
       WINDOW w AS (PARTITION BY customer_id ORDER BY day)),
j AS (SELECT gr.*, ta, tb, coalesce(v, 0) AS v, coalesce(p, 0) AS p FROM gr
      ASOF LEFT JOIN an ON an.customer_id = gr.customer_id AND an.ta <= gr.d
      ASOF LEFT JOIN bu ON bu.customer_id = gr.customer_id AND bu.tb <= gr.d
      ASOF LEFT JOIN dy ON dy.customer_id = gr.customer_id AND dy.day <= gr.d)
SELECT customer_id, d AS snapshot_date, coalesce(ta, su) AS last_visit_date, coalesce(tb, ta, su) AS last_purchase_date,
  CAST(v AS BIGINT) AS visits_total, CAST(p AS BIGINT) AS purchases_total, p * amt AS monetary_total,
  greatest(CAST(floor((epoch_us(d) - epoch_us(coalesce(ta, su))) / 86400000000) AS BIGINT), 0) AS inactivity_days,
  CASE WHEN (epoch_us(d) - epoch_us(coalesce(ta, su))) >= 30 * 86400000000 THEN 'churn_risk'
       WHEN (epoch_us(d) - epoch_us(coalesce(ta, su))) >= 15 * 86400000000 THEN 'dormant' ELSE 'active' END AS current_status,
  CAST(least(v - coalesce(lag(v) OVER q, 0), 2) AS DOUBLE) AS recent_visit_score, CAST(least(p - coalesce(lag(p) OVER q, 0), 2) AS DOUBLE) AS recent_purchase_score,
  CAST(0 AS DOUBLE) AS recent_exposure_score
FROM j WINDOW q AS (PARTITION BY customer_id ORDER BY d)
""",
    "t_churners": """
WITH e AS (SELECT customer_id, max(snapshot_date) AS z, max(snapshot_date) FILTER (current_status <> 'churn_risk') AS o FROM t_snapshots GROUP BY 1)
SELECT s.customer_id, min(snapshot_date) AS final_churn_start_date, max(z) AS final_snapshot_date
FROM t_snapshots s JOIN e USING (customer_id) WHERE (o IS NULL OR o < z) AND (o IS NULL OR snapshot_date > o) GROUP BY 1
""",
    "t_anchors": """
SELECT customer_id, final_churn_start_date, final_snapshot_date, coalesce(m, a, final_churn_start_date) AS behavior_anchor_time,
  CASE WHEN m IS NOT NULL THEN 'last_meaningful_event' WHEN a IS NOT NULL THEN 'last_any_event' ELSE 'final_churn_start_date' END AS anchor_source
FROM t_churners LEFT JOIN (SELECT customer_id, max("timestamp") FILTER (event_type IN ('visit', 'page_view', 'search', 'add_to_cart', 'remove_from_cart', 'purchase', 'support_contact')) AS m,
  max("timestamp") AS a FROM t_events GROUP BY 1) USING (customer_id)
""",
    "t_cohorts": """
WITH d(activity_definition, event_type) AS (VALUES
   ('all_activity','visit'),('all_activity','page_view'),('all_activity','search'),('all_activity','add_to_cart'),('all_activity','remove_from_cart'),
   ('all_activity','purchase'),('all_activity','support_contact'),('all_activity','coupon_open'),('all_activity','coupon_redeem'),
   ('core_engagement','visit'),('core_engagement','page_view'),('core_engagement','search'),('core_engagement','add_to_cart'),('core_engagement','purchase'),
   ('purchase_only','purchase'),('purchase_or_redeem','purchase'),('purchase_or_redeem','coupon_redeem')),
c AS (SELECT customer_id, acquisition_month AS cohort_month, CAST(substr(acquisition_month, 1, 4) AS INT) * 12 + CAST(substr(acquisition_month, 6, 2) AS INT) AS cm FROM t_customers),
a AS (SELECT DISTINCT activity_definition, customer_id, year("timestamp") * 12 + month("timestamp") AS em FROM t_events JOIN d USING (event_type)),
e AS (SELECT activity_definition, max(em) AS em_end FROM a GROUP BY 1),
h AS (SELECT activity_definition, cohort_month, customer_id, em - cm AS period FROM a JOIN c USING (customer_id) WHERE em - cm BETWEEN 0 AND 12),
z AS (SELECT cohort_month, cm, count(*) AS cohort_size FROM c GROUP BY 1, 2),
g AS (SELECT cohort_month, cohort_size, activity_definition, retention_mode, period, period <= greatest(em_end - cm, 0) AS observed
      FROM z, e, (VALUES ('point'), ('rolling')) m(retention_mode), (SELECT unnest(range(13)) AS period)),
l AS (SELECT activity_definition, cohort_month, customer_id, max(period) AS mp FROM h GROUP BY 1, 2, 3),
k AS (SELECT activity_definition, 'point' AS retention_mode, cohort_month, period, count(DISTINCT customer_id) AS n FROM h GROUP BY ALL
      UNION ALL SELECT activity_definition, 'rolling', cohort_month, p, count(*) FROM l, (SELECT unnest(range(13)) AS p) WHERE mp >= p GROUP BY ALL)
SELECT cohort_month, CAST(period AS INTEGER) AS period, cohort_size, CASE WHEN observed THEN CASE WHEN period = 0 THEN cohort_size ELSE coalesce(n, 0) END END AS retained_customers,
  CASE WHEN observed THEN CASE WHEN period = 0 THEN 1.0 ELSE coalesce(n, 0) / CAST(cohort_size AS DOUBLE) END END AS retention_rate,
  observed, activity_definition, retention_mode, 1 AS min_events_per_period
FROM g LEFT JOIN k USING (activity_definition, retention_mode, cohort_month, period)
""",
    "e_events": """
SELECT event_id, user_id AS customer_id, ts AS "timestamp",
       CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'visit' WHEN 'signup' THEN 'search'
            WHEN 'error' THEN 'support_contact' WHEN 'purchase' THEN 'purchase' ELSE 'other' END AS event_type,
       value AS amount, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, 'cat_' || (event_id % 7) AS item_category, props
FROM events
""",
    "e_orders": """
SELECT event_id AS order_id, customer_id, "timestamp" AS order_time, item_category, 1.0 AS quantity, amount AS net_amount,
       0.0 AS discount_amount, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS coupon_used
FROM e_events WHERE event_type = 'purchase'
""",
}
