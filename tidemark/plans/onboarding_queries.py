"""The upload path on an event log that looks like a customer's own export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import onboarding as ob, onboarding_words as words
from .analysis_queries import _PCT
from .registry import query, rounded

UP_SQL = """up AS (SELECT event_id AS row_id, user_id AS customer_id, ts, CASE event_type WHEN 'click' THEN 'Session Start' WHEN 'error' THEN 'Customer-Support Chat' WHEN 'signup' THEN 'zzz' ELSE event_type END AS action, value AS amount,
  CASE WHEN event_id % 10 < 3 THEN value * 0.12 ELSE 0 END AS discount_amount, CASE WHEN event_id % 4 = 0 THEN 'yes' ELSE 'no' END AS coupon_used, CASE WHEN event_id % 3 = 0 THEN 'ios app' ELSE 'web' END AS channel,
  CASE WHEN user_id % 9 = 0 THEN 'broken' ELSE 'none' END AS refund_reason, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 7 AS VARCHAR) END AS shelf FROM events)"""


def upload(v):
    return v.table("events").selectExpr(
        "event_id AS row_id", "user_id AS customer_id", "ts", "CASE event_type WHEN 'click' THEN 'Session Start' WHEN 'error' THEN 'Customer-Support Chat' WHEN 'signup' THEN 'zzz' ELSE event_type END AS action",
        "value AS amount", "CASE WHEN event_id % 10 < 3 THEN value * 0.12D ELSE 0D END AS discount_amount", "CASE WHEN event_id % 4 = 0 THEN 'yes' ELSE 'no' END AS coupon_used",
        "CASE WHEN event_id % 3 = 0 THEN 'ios app' ELSE 'web' END AS channel", "CASE WHEN user_id % 9 = 0 THEN 'broken' ELSE 'none' END AS refund_reason",
        "CASE WHEN event_id % 2 = 0 THEN cast(event_id % 7 AS string) END AS shelf")


# literal expectations for this upload: exact names 1.0, contained words 0.7, two-valued text 0.3
@query("detect_column_roles", """SELECT column_name, role, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES ('row_id', 'customer_id', 0.7), ('customer_id', 'customer_id', 1.0), ('ts', 'timestamp', 1.0), ('action', 'event_type', 1.0), ('amount', 'amount', 1.0),
  ('discount_amount', 'amount', 0.7), ('coupon_used', 'potential_binary', 0.3), ('channel', 'event_type', 0.7), ('refund_reason', 'unknown', 0.0), ('shelf', 'unknown', 0.0)) t(column_name, role, confidence)""")
def _(v):
    return ob.detect_column_roles(upload(v))


@query("relevance_score", "SELECT CAST(0.8 AS DOUBLE) AS relevance_score, false AS is_unrelated, count(*) >= 10 AS is_valid FROM events")
def _(v):
    u = upload(v)
    return rounded(ob.relevance_score(ob.detect_column_roles(u), u.count()))


_COLS = (("action", "text"), ("channel", "text"), ("coupon_used", "text"), ("refund_reason", "text"), ("shelf", "text"), ("row_id", "numeric"), ("customer_id", "numeric"), ("amount", "numeric"), ("discount_amount", "numeric"), ("ts", "datetime"))


@query("profile_columns", f"WITH {UP_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS kind, count(*) AS rows, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END), 6) AS missing_rate, count(DISTINCT {c}) AS distinct_values, min(CAST({c} AS VARCHAR)) AS sample_value FROM up" for c, k in _COLS))
def _(v):
    return rounded(ob.profile_columns(upload(v).select(*[c for c, _ in _COLS])))


@query("quality_warnings", f"WITH {UP_SQL} SELECT 'customer_id' AS column_name, 'transaction_level' AS warning FROM up HAVING count(DISTINCT customer_id) / CAST(count(*) AS DOUBLE) < 0.5")
def _(v):
    return ob.quality_warnings(ob.profile_columns(upload(v)), "customer_id")


@query("granularity", f"WITH {UP_SQL} SELECT count(*) AS rows, count(DISTINCT customer_id) AS ids, CASE WHEN count(DISTINCT customer_id) / CAST(count(*) AS DOUBLE) < 0.5 THEN 'transaction' ELSE 'customer' END AS granularity FROM up")
def _(v):
    return ob.granularity(upload(v), "customer_id")


_WORDS = ", ".join(f"({i}, '{s}', '{w}')" for i, (s, ws) in enumerate(words.EVENT_WORDS.items()) for w in ws)
_MAP = f"""wd(o, std, w) AS (VALUES {_WORDS}),
nv AS (SELECT DISTINCT raw, regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9가-힣]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS n FROM vals),
mp AS (SELECT raw, coalesce((SELECT std FROM wd WHERE w = n ORDER BY o LIMIT 1), (SELECT std FROM wd WHERE length(w) >= 4 AND contains(n, w) ORDER BY length(w) DESC, o, w LIMIT 1), 'other') AS event_type FROM nv)"""


@query("normalize_event_type", f"WITH vals AS (SELECT p_type AS raw FROM part UNION ALL SELECT event_type || '-' || (event_id % 5) FROM events), {_MAP} SELECT raw, event_type FROM mp")
def _(v):
    vals = v.table("part").selectExpr("p_type AS raw").unionByName(v.table("events").selectExpr("concat(event_type, '-', cast(event_id % 5 AS string)) AS raw"))
    return ob.event_type_map(vals)


@query("event_mapping_report", f"""WITH {UP_SQL}, vals AS (SELECT action AS raw FROM up), {_MAP}, n AS (SELECT raw, count(*) AS rows FROM vals GROUP BY 1)
SELECT raw AS value, event_type, rows, event_type = 'other' AS is_unmapped, (SELECT 1 - sum(rows) FILTER (event_type = 'other') / CAST(sum(rows) AS DOUBLE) FROM n JOIN mp USING (raw)) AS coverage_rate FROM n JOIN mp USING (raw)""")
def _(v):
    return ob.event_mapping_report(upload(v).selectExpr("action AS raw"))


@query("encode_customer_id", "SELECT c_name, dense_rank() OVER (ORDER BY c_name) AS customer_id FROM customer")
def _(v):
    return ob.encode_customer_id(v.table("customer").select("c_name"), "c_name").selectExpr("customer_id_original AS c_name", "customer_id")


_RFM = f"{UP_SQL}, rf AS (SELECT customer_id, CAST(floor(((SELECT max(epoch_us(ts)) FROM up) - max(epoch_us(ts))) / 86400000000) AS BIGINT) AS recency_days, count(*) AS frequency, sum(amount) AS monetary FROM up GROUP BY 1)"


@query("rfm", f"WITH {_RFM} SELECT customer_id, recency_days, frequency, round(monetary, 3) AS monetary FROM rf")
def _(v):
    return rounded(ob.rfm(upload(v)), default=3)


@query("external_features", f"""WITH {UP_SQL} SELECT customer_id, round(avg(discount_amount), 5) AS ext_num__discount_amount_mean, round(sum(discount_amount), 4) AS ext_num__discount_amount_sum, min(discount_amount) AS ext_num__discount_amount_min, round(max(discount_amount), 5) AS ext_num__discount_amount_max,
  arg_min(channel, row_id) AS ext_cat__channel_mode, count(DISTINCT channel) AS ext_num__channel_nunique, arg_min(shelf, row_id) FILTER (shelf IS NOT NULL) AS ext_cat__shelf_mode, count(DISTINCT shelf) AS ext_num__shelf_nunique FROM up GROUP BY 1""")
def _(v):
    u = upload(v).select("row_id", "customer_id", "discount_amount", "channel", "shelf")
    return rounded(ob.external_features(u, ["row_id"], "row_id")[0], {"ext_num__discount_amount_sum": 4}, default=5)


_KN = f"""{UP_SQL}, a AS (SELECT customer_id, sum(amount) AS amt, sum(discount_amount) AS disc, count(*) FILTER (coupon_used = 'yes') AS rd, max(CASE WHEN customer_id % 9 = 0 THEN 'broken' ELSE 'none' END) AS rr,
   CASE WHEN count(*) FILTER (channel = 'ios app') >= count(*) FILTER (channel = 'web') THEN 'ios app' ELSE 'web' END AS ch FROM up GROUP BY 1),
b AS (SELECT *, least(greatest(disc / greatest(amt, 1), 0), 1) AS dep FROM a)"""


@query("coalesce_known_columns", f"""WITH {_KN} SELECT customer_id, round(amt, 3) AS monetary, ch AS acquisition_channel, CASE WHEN ch = 'web' THEN 'web' ELSE 'mobile' END AS device_type, round(disc, 4) AS discount_amount_total, round(dep, 6) AS discount_dependency_score,
  round(least(greatest(0.35 + 0.8 * dep, 0), 1), 6) AS price_sensitivity, round(least(greatest(0.30 + 0.7 * dep, 0), 1), 6) AS coupon_affinity, rd AS coupon_redeem_count, round(0.65 * dep, 6) AS discount_pressure_score,
  round(least(greatest(1 - 0.25 * 0.65 * dep, 0.5), 1), 6) AS discount_effect_penalty, CASE WHEN rr = 'broken' THEN 0.65 ELSE 0.1 END AS support_contact_propensity FROM b""")
def _(v):
    u = upload(v)
    out = ob.coalesce_known_columns(ob.rfm(u), u, amount="amount")
    return rounded(out.select("customer_id", "monetary", "acquisition_channel", "device_type", "discount_amount_total", "discount_dependency_score", "price_sensitivity", "coupon_affinity", "coupon_redeem_count",
                              "discount_pressure_score", "discount_effect_penalty", "support_contact_propensity"), {"monetary": 3, "discount_amount_total": 4})


@query("finance_aliases", "SELECT order_id, order_id AS transaction_id, order_time AS transaction_time, item_category AS financial_product, round(net_amount, 2) AS net_transaction_amount, coupon_used AS retention_benefit_used, customer_id AS financial_customer_id FROM t_orders")
def _(v):
    f = ob.finance_aliases(v.orders(), "orders")
    return rounded(f.select("order_id", "transaction_id", "transaction_time", "financial_product", "net_transaction_amount", "retention_benefit_used", "financial_customer_id"), default=2)


@query("attach_external", "SELECT customer_id, s.persona, 'x' || c.persona AS ext_uploaded__persona, acct AS ext_num__acct FROM t_customers s LEFT JOIN (SELECT customer_id, persona FROM t_customers) c USING (customer_id) LEFT JOIN (SELECT c_custkey AS customer_id, c_acctbal AS acct FROM customer) USING (customer_id)")
def _(v):
    e = v.customers().join(v.table("customer").selectExpr("c_custkey AS customer_id", "c_acctbal AS ext_num__acct"), "customer_id").selectExpr("customer_id", "concat('x', persona) AS persona", "ext_num__acct")
    return ob.attach_external(v.customers().select("customer_id", "persona"), e)


@query("dedupe_summary", "SELECT customer_id, round(avg(order_id / 7.0), 6) AS risk_score, max(net_amount) AS total_amount, arg_max(item_category, order_id) AS item_category FROM t_orders GROUP BY 1")
def _(v):
    d = v.orders().selectExpr("customer_id", "order_id / 7D AS risk_score", "net_amount AS total_amount", "item_category", "order_id")
    return rounded(ob.dedupe_summary(d, "order_id").select("customer_id", "risk_score", "total_amount", "item_category"))


@query("infer_churn_label", f"WITH {_RFM} SELECT customer_id, CAST(CASE WHEN recency_days >= 1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS churn_label FROM rf")
def _(v):
    return ob.infer_churn_label(upload(v), threshold=1)


@query("uploaded_churn_label", "SELECT c_custkey AS customer_id, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1.0 WHEN 'FURNITURE' THEN 0.5 WHEN 'MACHINERY' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS churn_label FROM customer")
def _(v):
    c = v.table("customer").selectExpr("c_custkey AS customer_id", "CASE c_mktsegment WHEN 'BUILDING' THEN 'Churned' WHEN 'FURNITURE' THEN ' dormant' WHEN 'MACHINERY' THEN 'YES' ELSE 'active' END AS state")
    return ob.infer_churn_label(c, flag="state")


@query("estimate_churn_probability")
def _(v):
    return ob.estimate_churn_probability(ob.rfm(upload(v))).select("customer_id", "churn_probability")


@query("assign_persona", f"""SELECT customer_id, CASE WHEN m >= 0.80 AND f >= 0.70 THEN 'vip_loyal' WHEN m >= 0.50 AND f >= 0.50 THEN 'regular_loyal' WHEN churn_probability >= 0.60 THEN 'churn_progressing' WHEN recency_days <= 30 AND frequency <= 2 THEN 'new_signup' WHEN m < 0.30 THEN 'price_sensitive' ELSE 'explorer' END AS persona
FROM (SELECT *, {_PCT('monetary')} AS m, {_PCT('frequency')} AS f FROM t_summary)""")
def _(v):
    return ob.assign_persona(v.summary().drop("persona")).select("customer_id", "persona")


@query("uplift_segment_by_median", """SELECT customer_id, CASE WHEN churn_probability >= 0.45 AND monetary > m THEN 'Persuadables' WHEN monetary > m THEN 'Sure Things' WHEN churn_probability >= 0.45 THEN 'Lost Causes' ELSE 'Sleeping Dogs' END AS uplift_segment
FROM t_summary, (SELECT quantile_cont(monetary, 0.5) AS m FROM t_summary)""")
def _(v):
    return ob.assign_uplift_by_median(v.summary().drop("uplift_segment")).select("customer_id", "uplift_segment")


_EV = f"""{UP_SQL}, vals AS (SELECT action AS raw FROM up), {_MAP}, ev AS (SELECT 'EVT-' || (row_number() OVER (ORDER BY customer_id, ts, row_id) - 1) AS event_id, row_id AS source_row_id, customer_id, ts AS "timestamp", event_type, action AS event_type_original,
   customer_id || '-' || strftime(ts, '%Y%m%d') AS session_id, channel AS item_category FROM up JOIN mp ON raw = action)"""


def upload_events(v):
    return ob.extract_events(upload(v), event_type="action", category="channel")


@query("extract_events", f"WITH {_EV} SELECT event_id, source_row_id, customer_id, \"timestamp\", event_type, event_type_original, session_id, item_category FROM ev")
def _(v):
    return upload_events(v).select("event_id", "source_row_id", "customer_id", "timestamp", "event_type", "event_type_original", "session_id", "item_category")


@query("orders_from_events", f"""WITH {_EV} SELECT 'ORD-' || substr(event_id, 5) AS order_id, ev.customer_id, "timestamp" AS order_time, CAST(round_even(amount, 2) AS DOUBLE) AS gross_amount, round(least(discount_amount, amount), 2) AS discount_amount, CAST(round_even(amount - least(discount_amount, amount), 2) AS DOUBLE) AS net_amount, CASE WHEN source_row_id % 4 = 0 THEN 1 ELSE 0 END AS coupon_used
FROM ev JOIN up ON row_id = source_row_id WHERE event_type = 'purchase'""")
def _(v):
    o = ob.orders_from_events(upload_events(v), upload(v).withColumn("coupon_used", F.expr("CASE coupon_used WHEN 'yes' THEN '1' ELSE '0' END")))
    return o.selectExpr("order_id", "customer_id", "order_time", "gross_amount", "round(discount_amount, 2) AS discount_amount", "net_amount", "coupon_used")


@query("upload_cohort_retention", """WITH act AS (SELECT customer_id, "timestamp" AS t, event_type AS k FROM t_events UNION ALL SELECT customer_id, order_time, 'purchase' FROM t_orders),
co AS (SELECT acquisition_month, count(*) AS cohort_size, min(signup_date) AS st FROM t_customers GROUP BY 1), gr AS (SELECT *, st + to_months(CAST(p AS INTEGER)) AS lo, st + to_months(CAST(p + 1 AS INTEGER)) AS hi FROM co, (SELECT unnest(range(7)) AS p)),
hit AS (SELECT DISTINCT g.acquisition_month, p, a.customer_id, k FROM gr g JOIN t_customers c USING (acquisition_month) JOIN act a ON a.customer_id = c.customer_id AND t >= lo AND t < hi),
n AS (SELECT acquisition_month, p, count(DISTINCT customer_id) AS n_all, count(DISTINCT customer_id) FILTER (k = 'purchase') AS n_buy, count(DISTINCT customer_id) FILTER (k IN ('visit', 'page_view', 'search', 'add_to_cart', 'purchase')) AS n_core FROM hit GROUP BY 1, 2),
l AS (SELECT g.acquisition_month, g.p, cohort_size, d, CASE WHEN g.p = 0 THEN cohort_size ELSE coalesce(CASE d WHEN 'all_activity' THEN n_all WHEN 'purchase_only' THEN n_buy ELSE n_core END, 0) END AS kept FROM gr g LEFT JOIN n ON n.acquisition_month = g.acquisition_month AND n.p = g.p, (VALUES ('all_activity'), ('purchase_only'), ('core_engagement')) x(d))
SELECT acquisition_month AS cohort_month, CAST(p AS INTEGER) AS period, cohort_size, d AS activity_definition, m AS retention_mode, kept AS retained_customers, round(kept / CAST(cohort_size AS DOUBLE), 6) AS retention_rate FROM l, (VALUES ('rolling'), ('point')) y(m)""")
def _(v):
    return rounded(ob.upload_cohort_retention(v.customers(), v.events(), v.orders()))


_GAPS = """g AS (SELECT src, customer_id, (epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY src, customer_id ORDER BY t))) / 86400000000.0 AS gap FROM d),
c AS (SELECT src, customer_id, avg(gap) AS cy FROM g WHERE gap > 0 AND gap <= 365 GROUP BY 1, 2)"""


@query("recommend_churn_days", f"""WITH d AS (SELECT DISTINCT 'purchase' AS src, customer_id, "timestamp" AS t FROM t_events WHERE event_type = 'purchase'), {_GAPS}
SELECT round(quantile_cont(cy, 0.5), 6) AS median_cycle_days, CAST(least(greatest(round_even(quantile_cont(cy, 0.5) * 1.75, 0), 7), 180) AS BIGINT) AS churn_days FROM c""")
def _(v):
    return rounded(ob.recommend_churn_days(v.events().withColumn("ts", F.col("timestamp")), event_type="event_type"))


@query("upload_summary_scores", """WITH b AS (SELECT *, greatest(monetary * (1.30 + 1.25 * least(greatest(1.15 - churn_probability, 0.20), 1.15)) + frequency * greatest(CASE WHEN frequency > 0 THEN monetary / frequency ELSE 0 END, 20000) * 0.55, 15000) AS v FROM t_summary)
SELECT customer_id, round(v, 1) AS clv, round(greatest(v * uplift_score, -50000), 2) AS expected_incremental_profit, round((greatest(v * uplift_score, -50000) - coupon_cost) / coupon_cost, 5) AS expected_roi FROM b""")
def _(v):
    s = ob.summary_scores(v.summary()).select("customer_id", "clv", "expected_incremental_profit", "expected_roi")
    return rounded(s, {"clv": 1, "expected_incremental_profit": 2, "expected_roi": 5})


@query("preprocess_upload")
def _(v):
    u = upload(v).withColumnRenamed("customer_id", "user_ref").withColumnRenamed("ts", "event_date")
    t = ob.preprocess(u, id_column="user_ref", time="event_date", event_type="action", amount="amount", row_id="row_id", category="channel")
    n = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("table_name"), "rows") for k, df in t.items()]
    out = n[0]
    for x in n[1:]:
        out = out.unionByName(x)
    return out
