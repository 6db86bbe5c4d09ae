"""Feature operators over the two domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import change_rate, micros, ratio_null, ratio_zero, repair_timestamp, slug, ts
from ..operators import features as fe, scoring
from ..sources import tables as tb
from ..sources.views import E_AS_OF, T_AS_OF
from .registry import query, rounded

TA, EA = f"TIMESTAMP '{T_AS_OF}'", f"TIMESTAMP '{E_AS_OF}'"


def _w(col, at, days, back=0):
    return f"({col} > {at} - INTERVAL {days + back} DAY AND {col} <= {at} - INTERVAL {back} DAY)"


@query("data_span_days", """
SELECT CAST(floor((max(epoch_us(t)) - min(epoch_us(t))) / 86400000000) AS BIGINT) AS span_days
FROM (SELECT "timestamp" AS t FROM t_events UNION ALL SELECT order_time FROM t_orders)""")
def _(v):
    return tb.data_span_days(v.events(), v.orders())


@query("latest_activity_date", """
SELECT CAST(greatest((SELECT max("timestamp") FROM t_events), (SELECT max(order_time) FROM t_orders)) AS DATE) AS latest_date""")
def _(v):
    return tb.latest_activity_date(v.events(), v.orders())


@query("resolve_horizon", """
SELECT CAST(span_days AS BIGINT) AS span_days,
       CAST(CASE WHEN span_days < 60 THEN least(45, greatest(15, span_days // 3)) WHEN span_days < 90 THEN 30
                 WHEN span_days < 180 THEN greatest(30, span_days // 2) ELSE 45 END AS BIGINT) AS horizon_days
FROM (SELECT CAST(floor((max(epoch_us(t)) - min(epoch_us(t))) / 86400000000) AS BIGINT) AS span_days
      FROM (SELECT "timestamp" AS t FROM e_events UNION ALL SELECT order_time FROM e_orders))""")
def _(v):
    return tb.data_span_days(v.live_events(), v.live_orders()).select(
        "span_days", tb.resolve_horizon(F.col("span_days"), 45).alias("horizon_days"))


@query("window_count", f"""
SELECT customer_id, count(*) FILTER (event_type = 'visit' AND {_w('"timestamp"', TA, 14)}) AS visits_14d,
       count(*) FILTER (event_type = 'visit' AND {_w('"timestamp"', TA, 14, 14)}) AS visits_prev_14d,
       count(*) FILTER ({_w('"timestamp"', TA, 90)}) AS events_90d
FROM t_events GROUP BY 1""")
def _(v):
    return fe.window_counts(v.events(), "timestamp", T_AS_OF, {
        "visits_14d": (14, 0, ["visit"]), "visits_prev_14d": (14, 14, ["visit"]), "events_90d": (90, 0, None)})


@query("window_sum", f"""
SELECT customer_id, round(coalesce(sum(net_amount) FILTER ({_w('order_time', TA, 30)}), 0), 2) AS monetary_30d,
       round(coalesce(sum(net_amount) FILTER ({_w('order_time', TA, 90)}), 0), 2) AS monetary_90d
FROM t_orders GROUP BY 1""")
def _(v):
    return rounded(fe.window_sums(v.orders(), "order_time", "net_amount", T_AS_OF, {"monetary_30d": (30, 0), "monetary_90d": (90, 0)}), default=2)


@query("window_active_days", f"""
SELECT customer_id, count(DISTINCT CASE WHEN {_w('"timestamp"', EA, 30)} THEN CAST("timestamp" AS DATE) END) AS active_days_30d
FROM e_events GROUP BY 1""")
def _(v):
    return fe.window_active_days(v.live_events(), "timestamp", E_AS_OF, 30, "active_days_30d")


@query("ratio_and_change_rate", f"""
SELECT customer_id, r, p, CASE WHEN p <> 0 THEN round((r - p) / CAST(p AS DOUBLE), 6) END AS rate_or_null,
       CASE WHEN p = 0 THEN 0.0 ELSE round(r / CAST(p AS DOUBLE), 6) END AS ratio_or_zero
FROM (SELECT customer_id, count(*) FILTER ({_w('order_time', TA, 180)}) AS r, count(*) FILTER ({_w('order_time', TA, 180, 180)}) AS p
      FROM t_orders GROUP BY 1)""")
def _(v):
    w = fe.window_counts(v.orders(), "order_time", T_AS_OF, {"r": (180, 0, None), "p": (180, 180, None)})
    return rounded(w.select("customer_id", "r", "p", change_rate("r", "p").alias("rate_or_null"), ratio_zero("r", "p").alias("ratio_or_zero")))


@query("purchase_cycle", f"""
WITH h AS (SELECT *, lag(order_time) OVER (PARTITION BY customer_id ORDER BY order_time, order_id) AS prev FROM t_orders WHERE order_time <= {TA}),
g AS (SELECT customer_id, avg((epoch_us(order_time) - epoch_us(prev)) / 86400000000.0) AS avg_gap,
             quantile_cont((epoch_us(order_time) - epoch_us(prev)) / 86400000000.0, 0.5) AS med_gap,
             avg(quantity) AS items, avg(CAST(coupon_used AS DOUBLE)) AS coupons,
             (epoch_us({TA}) - epoch_us(max(order_time))) / 86400000000.0 AS idle FROM h GROUP BY 1)
SELECT customer_id, round(items, 6) AS avg_items_per_order_90d, round(coupons, 6) AS orders_with_coupon_ratio_90d,
       round(idle, 6) AS current_non_purchase_days, round(avg_gap, 6) AS avg_purchase_gap_days,
       CASE WHEN avg_gap <> 0 THEN round(idle / avg_gap, 6) END AS purchase_cycle_anomaly, round(med_gap, 6) AS median_purchase_gap_days
FROM g""")
def _(v):
    return rounded(fe.purchase_cycle(v.orders(quantity=True), T_AS_OF))


@query("order_mix_90d", f"""
SELECT customer_id, round(avg(quantity), 6) AS avg_items_per_order_true_90d, round(avg(CAST(coupon_used AS DOUBLE)), 6) AS coupon_ratio_true_90d
FROM t_orders WHERE {_w('order_time', TA, 90)} GROUP BY 1""")
def _(v):
    return rounded(fe.correct_90d_order_mix(v.orders(quantity=True), T_AS_OF))


SESSION_SQL = """
s AS (SELECT customer_id, session_id, min("timestamp") AS st, (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1000000.0 AS dur,
             count(*) FILTER (event_type = 'page_view') AS pv, count(*) FILTER (event_type = 'search') AS se,
             count(*) FILTER (event_type = 'support_contact') AS su
      FROM {ev} WHERE {w60} GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN {st30} THEN '30d' ELSE 'prev_30d' END AS span FROM s),
a AS (SELECT customer_id, {cols}, count(*) FILTER (se > 0) AS ss FROM p GROUP BY 1),
d AS (SELECT customer_id, count(DISTINCT CAST(order_time AS DATE)) AS days FROM {od} WHERE {ow60} GROUP BY 1)
"""


def session_sql(ev, od, at):
    cols = ", ".join(
        f"avg(dur) FILTER (span = '{x}') AS avg_session_duration_sec_{x}, avg(pv) FILTER (span = '{x}') AS pageviews_per_session_{x}, "
        f"avg(se) FILTER (span = '{x}') AS searches_per_session_{x}, nullif(count(*) FILTER (span = '{x}'), 0) AS sessions_{x}, "
        f"avg(su) FILTER (span = '{x}') AS support_contacts_per_session_{x}, "
        f"quantile_cont(dur, 0.5) FILTER (span = '{x}') AS median_session_duration_sec_{x}" for x in ("30d", "prev_30d"))
    return SESSION_SQL.format(ev=ev, od=od, w60=_w('"timestamp"', at, 60), st30=_w("st", at, 30), ow60=_w("order_time", at, 60), cols=cols)


_SR = ", ".join(f"round({n}_{x}, 3) AS {n}_{x}" for x in ("30d", "prev_30d") for n in (
    "avg_session_duration_sec", "pageviews_per_session", "searches_per_session", "support_contacts_per_session", "median_session_duration_sec"))


@query("session_features", f"""
WITH {session_sql("e_events", "e_orders", EA)}
SELECT a.customer_id, {_SR}, sessions_30d, sessions_prev_30d,
       round(CASE WHEN ss = 0 THEN 0 ELSE coalesce(days, 0) / CAST(ss AS DOUBLE) END, 6) AS search_to_purchase_conversion_total
FROM a LEFT JOIN d USING (customer_id)""")
def _(v):
    return rounded(fe.session_features(v.live_events(), v.live_orders(), E_AS_OF), {"search_to_purchase_conversion_total": 6}, default=3)


def _seq_sql(view, at):
    return f"""
SELECT customer_id, string_agg(event_type, ' > ' ORDER BY rn DESC) AS recent_event_sequence
FROM (SELECT customer_id, event_type, row_number() OVER (PARTITION BY customer_id ORDER BY "timestamp" DESC, event_type DESC) AS rn
      FROM {view} WHERE "timestamp" <= {at}) WHERE rn <= 5 GROUP BY 1"""


@query("recent_event_sequence", _seq_sql("t_events", TA))
def _(v):
    return fe.recent_event_sequence(v.events(), T_AS_OF)


_MIX = ", ".join(f"round(count(*) FILTER (event_type = '{t}') / CAST(count(*) AS DOUBLE), 6) AS share_{t}" for t in fe.EVENT_TYPES)


@query("behavior_mix", f"""SELECT customer_id, {_MIX} FROM t_events WHERE {_w('"timestamp"', TA, 90)} GROUP BY 1""")
def _(v):
    return rounded(fe.behavior_mix(v.events(), T_AS_OF))


@query("behavior_cluster")
def _(v):
    return fe.behavior_clusters(v.events(), T_AS_OF)


def time_cols(t='"timestamp"'):
    return f"""count(*) FILTER (hour({t}) >= 18) AS evening_events, count(*) FILTER (hour({t}) < 6) AS night_events,
      count(*) FILTER (hour({t}) >= 9 AND hour({t}) < 18) AS workhour_events, count(*) FILTER (isodow({t}) >= 6) AS weekend_events,
      count(*) AS total_events, count(DISTINCT event_type) AS event_diversity_90d"""


@query("time_of_day_features", f"""
WITH e AS (SELECT customer_id, {time_cols()} FROM e_events WHERE {_w('"timestamp"', EA, 90)} GROUP BY 1),
o AS (SELECT customer_id, count(*) FILTER (isodow(order_time) >= 6) / CAST(count(*) AS DOUBLE) AS wp FROM e_orders WHERE {_w('order_time', EA, 90)} GROUP BY 1)
SELECT customer_id, evening_events, night_events, workhour_events, weekend_events, total_events, event_diversity_90d,
       round(evening_events / CAST(total_events AS DOUBLE), 6) AS evening_activity_ratio, round(night_events / CAST(total_events AS DOUBLE), 6) AS night_activity_ratio,
       round(workhour_events / CAST(total_events AS DOUBLE), 6) AS workhour_activity_ratio, round(weekend_events / CAST(total_events AS DOUBLE), 6) AS weekend_activity_ratio,
       round(wp, 6) AS weekend_purchase_ratio, round(1 - wp, 6) AS weekday_purchase_ratio
FROM e FULL JOIN o USING (customer_id)""")
def _(v):
    return rounded(fe.time_of_day_features(v.live_events(), v.live_orders(), E_AS_OF))


def _dom_sql(view, at):
    return f"""SELECT customer_id, event_type AS dominant_event_type_90d
FROM (SELECT customer_id, event_type, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, event_type) AS rn
      FROM {view} WHERE {_w('"timestamp"', at, 90)} GROUP BY 1, 2) WHERE rn = 1"""


@query("dominant_event_type", _dom_sql("t_events", TA))
def _(v):
    return fe.dominant_event_type(v.events(), T_AS_OF)


@query("days_since_last", f"""
SELECT c.customer_id, coalesce((epoch_us({TA}) - epoch_us(e)) / 86400000000.0, 999.0) AS days_since_last_event,
       coalesce((epoch_us({TA}) - epoch_us(o)) / 86400000000.0, 999.0) AS recency_days
FROM t_customers c LEFT JOIN (SELECT customer_id, max("timestamp") AS e FROM t_events WHERE "timestamp" <= {TA} GROUP BY 1) USING (customer_id)
LEFT JOIN (SELECT customer_id, max(order_time) AS o FROM t_orders WHERE order_time <= {TA} GROUP BY 1) USING (customer_id)""")
def _(v):
    return fe.days_since_last(v.events(), v.orders(), v.customers(), T_AS_OF)


_X_AT = "2001-02-10 00:00:00"


@query("coupon_exposure_features", f"""
WITH x AS (SELECT customer_id, count(*) FILTER ({_w('exposure_time', f"TIMESTAMP '{_X_AT}'", 30)}) AS exposure_count_30d,
  count(*) FILTER ({_w('exposure_time', f"TIMESTAMP '{_X_AT}'", 30, 30)}) AS exposure_count_prev_30d,
  coalesce(sum(coupon_cost) FILTER ({_w('exposure_time', f"TIMESTAMP '{_X_AT}'", 30)}), 0) AS coupon_cost_30d,
  coalesce(sum(coupon_cost) FILTER ({_w('exposure_time', f"TIMESTAMP '{_X_AT}'", 30, 30)}), 0) AS coupon_cost_prev_30d
  FROM t_exposures GROUP BY 1),
u AS (SELECT customer_id, count(*) FILTER ({_w('order_time', f"TIMESTAMP '{_X_AT}'", 30)} AND coupon_used = 1) AS n30,
  count(*) FILTER ({_w('order_time', f"TIMESTAMP '{_X_AT}'", 30, 30)} AND coupon_used = 1) AS p30 FROM t_orders GROUP BY 1)
SELECT customer_id, exposure_count_30d, exposure_count_prev_30d, coupon_cost_30d, coupon_cost_prev_30d,
  CASE WHEN exposure_count_30d <> 0 THEN round(coalesce(n30, 0) / CAST(exposure_count_30d AS DOUBLE), 6) END AS coupon_open_rate_30d,
  CASE WHEN exposure_count_prev_30d <> 0 THEN round(coalesce(p30, 0) / CAST(exposure_count_prev_30d AS DOUBLE), 6) END AS coupon_open_rate_prev_30d
FROM x LEFT JOIN u USING (customer_id)""")
def _(v):
    x = fe.exposure_features(v.exposures(), _X_AT)
    o = v.orders().where("coupon_used = 1")
    u = fe.window_counts(o, "order_time", _X_AT, {"n30": (30, 0, None), "p30": (30, 30, None)})
    j = x.join(u, "customer_id", "left").na.fill(0, ["n30", "p30"])
    return rounded(j.select("customer_id", "exposure_count_30d", "exposure_count_prev_30d", "coupon_cost_30d", "coupon_cost_prev_30d",
                            ratio_null("n30", "exposure_count_30d").alias("coupon_open_rate_30d"),
                            ratio_null("p30", "exposure_count_prev_30d").alias("coupon_open_rate_prev_30d")))


LABEL_SQL = f"""
SELECT c.customer_id, CAST(CASE WHEN a.customer_id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS label
FROM t_customers c LEFT JOIN (
  SELECT customer_id FROM t_events WHERE "timestamp" > {TA} AND "timestamp" <= {TA} + INTERVAL 45 DAY AND lower(event_type) NOT IN ('ignore', 'other', 'unknown', 'nan')
  UNION SELECT customer_id FROM t_orders WHERE order_time > {TA} AND order_time <= {TA} + INTERVAL 45 DAY) a ON a.customer_id = c.customer_id"""


@query("future_activity_label", LABEL_SQL)
def _(v):
    return fe.future_activity_label(v.customers(), v.events(), v.orders(), None, T_AS_OF, 45)


@query("winsorize_impute", """
WITH b AS (SELECT customer_id, CASE WHEN customer_id % 9 = 0 THEN NULL ELSE monetary END AS monetary, CAST(frequency AS DOUBLE) AS frequency,
             CASE WHEN customer_id % 8 = 0 THEN NULL ELSE persona END AS persona FROM t_summary),
q AS (SELECT quantile_cont(monetary, 0.01) a, quantile_cont(monetary, 0.99) b, quantile_cont(monetary, 0.5) m,
             quantile_cont(frequency, 0.01) c, quantile_cont(frequency, 0.99) d FROM b)
SELECT customer_id, round(CASE WHEN monetary IS NULL THEN q.m ELSE least(greatest(monetary, q.a), q.b) END, 2) AS monetary, round(least(greatest(frequency, c), d), 2) AS frequency,
       coalesce(persona, 'unknown') AS persona FROM b, q""")
def _(v):
    s = v.summary().select(
        "customer_id", F.when(F.col("customer_id") % 9 != 0, F.col("monetary")).alias("monetary"), "frequency",
        F.when(F.col("customer_id") % 8 != 0, F.col("persona")).alias("persona"))
    return rounded(fe.winsorize_impute(s)[0], default=2)


@query("feature_clip_table", """
SELECT m AS feature, round(quantile_cont(x, 0.01), 2) AS clip_p01, round(quantile_cont(x, 0.99), 2) AS clip_p99, round(quantile_cont(x, 0.5), 2) AS fill_value
FROM (SELECT 'clv' AS m, clv AS x FROM t_summary UNION ALL SELECT 'monetary', monetary FROM t_summary) GROUP BY 1""")
def _(v):
    return rounded(fe.winsorize_impute(v.summary().select("customer_id", "clv", "monetary"))[1], default=2)


@query("summary_enrichment", """
SELECT c.customer_id, coalesce(CASE WHEN c.customer_id % 3 = 0 THEN c.persona END, 'from_summary') AS persona, c.region,
       round(s.churn_probability, 6) AS churn_probability, round(s.clv, 4) AS clv
FROM t_customers c LEFT JOIN t_summary s USING (customer_id)""")
def _(v):
    base = v.customers().select("customer_id", F.when(F.col("customer_id") % 3 == 0, F.col("persona")).alias("persona"), "region")
    s = v.summary().select("customer_id", F.lit("from_summary").alias("persona"), "churn_probability", "clv", F.lit(1).alias("dropped"))
    return rounded(fe.summary_enrichment(base, s), {"clv": 4})


_FRAME_COLS = [
    "customer_id", "customer_age_days", "recency_days", "days_since_last_event", "frequency_30d", "frequency_90d", "visits_14d",
    "visits_prev_14d", "visits_90d", "active_days_30d", "support_contact_30d", "exposure_count_30d", "avg_order_value_90d",
    "visit_change_rate_14d", "avg_purchase_gap_days", "median_purchase_gap_days", "purchase_cycle_anomaly", "sessions_30d",
    "monetary_per_visit_90d", "weekend_purchase_ratio", "recent_event_sequence", "dominant_event_type_90d", "label"]


@query("customer_features_core", f"""
WITH h AS (SELECT *, lag(order_time) OVER (PARTITION BY customer_id ORDER BY order_time, order_id) AS prev FROM t_orders),
o AS (SELECT customer_id, (epoch_us({TA}) - epoch_us(max(order_time) FILTER (order_time <= {TA}))) / 86400000000.0 AS rec,
   count(*) FILTER ({_w('order_time', TA, 30)}) AS f30, count(*) FILTER ({_w('order_time', TA, 90)}) AS f90,
   coalesce(sum(net_amount) FILTER ({_w('order_time', TA, 90)}), 0) AS m90,
   count(*) FILTER ({_w('order_time', TA, 90)} AND isodow(order_time) >= 6) AS wk,
   avg((epoch_us(order_time) - epoch_us(prev)) / 86400000000.0) FILTER (order_time <= {TA}) AS gap,
   quantile_cont((epoch_us(order_time) - epoch_us(prev)) / 86400000000.0, 0.5) FILTER (order_time <= {TA}) AS med FROM h GROUP BY 1),
e AS (SELECT customer_id, (epoch_us({TA}) - epoch_us(max("timestamp") FILTER ("timestamp" <= {TA}))) / 86400000000.0 AS dse,
   count(*) FILTER (event_type = 'visit' AND {_w('"timestamp"', TA, 14)}) AS v14, count(*) FILTER (event_type = 'visit' AND {_w('"timestamp"', TA, 14, 14)}) AS vp14,
   count(*) FILTER (event_type = 'visit' AND {_w('"timestamp"', TA, 90)}) AS v90,
   count(DISTINCT CASE WHEN {_w('"timestamp"', TA, 30)} THEN CAST("timestamp" AS DATE) END) AS ad,
   count(*) FILTER (event_type = 'support_contact' AND {_w('"timestamp"', TA, 30)}) AS su,
   nullif(count(DISTINCT CASE WHEN {_w('"timestamp"', TA, 30)} THEN session_id END), 0) AS s30 FROM t_events GROUP BY 1),
x AS (SELECT customer_id, count(*) FILTER ({_w('exposure_time', TA, 30)}) AS x30 FROM t_exposures GROUP BY 1),
q AS ({_seq_sql("t_events", TA)}), d AS ({_dom_sql("t_events", TA)}), l AS ({LABEL_SQL})
SELECT customer_id, greatest(CAST(floor((epoch_us({TA}) - epoch_us(signup_date)) / 86400000000) AS BIGINT), 0) AS customer_age_days,
  coalesce(rec, 999) AS recency_days, coalesce(dse, 999) AS days_since_last_event, coalesce(f30, 0) AS frequency_30d, coalesce(f90, 0) AS frequency_90d,
  coalesce(v14, 0) AS visits_14d, coalesce(vp14, 0) AS visits_prev_14d, coalesce(v90, 0) AS visits_90d, coalesce(ad, 0) AS active_days_30d,
  coalesce(su, 0) AS support_contact_30d, coalesce(x30, 0) AS exposure_count_30d,
  CASE WHEN f90 <> 0 THEN round(m90 / f90, 5) END AS avg_order_value_90d,
  CASE WHEN vp14 <> 0 THEN round((v14 - vp14) / CAST(vp14 AS DOUBLE), 6) END AS visit_change_rate_14d,
  round(gap, 6) AS avg_purchase_gap_days, round(med, 6) AS median_purchase_gap_days, CASE WHEN gap <> 0 THEN round(rec / gap, 6) END AS purchase_cycle_anomaly,
  s30 AS sessions_30d, CASE WHEN v90 <> 0 THEN round(coalesce(m90, 0) / v90, 5) END AS monetary_per_visit_90d,
  CASE WHEN f90 > 0 THEN round(wk / CAST(f90 AS DOUBLE), 6) END AS weekend_purchase_ratio,
  coalesce(recent_event_sequence, 'no_history') AS recent_event_sequence, coalesce(dominant_event_type_90d, 'none') AS dominant_event_type_90d, label
FROM t_customers LEFT JOIN o USING (customer_id) LEFT JOIN e USING (customer_id) LEFT JOIN x USING (customer_id) LEFT JOIN q USING (customer_id)
LEFT JOIN d USING (customer_id) LEFT JOIN l USING (customer_id) WHERE signup_date <= {TA}""")
def _(v):
    df, _ = fe.build_customer_features(v.customers(), v.events(), v.orders(), v.exposures(), as_of=T_AS_OF, clusters=None, finish=False)
    return rounded(df.select(*_FRAME_COLS), {"avg_order_value_90d": 5, "monetary_per_visit_90d": 5})


@query("customer_features_full")
def _(v):
    return fe.build_customer_features(
        v.customers(), v.events(), v.orders(quantity=True), v.exposures(), as_of=T_AS_OF, treatment=v.assignments(), clusters=6)[0]


@query("feature_metadata", f"""
SELECT '{T_AS_OF[:10]}' AS as_of_date, 45 AS horizon_days, count(*) AS row_count, round(avg(label), 6) AS positive_rate,
       'future_activity_horizon_no_activity' AS label_source FROM ({LABEL_SQL})""")
def _(v):
    lab = fe.future_activity_label(v.customers(), v.events(), v.orders(), None, T_AS_OF, 45)
    return rounded(fe.feature_metadata(lab, T_AS_OF, 45))


@query("event_micro_features", """
WITH g AS (SELECT customer_id, count(*) AS event_frequency, sum(amount) AS total_amount, avg(amount) AS avg_amount,
  count(*) FILTER (event_type = 'purchase') AS purchase_count, count(*) FILTER (regexp_matches(event_type, 'support|cancel|refund|complaint')) AS support_count
  FROM e_events GROUP BY 1),
c AS (SELECT *, 1 / (1 + exp(-(0.55 * support_count - 0.035 * event_frequency - 0.0007 * total_amount + 0.8))) AS churn FROM g),
u AS (SELECT *, least(greatest(0.02 + 0.22 * churn + 0.015 * ln(1 + event_frequency), 0.01), 0.35) AS uplift, greatest(25 + 1.8 * total_amount + 8 * event_frequency, 20) AS v FROM c)
SELECT customer_id, event_frequency, round(total_amount, 4) AS total_amount, round(avg_amount, 4) AS avg_amount, purchase_count, support_count,
  round(churn, 6) AS churn_probability, round(uplift, 6) AS uplift_score, round(v, 4) AS clv, round(least(greatest(4 + 0.015 * v + 2 * churn, 3), 75), 4) AS coupon_cost
FROM u""")
def _(v):
    return rounded(scoring.micro_features(v.live_events()), {"churn_probability": 6, "uplift_score": 6}, default=4)


@query("roi_score", """
WITH s AS (SELECT customer_id, churn_probability, uplift_score, clv, score_cost AS coupon_cost FROM t_scores),
p AS (SELECT *, uplift_score * churn_probability * clv AS ev, 0.08 * churn_probability * coupon_cost AS cp FROM s)
SELECT customer_id, round(ev, 4) AS expected_value, round(cp, 4) AS contact_penalty, round(ev - coupon_cost - cp, 4) AS expected_profit,
       round(CASE WHEN coupon_cost > 0 THEN (ev - coupon_cost - cp) / coupon_cost ELSE 0 END, 6) AS roi FROM p""")
def _(v):
    r = scoring.roi_score(v.scores().withColumnRenamed("score_cost", "coupon_cost"))
    return rounded(r.select("customer_id", "expected_value", "contact_penalty", "expected_profit", "roi").orderBy(F.desc("roi"), "customer_id"), {"roi": 6}, default=4)


@query("text_slug", """
SELECT doc_id, regexp_replace(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS source_slug FROM documents""")
def _(v):
    return v.table("documents").select("doc_id", slug("source").alias("source_slug"))


@query("timestamp_repair", """
SELECT event_id, epoch_us(ts) // 1000000 - CASE WHEN event_id % 5 IN (1, 2) THEN 9 * 3600 ELSE 0 END AS seconds FROM events""")
def _(v):
    base = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.concat(base, F.lit("Z"))).when(k == 1, F.concat(base, F.lit("+09"))).when(
        k == 2, F.concat(base, F.lit("+0900"))).when(k == 3, F.concat(base, F.lit("."))).otherwise(base)
    return v.live_events().select("event_id", F.floor(micros(repair_timestamp(text)) / 1_000_000).alias("seconds"))


@query("date_parts", """
SELECT order_id, CAST(order_time AS DATE) AS day, hour(order_time) AS hour, isodow(order_time) - 1 AS weekday,
       year(order_time) * 12 + month(order_time) AS month_number, CAST(order_time + INTERVAL 1 MONTH AS DATE) AS next_month,
       CAST(floor((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(order_time)) / 86400000000) AS BIGINT) AS age_days FROM t_orders""")
def _(v):
    from ..functions.expr import month_number, whole_days
    return v.orders().select(
        "order_id", F.to_date("order_time").alias("day"), F.hour("order_time").alias("hour"), F.weekday("order_time").alias("weekday"),
        month_number("order_time").alias("month_number"), F.add_months("order_time", 1).alias("next_month"),
        whole_days("order_time", ts("2001-08-01 00:00:00")).alias("age_days"))


@query("json_payload", """
SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ab') AS ab,
       coalesce(json_extract_string(props, '$.persona'), json_extract_string(props, '$.page'), 'unknown') AS first_alias FROM events""")
def _(v):
    p = lambda k: F.get_json_object("props", f"$.{k}")
    return v.live_events().select("event_id", p("page").alias("page"), p("ab").alias("ab"),
                                  F.coalesce(p("persona"), p("page"), F.lit("unknown")).alias("first_alias"))


