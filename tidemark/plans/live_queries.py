"""Live signals, scores, queue and serving views on the dense month."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import cut_lineage, scratch_path
from ..operators import audits as au, decisions as de, live as lv
from ..streaming import sources as ss, state as st
from .decision_sql import greedy_sql
from .registry import query, rounded

_AGE = "(epoch_us(l) - epoch_us(\"timestamp\")) / 3600000000.0"
_SIG = ", ".join(f"coalesce(sum(pow(0.5, {_AGE} / {h}.0)) FILTER (event_type = '{t}'), 0) AS {s}" for s, t, h, _ in lv.SIGNALS)
_RISK = " ".join(f"{'+' if w > 0 else '-'} {abs(w)} * {s}" for s, _, _, w in lv.SIGNALS)
_ST = f"""la AS (SELECT customer_id, max("timestamp") AS l, count(*) AS n FROM e_events GROUP BY 1),
sg AS (SELECT e.customer_id, any_value(l) AS last_event_at, any_value(n) AS total_events_seen, {_SIG} FROM e_events e JOIN la USING (customer_id) GROUP BY 1),
sc AS (SELECT *, 1 / (1 + exp(7 / 3.0)) AS inact, least(greatest(0.5 + 0.22 / (1 + exp(7 / 3.0)) {_RISK}, 0.001), 0.999) AS score FROM sg)"""


def states(v):
    return lv.live_score(lv.decayed_signals(v.live_events()))


@query("decayed_signals", f"WITH {_ST} SELECT customer_id, last_event_at, total_events_seen, " + ", ".join(f"round({s}, 6) AS {s}" for s in lv.SIGNAL_NAMES) + " FROM sg")
def _(v):
    return rounded(lv.decayed_signals(v.live_events()).drop("days_since_last_event"))


@query("live_churn_score", f"WITH {_ST} SELECT customer_id, round(score, 6) AS realtime_churn_score, round(score - 0.5, 6) AS score_delta FROM sc")
def _(v):
    return rounded(states(v).select("customer_id", "realtime_churn_score", "score_delta"))


_EV_SIG = ", ".join(f"sum(CASE WHEN event_type = '{t}' THEN pow(2, hh / {h}.0) ELSE 0 END) OVER w * pow(2, -hh / {h}.0) AS {s}" for s, t, h, _ in lv.SIGNALS)
_PE = f"""f AS (SELECT customer_id, min("timestamp") AS t0 FROM e_events GROUP BY 1), ee AS (SELECT e.*, (epoch_us("timestamp") - epoch_us(t0)) / 3600000000.0 AS hh FROM e_events e JOIN f USING (customer_id)),
es AS (SELECT customer_id, event_id, "timestamp", event_type, {_EV_SIG} FROM ee WINDOW w AS (PARTITION BY customer_id ORDER BY "timestamp", event_id)),
ec AS (SELECT *, least(greatest(0.5 + 0.22 / (1 + exp(7 / 3.0)) {_RISK}, 0.001), 0.999) AS sc FROM es), ep AS (SELECT *, coalesce(lag(sc) OVER (PARTITION BY customer_id ORDER BY "timestamp", event_id), 0.5) AS pv FROM ec),
tr AS (SELECT *, concat_ws(', ', CASE WHEN sc >= 0.8 AND pv < 0.8 THEN 'critical_risk_cross' END, CASE WHEN sc >= 0.65 AND pv < 0.65 THEN 'risk_threshold_cross' END, CASE WHEN sc - pv >= 0.12 THEN 'score_spike' END,
   CASE WHEN event_type IN ('remove_from_cart', 'support_contact') AND sc >= 0.65 THEN event_type || '_event' END, CASE WHEN support_signal >= 0.85 AND cart_remove_signal >= 0.85 AND purchase_signal <= 0.15 THEN 'support_and_cart_remove_without_purchase' END) AS why FROM ep)"""
_PE_OUT = f"WITH {_PE} SELECT event_id, customer_id, round(pv, 6) AS prev_score, round(sc, 6) AS realtime_churn_score, round(support_signal, 6) AS support_signal, coalesce(why, '') AS trigger_reason FROM tr"
_PE_COLS = ("event_id", "customer_id", "prev_score", "realtime_churn_score", "support_signal", "trigger_reason")


@query("reoptimize_triggers", _PE_OUT)
def _(v):
    return rounded(lv.scored_events(v.live_events()).select(*_PE_COLS))


#: Files of one week, which is one trigger of the streams below.
_FILES = 8


def _write_stream(v):
    """The month as one folder, a week at a time: files are read in the order they were written in."""
    path = scratch_path(v.spark)
    e = cut_lineage(v.live_events().selectExpr("event_id", "customer_id", "cast(timestamp AS timestamp) AS timestamp", "event_type", "amount").withColumn("_week", F.date_trunc("week", "timestamp")))
    for (week,) in e.select("_week").distinct().orderBy("_week").collect():  # one row a week
        e.where(F.col("_week") == F.lit(week)).drop("_week").repartition(_FILES, "customer_id").write.mode("append").parquet(path)
    return path


@query("stream_scored_events", _PE_OUT)
def _(v):
    """The same rows from a real stream: files, keyed state, one run over what is there."""
    src, out = _write_stream(v), scratch_path(v.spark)
    scored = st.scored_stream(ss.unique_events(ss.event_stream(v.spark, src, files_per_trigger=_FILES, watermark="40 days"), "event_id"))
    ss.replay(scored.select(*_PE_COLS), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"), scratch_path(v.spark))
    return rounded(v.spark.read.parquet(out).select(*_PE_COLS))


_CNT = ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}_count" for t in lv.COUNTERS)
_CNT_SQL = f"SELECT customer_id, count(*) AS event_count_total, {_CNT}, round(coalesce(sum(amount) FILTER (event_type = 'purchase'), 0), 3) AS revenue FROM e_events GROUP BY 1"


@query("feature_state_counters", _CNT_SQL)
def _(v):
    return rounded(lv.feature_state_counters(v.live_events()).drop("last_event_time", "first_event_time"), default=3)


@query("stream_counters", _CNT_SQL)
def _(v):
    src, out = _write_stream(v), scratch_path(v.spark)
    counts = st.counter_stream(ss.event_stream(v.spark, src, files_per_trigger=_FILES, watermark="40 days"))
    ss.replay(counts, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"), scratch_path(v.spark), mode="update")
    got = v.spark.read.parquet(out)
    last = got.groupBy("customer_id").agg(F.expr("max_by(struct(*), batch) AS r")).select("r.*").drop("batch", "last_event_time", "first_event_time")
    return rounded(last, default=3)


@query("sliding_counters", """SELECT customer_id, count(*) FILTER (event_type = 'visit' AND "timestamp" > TIMESTAMP '2024-01-25' - INTERVAL 7 DAY AND "timestamp" <= TIMESTAMP '2024-01-25') AS visit_7d,
  count(*) FILTER (event_type = 'purchase' AND "timestamp" > TIMESTAMP '2024-01-25' - INTERVAL 30 DAY AND "timestamp" <= TIMESTAMP '2024-01-25') AS purchase_30d,
  round(coalesce(sum(amount) FILTER (event_type = 'purchase' AND "timestamp" > TIMESTAMP '2024-01-25' - INTERVAL 30 DAY AND "timestamp" <= TIMESTAMP '2024-01-25'), 0), 3) AS revenue_30d FROM e_events GROUP BY 1""")
def _(v):
    return rounded(lv.sliding_counters(v.live_events(), "2024-01-25 00:00:00"), default=3)


# ---- queue -------------------------------------------------------------
def live_summary(v):
    """Scores of the dense month in the shape of a customer summary."""
    from ..operators.scoring import micro_features, uplift_band

    m = micro_features(v.live_events()).selectExpr("customer_id", "0.25 + 0.6 * (customer_id % 10) / 10D AS churn_probability", "uplift_score", "clv * 10 AS clv",
                                                   "cast(3000 + (customer_id % 13) * 500 AS double) AS coupon_cost", "(customer_id % 37) / 37D AS coupon_affinity", "(customer_id % 20) / 20D AS price_sensitivity")
    return m.selectExpr("*", "clv * uplift_score AS expected_incremental_profit", "clv * uplift_score / coupon_cost AS expected_roi", f"{uplift_band()} AS uplift_segment")


@query("trigger_actions_policy")
def _(v):
    hits = cut_lineage(lv.scored_events(v.live_events(), live_summary(v)).where("trigger_reason <> ''"))
    return lv.trigger_actions(hits, de.action_candidates(live_summary(v)))


_TRIGGERS = f"""tg AS (SELECT customer_id, arg_max(sc, (epoch_us("timestamp"), event_id)) AS sc, arg_max(event_id, (epoch_us("timestamp"), event_id)) AS event_id, max(epoch_us("timestamp")) AS tm FROM tr WHERE sc - pv >= 0.05 GROUP BY 1),
ca AS (SELECT tg.*, i, CAST(CASE i WHEN 'low' THEN 2000 WHEN 'mid' THEN 3000 ELSE 4500 END + (customer_id % 7) * 100 AS DOUBLE) AS coupon_cost, CAST((customer_id % 11) * 500 + CASE i WHEN 'low' THEN 1000 WHEN 'mid' THEN 1800 ELSE 2500 END AS DOUBLE) AS pf FROM tg, (SELECT unnest(['low', 'mid', 'high']) AS i)),
cr AS (SELECT *, pf / coupon_cost AS roi FROM ca), cp AS (SELECT *, 0.34 * (pf - min(pf) OVER k) / (max(pf) OVER k - min(pf) OVER k) + 0.28 * CASE WHEN max(roi) OVER k - min(roi) OVER k < 1e-12 THEN 0 ELSE (roi - min(roi) OVER k) / (max(roi) OVER k - min(roi) OVER k) END + 0.15 * sc AS ap FROM cr WINDOW k AS (PARTITION BY customer_id))"""


def _offers(v):
    hits = lv.scored_events(v.live_events()).where("realtime_churn_score - prev_score >= 0.05")
    cand = v.live_events().select("customer_id").distinct().selectExpr("customer_id", "explode(array('low', 'mid', 'high')) AS intervention_intensity").selectExpr(
        "*", "cast(CASE intervention_intensity WHEN 'low' THEN 2000 WHEN 'mid' THEN 3000 ELSE 4500 END + (customer_id % 7) * 100 AS double) AS coupon_cost",
        "cast((customer_id % 11) * 500 + CASE intervention_intensity WHEN 'low' THEN 1000 WHEN 'mid' THEN 1800 ELSE 2500 END AS double) AS expected_incremental_profit").selectExpr(
        "*", "expected_incremental_profit / coupon_cost AS expected_roi", "0D AS timing_urgency_score")
    return cut_lineage(lv.trigger_actions(cut_lineage(hits), cand))


@query("trigger_actions", f"WITH {_PE}, {_TRIGGERS} SELECT customer_id, event_id, i AS intervention_intensity, coupon_cost, round(ap, 6) AS action_priority FROM cp")
def _(v):
    return rounded(_offers(v).select("customer_id", "event_id", "intervention_intensity", "coupon_cost", "action_priority"))


_WALK = "tm, event_id, ap DESC, pf DESC, roi DESC, coupon_cost, i"


@query("queue_under_ledger", f"WITH RECURSIVE {_PE}, {_TRIGGERS}, " + greedy_sql("cp", _WALK, [("ledger", 150_000)], cap=40)[len("WITH RECURSIVE "):]
       + """, en AS (SELECT count(*) AS n, sum(coupon_cost) AS s, max(tm) AS ltm, arg_max(event_id, (tm, event_id)) AS lev FROM sel),
bs AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ap DESC, pf DESC, roi DESC, coupon_cost, i) AS rn FROM cp WHERE customer_id NOT IN (SELECT customer_id FROM sel))
SELECT customer_id, i AS intervention_intensity, coupon_cost, 'queued' AS action_queue_status FROM sel UNION ALL
SELECT customer_id, i, coupon_cost, CASE WHEN (tm > ltm OR tm = ltm AND event_id > lev) AND s < 150000 AND n >= 40 THEN 'deferred_channel_guardrail' ELSE 'deferred_budget_guardrail' END FROM bs, en WHERE rn = 1""")
def _(v):
    q = lv.queue_under_ledger(_offers(v), remaining_budget=150_000, remaining_capacity=40)
    return q.select("customer_id", "intervention_intensity", "coupon_cost", "action_queue_status")


@query("risk_ranking", f"WITH {_ST} SELECT customer_id, round(score, 6) AS realtime_churn_score FROM sc ORDER BY score DESC, customer_id LIMIT 50")
def _(v):
    return rounded(lv.risk_ranking(states(v), 50).select("customer_id", "realtime_churn_score"))


@query("risk_counts", f"WITH {_ST} SELECT count(*) AS tracked_customers, count(*) FILTER (score >= 0.7) AS high_risk_customers, count(*) FILTER (score >= 0.85) AS critical_risk_customers FROM sc")
def _(v):
    return lv.risk_counts(states(v))


@query("bootstrap_state", "SELECT customer_id, round(least(greatest(coalesce(churn_probability, 0.5), 0.001), 0.999), 6) AS base_churn_probability, " + ", ".join(f"0.0 AS {s}" for s in lv.SIGNAL_NAMES) + ", 0 AS total_events_seen FROM t_summary")
def _(v):
    return rounded(lv.bootstrap_state(v.summary()))


# ---- scores and policy -------------------------------------------------
_COLD = f"cd AS (SELECT customer_id, event_count_total AS n, revenue AS r FROM ({_CNT_SQL.replace('round(coalesce(sum(amount) FILTER (event_type = ' + chr(39) + 'purchase' + chr(39) + '), 0), 3)', 'coalesce(sum(amount) FILTER (event_type = ' + chr(39) + 'purchase' + chr(39) + '), 0)')}))"


@query("cold_scores", f"WITH {_COLD} SELECT customer_id, round(least(greatest(0.60 - 0.06 * n, 0.15), 0.70), 6) AS churn_score, round(CASE WHEN r > 0 THEN r * 6 ELSE 50000 END, 3) AS clv, 0.12 AS uplift_score, n >= 5 AS leaves_cold, 'new' AS risk_segment, round(CASE WHEN r > 0 THEN r * 6 ELSE 50000 END * 0.12, 3) AS expected_incremental_profit FROM cd")
def _(v):
    c = lv.cold_scores(lv.feature_state_counters(v.live_events())).drop("event_count_total", "revenue")
    return rounded(c, {"churn_score": 6}, default=3)


@query("score_changed_customers", f"""WITH {_COLD}, k AS (SELECT customer_id, 0.3 + 0.6 * (customer_id % 10) / 10.0 AS cs, 1000.0 + customer_id AS cv, 0.05 AS cu FROM (SELECT DISTINCT customer_id FROM e_events) WHERE customer_id % 3 > 0),
j AS (SELECT cd.customer_id, coalesce(cs, least(greatest(0.60 - 0.06 * n, 0.15), 0.70)) AS cs, coalesce(cv, CASE WHEN r > 0 THEN r * 6 ELSE 50000 END) AS cv, coalesce(cu, 0.12) AS cu, k.customer_id IS NOT NULL OR n >= 5 AS known FROM cd LEFT JOIN k USING (customer_id) WHERE cd.customer_id % 2 = 0)
SELECT customer_id, round(cs, 6) AS churn_score, round(cv, 3) AS clv, round(cu, 6) AS uplift_score, round(cv * cu, 4) AS expected_incremental_profit, CASE WHEN NOT known THEN 'new' WHEN cs >= 0.85 THEN 'critical' WHEN cs >= 0.70 THEN 'high' WHEN cs >= 0.50 THEN 'medium' ELSE 'low' END AS risk_segment FROM j""")
def _(v):
    s = lv.feature_state_counters(v.live_events())
    known = s.where("customer_id % 3 > 0").selectExpr("customer_id", "0.3D + 0.6D * (customer_id % 10) / 10D AS churn_score", "1000D + customer_id AS clv", "0.05D AS uplift_score")
    out = lv.score_changed(s.where("customer_id % 2 = 0").select("customer_id"), s, known)
    return rounded(out.select("customer_id", "churn_score", "clv", "uplift_score", "expected_incremental_profit", "risk_segment"), {"clv": 3, "expected_incremental_profit": 4})


def score_rows(v):
    return v.summary().selectExpr("customer_id", "1 - churn_probability AS churn_score", "clv", "uplift_score", "expected_roi", "expected_incremental_profit", "signup_date AS scored_at",
                                  f"{lv.risk_band('1 - churn_probability')} AS risk_segment", "persona", "churn_probability")


_LS = """ls AS (SELECT customer_id, 1 - churn_probability AS cs, clv, uplift_score AS u, expected_roi AS r, expected_incremental_profit AS p, signup_date AS scored_at, persona FROM t_summary),
lb AS (SELECT *, CASE WHEN cs >= 0.85 THEN 'critical' WHEN cs >= 0.70 THEN 'high' WHEN cs >= 0.50 THEN 'medium' ELSE 'low' END AS risk_segment FROM ls),
la AS (SELECT *, CASE WHEN cs >= 0.85 THEN CASE WHEN u >= 0.03 AND r >= 1 THEN 'high_value_retention_benefit' ELSE 'priority_human_followup' END WHEN cs >= 0.70 THEN CASE WHEN u >= 0.02 THEN 'personalized_retention_offer' ELSE 'retention_message' END
   WHEN cs >= 0.50 THEN 'light_retention_message' WHEN u >= 0.05 AND r >= 1 THEN 'low_risk_upsell_offer' ELSE 'monitor_only' END AS act FROM lb),
lc AS (SELECT *, CASE act WHEN 'high_value_retention_benefit' THEN 'benefit' WHEN 'priority_human_followup' THEN 'crm' WHEN 'personalized_retention_offer' THEN 'benefit' WHEN 'retention_message' THEN 'message' WHEN 'light_retention_message' THEN 'message' WHEN 'low_risk_upsell_offer' THEN 'upsell' ELSE 'monitoring' END AS cat,
   CASE act WHEN 'high_value_retention_benefit' THEN 'high' WHEN 'priority_human_followup' THEN 'high' WHEN 'personalized_retention_offer' THEN 'medium' WHEN 'retention_message' THEN 'medium' WHEN 'light_retention_message' THEN 'low' WHEN 'low_risk_upsell_offer' THEN 'low' ELSE 'none' END AS inten FROM la),
ld AS (SELECT *, greatest(CASE cat WHEN 'benefit' THEN 7000.0 WHEN 'crm' THEN 12000 WHEN 'message' THEN 1500 WHEN 'upsell' THEN 4000 ELSE 0 END * CASE inten WHEN 'high' THEN 1.65 WHEN 'medium' THEN 1.0 WHEN 'low' THEN 0.7 ELSE 0 END, CASE WHEN r > 0 THEN greatest(p / r, 0) ELSE 0 END) AS c0 FROM lc),
lp AS (SELECT *, round(greatest(CASE WHEN cat IN ('crm', 'upsell') THEN least(c0, greatest(clv * 0.08, 1000)) ELSE c0 END, 0), 2) AS cost FROM ld)"""
_LP_COLS = "customer_id, act AS recommended_action, cat AS recommended_category, inten AS intervention_intensity, cost AS coupon_cost, round(p, 3) AS priority_score, cs >= 0.5 AND r >= 0 AND p >= 0 AS should_queue"


def policy_rows(df):
    return df.selectExpr("customer_id", "recommended_action", "recommended_category", "intervention_intensity", "round(coupon_cost, 2) AS coupon_cost", "round(priority_score, 3) AS priority_score", "should_queue")


@query("live_policy", f"WITH {_LS} SELECT {_LP_COLS} FROM lp")
def _(v):
    return policy_rows(lv.live_policy(score_rows(v)))


@query("refresh_recent", f"WITH {_LS} SELECT {_LP_COLS} FROM lp ORDER BY scored_at DESC, customer_id LIMIT 200")
def _(v):
    return policy_rows(lv.refresh_recent(score_rows(v), 200))


@query("drift_summary", f"""WITH {_LS} SELECT count(*) AS scored_customers, round(avg(cs), 6) AS avg_churn_score, round(stddev_samp(cs), 6) AS std_churn_score, count(*) FILTER (cs >= 0.7) AS high_risk_customers, max(scored_at) AS latest_scored_at,
  (SELECT count(*) FROM e_events) AS event_count, (SELECT max("timestamp") FROM e_events) AS latest_event_time FROM ls""")
def _(v):
    return rounded(lv.drift_summary(score_rows(v), v.live_events()))


@query("live_score_summary", f"WITH {_LS} SELECT risk_segment, count(*) AS customers, round(avg(cs), 6) AS avg_churn_score, max(scored_at) AS latest_scored_at FROM lb GROUP BY 1")
def _(v):
    return rounded(lv.live_score_summary(score_rows(v)))


@query("live_health", f"""WITH {_LS} SELECT (SELECT count(*) FROM e_events) AS event_count, (SELECT max("timestamp") FROM e_events) AS latest_event_time, (SELECT count(DISTINCT customer_id) FROM e_events) AS state_count, count(*) AS score_count, max(scored_at) AS latest_scored_at,
  count(*) FILTER (cs >= 0.5 AND r >= 0 AND p >= 0) AS queued_count FROM lp""")
def _(v):
    s = score_rows(v)
    return lv.live_health(v.live_events(), lv.feature_state_counters(v.live_events()), s, lv.live_policy(s))


@query("new_customers", f"""WITH {_LS}, s AS (SELECT customer_id, count(*) AS n, max("timestamp") AS t FROM e_events GROUP BY 1)
SELECT s.customer_id, n AS event_count_total, t AS last_event_time, round(cs, 6) AS churn_score, risk_segment FROM s LEFT JOIN lb USING (customer_id) WHERE n < 65 ORDER BY t DESC, customer_id LIMIT 30""")
def _(v):
    s = lv.feature_state_counters(v.live_events()).withColumn("is_new_customer", F.expr("event_count_total < 65"))
    return rounded(lv.new_customers(s, score_rows(v), 30).select("customer_id", "event_count_total", "last_event_time", "churn_score", "risk_segment"))


@query("queue_query", f"WITH {_LS} SELECT {_LP_COLS} FROM lp WHERE inten = 'medium' ORDER BY p DESC, customer_id LIMIT 25")
def _(v):
    return policy_rows(lv.filtered_view(lv.live_policy(score_rows(v)), equals={"intervention_intensity": "medium"}, priority="priority_score", limit=25))


@query("event_query", """SELECT event_id, customer_id, event_type FROM e_events WHERE event_type = 'purchase' ORDER BY "timestamp" DESC, event_id DESC LIMIT 40""")
def _(v):
    return lv.filtered_view(v.live_events(), equals={"event_type": "purchase"}, newest="timestamp", limit=40).select("event_id", "customer_id", "event_type")


@query("candidate_query", f"WITH {_LS} SELECT {_LP_COLS} FROM lp WHERE cat = 'message' ORDER BY p DESC, customer_id LIMIT 40")
def _(v):
    return policy_rows(lv.filtered_view(lv.live_policy(score_rows(v)), equals={"recommended_category": "message"}, priority="priority_score", limit=40))


@query("state_query", """SELECT customer_id, count(*) AS event_count_total, max("timestamp") AS last_event_time FROM e_events GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 40""")
def _(v):
    return lv.filtered_view(lv.feature_state_counters(v.live_events()), newest="last_event_time", limit=40).select("customer_id", "event_count_total", "last_event_time")


@query("replay_ticks", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY "timestamp", event_id) AS position FROM e_events), n AS (SELECT count(*) AS n FROM e_events)
SELECT 1 AS tick, event_id, position FROM r, n WHERE position <= n // 2 UNION ALL SELECT 2, event_id, position FROM r, n WHERE position > n // 2 AND position <= 2 * (n // 2)
UNION ALL SELECT 3, event_id, position FROM r, n WHERE position > 2 * (n // 2) OR n % 2 = 0 AND position <= n // 2 UNION ALL SELECT 4, event_id, position FROM r, n WHERE n % 2 = 1 AND position <= n // 2 OR n % 2 = 0 AND position > n // 2 AND position <= n""")
def _(v):
    """Four ticks of half the log; the last ones begin anew."""
    e = cut_lineage(v.live_events().select("event_id", "timestamp"))
    size, offset, parts = e.count() // 2, 0, []
    for tick in range(1, 5):
        rows, offset, _ = ss.replay_tick(e, offset, size)
        parts.append(rows.select(F.lit(tick).alias("tick"), "event_id", "position"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_TXT = """SELECT CASE WHEN event_id % 97 = 0 THEN 'customer' WHEN event_id % 101 = 0 THEN 'timestamp' ELSE 'none' END AS reject_reason, event_type, count(*) AS events FROM e_events GROUP BY 1, 2"""


@query("stream_text_events", _TXT)
def _(v):
    """Text events from a stream; what cannot be read is counted by reason."""
    src, out = scratch_path(v.spark), scratch_path(v.spark)
    v.live_events().selectExpr(
        "cast(event_id AS string) AS event_id", "CASE WHEN event_id % 97 = 0 THEN 'nobody' ELSE cast(customer_id AS string) END AS customer_id",
        "CASE WHEN event_id % 101 = 0 THEN 'soon' ELSE date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss\") || 'Z.' END AS timestamp",
        "' ' || upper(event_type) AS event_type", "cast(amount AS string) AS amount").write.option("header", True).csv(src)
    ss.replay(ss.text_stream(v.spark, src, files_per_trigger=4), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"), scratch_path(v.spark))
    return v.spark.read.parquet(out).groupBy(F.coalesce("reject_reason", F.lit("none")).alias("reject_reason"), "event_type").agg(F.count(F.lit(1)).alias("events"))


@query("live_status_mix", f"""WITH {_LS}, q AS (SELECT ls.customer_id, CASE WHEN lp.customer_id IS NULL THEN 'not_queued' ELSE 'queued' END AS s FROM ls LEFT JOIN (SELECT * FROM lp WHERE cs >= 0.5 AND r >= 0 AND p >= 0) lp USING (customer_id))
SELECT 'action_queue_status' AS dimension, s AS value, count(*) AS count, count(*) / CAST((SELECT count(*) FROM q) AS DOUBLE) AS share FROM q GROUP BY s""")
def _(v):
    s = score_rows(v)
    return au.value_mix(lv.live_monitor_view(s, lv.live_policy(s).where("should_queue").withColumn("action_status", F.lit("queued"))), ["action_queue_status"])


@query("live_trigger_mix", f"""WITH {_PE}, x AS (SELECT coalesce(nullif(arg_max(why, ("timestamp", event_id)), ''), 'unknown') AS value FROM tr GROUP BY customer_id)
SELECT 'latest_trigger_reason' AS dimension, value, count(*) AS count, count(*) / CAST((SELECT count(*) FROM x) AS DOUBLE) AS share FROM x GROUP BY value""")
def _(v):
    last = lv.scored_events(v.live_events()).groupBy("customer_id").agg(F.expr("nullif(max_by(trigger_reason, struct(timestamp, event_id)), '') AS latest_trigger_reason"))
    return au.value_mix(last, ["latest_trigger_reason"])


@query("live_monitor_view", f"""WITH {_LS}, q AS (SELECT * FROM lp WHERE cs >= 0.5 AND r >= 0 AND p >= 0)
SELECT ls.customer_id, round(ls.cs, 6) AS realtime_churn_score, CASE WHEN q.customer_id IS NULL THEN 'not_queued' ELSE 'queued' END AS action_queue_status, act AS queued_recommended_action, inten AS queued_intervention_intensity, coalesce(cost, 0.0) AS queued_coupon_cost FROM ls LEFT JOIN q USING (customer_id)""")
def _(v):
    s = score_rows(v)
    a = lv.live_policy(s).where("should_queue").withColumn("action_status", F.lit("queued"))
    m = lv.live_monitor_view(s, a)
    return m.selectExpr("customer_id", "round(realtime_churn_score, 6) AS realtime_churn_score", "action_queue_status", "queued_recommended_action", "queued_intervention_intensity", "round(queued_coupon_cost, 2) AS queued_coupon_cost")


_LBSRC = "(SELECT customer_id, p, CASE WHEN customer_id % 4 = 0 THEN p / r ELSE cost END AS coupon_cost FROM lp JOIN (SELECT customer_id, uplift_segment FROM t_summary) USING (customer_id) WHERE cs >= 0.6 AND (customer_id % 4 > 0 OR r > 0) AND cost > 0 AND p > 0 AND uplift_segment <> 'Sleeping Dogs')"


@query("live_budget", greedy_sql(_LBSRC, "p DESC, coupon_cost, customer_id", [("budget", 1_500_000)]).replace("WITH RECURSIVE ", f"WITH RECURSIVE {_LS}, ", 1) + " SELECT customer_id, round(coupon_cost, 2) AS coupon_cost FROM sel")
def _(v):
    s = score_rows(v)
    a = lv.live_policy(s).withColumn("coupon_cost", F.expr("CASE WHEN customer_id % 4 = 0 THEN 0D ELSE coupon_cost END")).where("customer_id % 4 = 0 OR coupon_cost > 0").select(
        "customer_id", "coupon_cost", "expected_incremental_profit", "expected_roi", "priority_score", F.lit(0.0).alias("churn_probability"), "intervention_intensity")
    sc = v.summary().selectExpr("customer_id", "1 - churn_probability AS churn_probability", "clv", "uplift_score", "uplift_segment")
    return lv.live_budget(a, sc, 1_500_000, threshold=0.6).selectExpr("customer_id", "round(coupon_cost, 2) AS coupon_cost")


@query("realtime_monitor", f"WITH {_ST} " + " UNION ALL ".join(f"SELECT '{s}' AS signal, round(avg({s}), 6) AS mean_value FROM sg" for s in lv.SIGNAL_NAMES))
def _(v):
    return rounded(au.realtime_monitor(states(v), lv.SIGNAL_NAMES))


@query("seed_serving_tables", """SELECT customer_id, round(churn_probability, 6) AS churn_score, round(clv, 3) AS clv, round(uplift_score, 6) AS uplift_score, CASE WHEN churn_probability >= 0.85 THEN 'critical' WHEN churn_probability >= 0.70 THEN 'high' WHEN churn_probability >= 0.50 THEN 'medium' ELSE 'low' END AS risk_segment FROM t_summary""")
def _(v):
    a = v.summary().selectExpr("customer_id AS user_id", "churn_probability", "uplift_score").withColumnRenamed("user_id", "customer_id")
    b = v.summary().select("customer_id", "clv", "expected_roi", "expected_incremental_profit")
    return rounded(lv.seed_serving_tables([a, b], scratch_path(v.spark)).select("customer_id", "churn_score", "clv", "uplift_score", "risk_segment"), {"clv": 3})
