"""Streams with timers, first states, exact de-duplication, event-time windows and counted rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import cut_lineage, scratch_path
from ..operators import live as lv
from ..streaming import inactivity as ia, ledger as sl, sources as ss, state as st
from ..streaming.serving import ServingTables
from .live_queries import _FILES, _PE, _write_stream
from .registry import query, rounded


def _written(df, by: str, fmt: str = "parquet"):
    """``df`` as one folder in which each value of ``by``, in order, is one trigger of ``_FILES`` files."""
    path = scratch_path(df.sparkSession)
    df = cut_lineage(df)
    for (part,) in df.select(by).distinct().orderBy(by).collect():  # one row a trigger
        df.where(F.col(by) == F.lit(part)).drop(by).repartition(_FILES).write.mode("append").format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)
    return path


# ---- silence -----------------------------------------------------------
def _history(v):
    """Seven years of purchases and shipments with ids; most customers are silent for weeks."""
    buy = v.table("orders").selectExpr("o_orderkey * 10 AS event_id", "o_custkey AS customer_id", "o_orderdate AS timestamp", "'purchase' AS event_type")
    ship = v.table("lineitem").join(v.table("orders"), F.expr("l_orderkey = o_orderkey")).selectExpr(
        "l_orderkey * 10 + l_linenumber AS event_id", "o_custkey AS customer_id", "l_shipdate AS timestamp", "CASE l_returnflag WHEN 'N' THEN 'visit' WHEN 'R' THEN 'support_contact' ELSE 'page_view' END AS event_type")
    return buy.unionByName(ship)


def _history_base(v):
    return v.table("customer").where("c_custkey % 9 > 0").selectExpr("c_custkey AS customer_id", "0.30D + 0.05D * (c_custkey % 8) AS churn_probability")


_SILENT = """WITH h AS (SELECT o_custkey AS customer_id, o_orderdate AS t, 'purchase' AS e FROM orders UNION ALL
  SELECT o_custkey, l_shipdate, CASE l_returnflag WHEN 'N' THEN 'visit' WHEN 'R' THEN 'support_contact' ELSE 'page_view' END FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tm AS (SELECT customer_id, t, count(*) FILTER (e = 'visit') AS nv, count(*) FILTER (e = 'support_contact') AS ns, count(*) FILTER (e = 'purchase') AS np FROM h GROUP BY 1, 2),
gp AS (SELECT customer_id, t, lead(t) OVER (PARTITION BY customer_id ORDER BY t) AS nx FROM tm),
sg AS (SELECT g.customer_id, g.t, any_value(g.nx) AS nx, sum(nv * pow(0.5, (epoch_us(g.t) - epoch_us(x.t)) / 3600000000.0 / 18)) AS v, sum(ns * pow(0.5, (epoch_us(g.t) - epoch_us(x.t)) / 3600000000.0 / 72)) AS s, sum(np * pow(0.5, (epoch_us(g.t) - epoch_us(x.t)) / 3600000000.0 / 72)) AS p
  FROM gp g JOIN tm x ON x.customer_id = g.customer_id AND x.t <= g.t WHERE g.nx IS NULL OR g.nx > g.t + INTERVAL 11 DAY GROUP BY 1, 2),
bs AS (SELECT sg.*, CASE WHEN customer_id % 9 > 0 THEN 0.30 + 0.05 * (customer_id % 8) ELSE 0.5 END AS b FROM sg),
dy AS (SELECT *, unnest(range(11, 130)) AS k FROM bs),
sc AS (SELECT *, least(greatest(b + 0.22 / (1 + exp(-(k - 7) / 3.0)) - 0.09 * v * pow(0.5, k * 24 / 18.0) + 0.13 * s * pow(0.5, k * 24 / 72.0) - 0.16 * p * pow(0.5, k * 24 / 72.0), 0.001), 0.999) AS z,
  least(greatest(b + 0.22 / (1 + exp(7 / 3.0)) - 0.09 * v + 0.13 * s - 0.16 * p, 0.001), 0.999) AS y FROM dy WHERE p * pow(0.5, k * 24 / 72.0) <= 0.10),
f AS (SELECT customer_id, t, any_value(nx) AS nx, min(k) AS k, arg_min(z, k) AS z, any_value(y) AS y FROM sc WHERE z >= 0.65 GROUP BY 1, 2)
SELECT customer_id, t + to_days(k::INTEGER) AS "timestamp", k::DOUBLE AS days_since_last_event, round(y, 6) AS prev_score, round(z, 6) AS realtime_churn_score,
  concat_ws(', ', CASE WHEN z >= 0.8 AND y < 0.8 THEN 'critical_risk_cross' END, CASE WHEN y < 0.65 THEN 'risk_threshold_cross' END, CASE WHEN z - y >= 0.12 THEN 'score_spike' END, 'extended_inactivity') AS trigger_reason
FROM f WHERE t + to_days(k::INTEGER) < nx OR nx IS NULL AND t + to_days(k::INTEGER) <= (SELECT max(t) FROM h) - INTERVAL 30 DAY"""
_SILENT_COLS = ("customer_id", "timestamp", "days_since_last_event", "prev_score", "realtime_churn_score", "trigger_reason")


@query("inactivity_triggers", _SILENT)
def _(v):
    """Silences of the whole history that call for attention."""
    h = cut_lineage(_history(v))
    last = h.agg(F.max("timestamp")).first()[0]
    return rounded(lv.silent_customers(h, f"timestamp_ntz'{last}' - make_dt_interval(30)", _history_base(v)).select(*_SILENT_COLS))


@query("stream_inactivity_triggers", _SILENT)
def _(v):
    """The same silences from timers: a year a trigger, first states from known scores, the end from the watermark."""
    src = _written(_history(v).selectExpr("event_id", "customer_id", "cast(timestamp AS timestamp) AS timestamp", "event_type", "0D AS amount", "year(timestamp) AS _year"), "_year")
    out = ss.SideTable(v.spark, scratch_path(v.spark))
    live = ia.live_stream(ss.event_stream(v.spark, src, files_per_trigger=_FILES, watermark=None), _history_base(v), "30 days")
    ss.replay(live.where("status = 'silent'").select(*_SILENT_COLS), out, scratch_path(v.spark), on_disk=True)
    return rounded(out.rows().select(*_SILENT_COLS).withColumn("timestamp", F.expr("cast(timestamp AS timestamp_ntz)")))


# ---- first states ------------------------------------------------------
_BASE = "(0.25 + 0.06 * (customer_id % 10))"
_PE_SEEDED = _PE.replace("greatest(0.5 + 0.22", f"greatest({_BASE} + 0.22").replace("event_id), 0.5) AS pv", f"event_id), {_BASE}) AS pv")
_SEEDED = f"WITH {_PE_SEEDED} SELECT event_id, customer_id, round(pv, 6) AS prev_score, round(sc, 6) AS realtime_churn_score, coalesce(why, '') AS trigger_reason FROM tr"


@query("stream_initial_state", _SEEDED)
def _(v):
    """A customer's first event starts from the known score; no event is joined with anything."""
    cols = ("event_id", "customer_id", "prev_score", "realtime_churn_score", "trigger_reason")
    base = v.live_events().select("customer_id").distinct().selectExpr("customer_id", "0.25D + 0.06D * (customer_id % 10) AS churn_probability")
    out = ss.SideTable(v.spark, scratch_path(v.spark))
    live = ia.live_stream(ss.event_stream(v.spark, _write_stream(v), files_per_trigger=_FILES, watermark=None), base, "40 days")
    ss.replay(live.where("status = 'applied'").select(*cols), out, scratch_path(v.spark), on_disk=True)
    return rounded(out.rows().select(*cols))


# ---- what becomes of every row -----------------------------------------
_ACCOUNT = """WITH d AS (SELECT event_id, date_trunc('second', "timestamp") AS t, date_trunc('week', "timestamp") + CASE WHEN event_id % 61 = 0 THEN INTERVAL 14 DAY ELSE INTERVAL 0 DAY END AS w,
    CASE WHEN event_id % 97 = 0 THEN 'customer' WHEN event_id % 101 = 0 THEN 'timestamp' END AS bad FROM e_events),
wm AS (SELECT w, max(max(t) FILTER (bad IS NULL)) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 7 DAY AS mark FROM d GROUP BY w),
r AS (SELECT event_id, CASE WHEN bad IS NOT NULL THEN 'rejected' WHEN t < mark THEN 'late' ELSE 'applied' END AS status, bad AS reason FROM d JOIN wm USING (w)
  UNION ALL SELECT event_id, CASE WHEN bad IS NOT NULL THEN 'rejected' ELSE 'repeated' END, bad FROM d WHERE event_id % 89 = 0)
SELECT status, coalesce(reason, '') AS reason, count(*) AS events FROM r GROUP BY 1, 2 UNION ALL SELECT 'received', '', count(*) FROM r"""


@query("stream_event_accounting", _ACCOUNT)
def _(v):
    """Text events, some late, some sent again, some unusable: every row received is applied, late, repeated or rejected."""
    week = "date_trunc('week', timestamp) + CASE WHEN event_id % 61 = 0 THEN INTERVAL 14 DAY ELSE INTERVAL 0 DAY END"
    text = v.live_events().selectExpr(
        "cast(event_id AS string) AS event_id", "CASE WHEN event_id % 97 = 0 THEN 'nobody' ELSE cast(customer_id AS string) END AS customer_id",
        "CASE WHEN event_id % 101 = 0 THEN 'soon' ELSE date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss\") || 'Z.' END AS timestamp", "event_type", "cast(amount AS string) AS amount",
        f"explode(CASE WHEN event_id % 89 = 0 THEN array({week}, {week} + INTERVAL 14 DAY) ELSE array({week}) END) AS _week")
    out = ss.SideTable(v.spark, scratch_path(v.spark))
    rows = ss.accounted(ss.raw_stream(v.spark, _written(text, "_week", "csv"), files_per_trigger=_FILES), lambda e: ia.live_stream(e, None, "7 days"))
    usable = ss.counted(ss.replay(rows, out, scratch_path(v.spark), on_disk=True), "usable").get("rows", 0)
    by = cut_lineage(out.rows().groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("events")))
    kept = F.coalesce(F.expr("sum(events) FILTER (WHERE status <> 'rejected')"), F.lit(0))
    more = by.agg(kept.alias("kept"), F.coalesce(F.sum("events"), F.lit(0)).alias("all")).selectExpr(f"inline(array(struct('repeated' AS status, '' AS reason, {usable} - kept AS events), struct('received' AS status, '' AS reason, all + {usable} - kept AS events)))")
    return by.unionByName(more)


@query("stream_exact_dedup", "SELECT o_custkey AS customer_id, count(*) AS events, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1")
def _(v):
    """Purchases, of which a seventh is sent again a year later under a watermark of a day: each counts once."""
    year = "year(o_orderdate)"
    sent = v.table("orders").selectExpr("o_orderkey AS event_id", "o_custkey AS customer_id", "cast(o_orderdate AS timestamp) AS timestamp", "'purchase' AS event_type", "o_totalprice AS amount",
                                        f"explode(CASE WHEN o_orderkey % 7 = 0 THEN array({year}, {year} + 1) ELSE array({year}) END) AS _year")
    out = ss.SideTable(v.spark, scratch_path(v.spark))
    once = ss.unique_forever(ss.event_stream(v.spark, _written(sent, "_year"), files_per_trigger=_FILES, watermark=None)).withWatermark("timestamp", "1 day")
    ss.replay(once.select("customer_id", "amount"), out, scratch_path(v.spark), on_disk=True)
    return rounded(out.rows().groupBy("customer_id").agg(F.count(F.lit(1)).alias("events"), F.sum("amount").alias("amount")), default=2)


# ---- event-time windows ------------------------------------------------
_CLOSED = "(SELECT max(\"timestamp\") - INTERVAL 1 DAY FROM e_events)"


@query("stream_drift_windows", f"""WITH {_PE} SELECT date_trunc('day', "timestamp")::TIMESTAMP AS day, count(*) AS events, round(avg(sc), 6) AS avg_score, round(stddev_samp(sc), 6) AS std_score, count(*) FILTER (sc >= 0.7) AS high_risk_events
FROM tr GROUP BY 1 HAVING date_trunc('day', any_value("timestamp")) + INTERVAL 1 DAY <= {_CLOSED}""")
def _(v):
    """Days of the scored stream, each written once when the watermark has passed its end."""
    out = ss.SideTable(v.spark, scratch_path(v.spark))
    live = ia.live_stream(ss.event_stream(v.spark, _write_stream(v), files_per_trigger=_FILES, watermark=None), None, "1 day")
    ss.replay(st.drift_stream(live.where("status = 'applied'")), out, scratch_path(v.spark), on_disk=True)
    days = out.rows().select(F.expr("cast(window.start AS timestamp_ntz) AS day"), "events", "avg_score", "std_score", "high_risk_events")
    return rounded(days)


@query("stream_sliding_counters", f"""WITH w AS (SELECT unnest(generate_series((SELECT date_trunc('day', min("timestamp")) - INTERVAL 6 DAY FROM e_events), (SELECT max("timestamp") FROM e_events), INTERVAL 1 DAY)) AS s)
SELECT customer_id, (s + INTERVAL 7 DAY)::TIMESTAMP AS as_of, count(*) AS events, count(*) FILTER (event_type = 'visit') AS visits, count(*) FILTER (event_type = 'purchase') AS purchases, round(coalesce(sum(amount) FILTER (event_type = 'purchase'), 0), 3) AS revenue
FROM e_events JOIN w ON "timestamp" >= s AND "timestamp" < s + INTERVAL 7 DAY WHERE s + INTERVAL 7 DAY <= {_CLOSED} GROUP BY 1, 2""")
def _(v):
    """Seven days back from every midnight, per customer, as the watermark passes it."""
    out = ss.SideTable(v.spark, scratch_path(v.spark))
    e = ss.event_stream(v.spark, _write_stream(v), files_per_trigger=_FILES, watermark="1 day")
    ss.replay(st.sliding_stream(e, 7), out, scratch_path(v.spark), on_disk=True)
    return rounded(out.rows().withColumn("as_of", F.expr("cast(as_of AS timestamp_ntz)")).select("customer_id", "as_of", "events", "visits", "purchases", "revenue"), default=3)


# ---- queue -------------------------------------------------------------
_BUDGET, _SLOTS = 250_000.50, 6
_COST = "CASE i WHEN 'low' THEN 2000.25 WHEN 'mid' THEN 3000.40 ELSE 4500.99 END + (customer_id % 7) * 100.10"
_PROFIT = "(customer_id % 11) * 500 + CASE i WHEN 'low' THEN 1000 WHEN 'mid' THEN 1800 ELSE 2500 END"


def _scaled(x: str) -> str:
    return f"CASE WHEN max({x}) OVER k - min({x}) OVER k < 1e-12 THEN 0 ELSE ({x} - min({x}) OVER k) / (max({x}) OVER k - min({x}) OVER k) END"


@query("stream_action_queue", f"""WITH RECURSIVE {_PE_SEEDED},
lt AS (SELECT date_trunc('week', "timestamp") AS wk, customer_id, max("timestamp") AS ts, arg_max(event_id, (epoch_us("timestamp"), event_id)) AS event_id FROM tr WHERE why <> '' GROUP BY 1, 2),
wn AS (SELECT wk, row_number() OVER (ORDER BY wk) - 1 AS batch_id FROM (SELECT DISTINCT date_trunc('week', "timestamp") AS wk FROM e_events)),
sq AS MATERIALIZED (SELECT lt.*, batch_id, CAST(ts AS DATE) AS d, row_number() OVER (ORDER BY wk, ts, event_id, customer_id) AS rn FROM lt JOIN wn USING (wk)),
o AS (SELECT customer_id, i, CASE i WHEN 'low' THEN 1 WHEN 'mid' THEN 2 ELSE 4 END AS bit, CAST({_COST} AS DOUBLE) AS cost, CAST({_PROFIT} AS DOUBLE) AS pf FROM (SELECT DISTINCT customer_id FROM e_events), (SELECT unnest(['low', 'mid', 'high']) AS i)),
om AS (SELECT *, pf / cost AS roi FROM o, (SELECT unnest(range(7)) AS mask) WHERE mask & bit = 0),
op AS (SELECT *, 0.34 * {_scaled('pf')} + 0.28 * {_scaled('roi')} AS ap FROM om WINDOW k AS (PARTITION BY customer_id, mask)),
rk AS MATERIALIZED (SELECT customer_id, mask, list({{'i': i, 'bit': bit, 'cost': cost, 'c': round(cost * 100)::BIGINT}} ORDER BY ap DESC, pf DESC, roi DESC, cost, i) AS opts FROM op GROUP BY 1, 2),
walk AS (
  SELECT 0::BIGINT AS rn, NULL::BIGINT AS batch_id, NULL::DATE AS d, 0 AS dn, 0::BIGINT AS spent, 0::BIGINT AS back, MAP([0::BIGINT], [0::BIGINT]) AS used, MAP([0::BIGINT], [0::BIGINT]) AS opn, 0::BIGINT AS customer_id, 0::BIGINT AS event_id, '' AS status, '' AS i, 0::DOUBLE AS cost
  UNION ALL
  SELECT rn, batch_id, d, n + (status = 'queued')::INTEGER, sp + CASE WHEN status = 'queued' THEN pick.c ELSE 0 END, bk + had, map_concat(used, MAP([customer_id], [mask | CASE WHEN status = 'queued' THEN pick.bit ELSE 0 END])),
    map_concat(opn, MAP([customer_id], [CASE WHEN status = 'queued' THEN pick.c ELSE 0 END])), customer_id, event_id, status, CASE status WHEN 'hold' THEN NULL WHEN 'queued' THEN pick.i ELSE opts[1].i END, CASE status WHEN 'hold' THEN 0 WHEN 'queued' THEN pick.cost ELSE opts[1].cost END
  FROM (SELECT *, CASE WHEN opts IS NULL THEN 'hold' WHEN free <= 0 THEN 'deferred_budget_guardrail' WHEN n >= {_SLOTS} THEN 'deferred_channel_guardrail' WHEN pick IS NULL THEN 'deferred_budget_guardrail' ELSE 'queued' END AS status
    FROM (SELECT x.*, opts, {round(_BUDGET * 100)} - sp AS free, list_filter(opts, lambda z: z.c <= {round(_BUDGET * 100)} - sp)[1] AS pick
      FROM (SELECT q.rn, q.batch_id, q.d, q.customer_id, q.event_id, w.used, w.opn, CASE WHEN w.batch_id = q.batch_id THEN w.spent ELSE w.spent - w.back END AS sp, CASE WHEN w.batch_id = q.batch_id THEN w.back ELSE 0 END AS bk,
              CASE WHEN w.d = q.d THEN w.dn ELSE 0 END AS n, coalesce(w.used[q.customer_id], 0) AS mask, coalesce(w.opn[q.customer_id], 0) AS had FROM walk w JOIN sq q ON q.rn = w.rn + 1) x LEFT JOIN rk ON rk.customer_id = x.customer_id AND rk.mask = x.mask)))
SELECT customer_id, event_id, i AS intervention_intensity, round(cost, 2) AS coupon_cost, status AS action_queue_status, batch_id FROM walk WHERE rn > 0""")
def _(v):
    """Stream to queue: scored events, triggers, candidates, one ledger in cents over all batches."""
    people = v.live_events().select("customer_id").distinct()
    offers = people.selectExpr("customer_id", "explode(array('low', 'mid', 'high')) AS i").selectExpr("customer_id", "i AS intervention_intensity", f"cast({_COST} AS double) AS coupon_cost", f"cast({_PROFIT} AS double) AS expected_incremental_profit")
    offers = cut_lineage(offers.selectExpr("*", "expected_incremental_profit / coupon_cost AS expected_roi", "0D AS timing_urgency_score"))
    led = sl.QueueLedger(v.spark, scratch_path(v.spark), offers, budget=_BUDGET, daily_capacity=_SLOTS, folders=8)
    base = cut_lineage(people.selectExpr("customer_id", "0.25D + 0.06D * (customer_id % 10) AS churn_probability"))
    ss.replay(st.scored_stream(ss.event_stream(v.spark, _write_stream(v), files_per_trigger=_FILES, watermark="40 days"), base), led, scratch_path(v.spark))
    return rounded(led.queue().select("customer_id", "event_id", "intervention_intensity", "coupon_cost", "action_queue_status", F.col("batch_id").cast("long").alias("batch_id")), default=2)


# ---- serving -----------------------------------------------------------
_CUM = """pt AS (SELECT customer_id, {part} AS p, count(*) AS n, count(*) FILTER (event_type = 'visit') AS v, count(*) FILTER (event_type = 'support_contact') AS s, coalesce(sum(amount) FILTER (event_type = 'purchase'), 0) AS r FROM e_events GROUP BY 1, 2),
cu AS (SELECT customer_id, p, (sum(n) OVER u)::DOUBLE AS n, (sum(v) OVER u)::DOUBLE AS v, (sum(s) OVER u)::DOUBLE AS s, sum(r) OVER u AS r FROM pt WINDOW u AS (PARTITION BY customer_id ORDER BY p))"""
_BAND = "CASE WHEN cs >= 0.85 THEN 'critical' WHEN cs >= 0.70 THEN 'high' WHEN cs >= 0.50 THEN 'medium' ELSE 'low' END"


@query("stream_serving_tables", f"""WITH {_CUM.format(part="date_trunc('week', \"timestamp\")")}, k AS (SELECT customer_id, 0.3 + 0.6 * (customer_id % 10) / 10.0 AS cs, 1000.0 + customer_id AS cv FROM (SELECT DISTINCT customer_id FROM e_events) WHERE customer_id % 3 > 0),
f AS (SELECT customer_id, max(n) AS total, coalesce(max(p) FILTER (n < 5), min(p)) AS p FROM cu GROUP BY 1),
c AS (SELECT customer_id, total, least(greatest(0.60 - 0.06 * n, 0.15), 0.70) AS cs, CASE WHEN r > 0 THEN r * 6 ELSE 50000 END AS cv FROM f JOIN cu USING (customer_id, p)),
j AS (SELECT c.customer_id, total, k.customer_id IS NULL AND total < 5 AS cold, coalesce(k.cs, c.cs) AS cs, coalesce(k.cv, c.cv) AS cv FROM c LEFT JOIN k USING (customer_id))
SELECT customer_id, total::BIGINT AS event_count_total, round(cs, 6)::DOUBLE AS churn_score, round(cv, 3)::DOUBLE AS clv, CASE WHEN cold THEN 'new' ELSE {_BAND} END AS risk_segment FROM j""")
def _(v):
    """Known customers keep their scores over all batches of the counter stream; the others keep what the formula gave them last while they were cold, or first."""
    known = v.live_events().select("customer_id").distinct().where("customer_id % 3 > 0").selectExpr("customer_id", "0.3D + 0.6D * (customer_id % 10) / 10D AS churn_score", "1000D + customer_id AS clv", "0.05D AS uplift_score")
    tables = ServingTables(v.spark, scratch_path(v.spark), cut_lineage(known), folders=8)
    ss.replay(st.counter_stream(ss.event_stream(v.spark, _write_stream(v), files_per_trigger=_FILES, watermark="40 days")), tables, scratch_path(v.spark), mode="update")
    return rounded(tables.latest().select("customer_id", "event_count_total", "churn_score", "clv", "risk_segment"), {"clv": 3})


@query("stream_warm_scores", f"""WITH {_CUM.format(part="date_diff('day', (SELECT min(\"timestamp\") FROM e_events)::DATE, \"timestamp\"::DATE) // 3")},
j AS (SELECT *, CASE WHEN n < 5 THEN least(greatest(0.60 - 0.06 * n, 0.15), 0.70) ELSE 0.2 + 0.004 * v + 0.006 * s END AS cs, CASE WHEN n < 5 THEN CASE WHEN r > 0 THEN r * 6 ELSE 50000 END ELSE 100 + 2 * n + 3 * v END AS cv, CASE WHEN n < 5 THEN 0.12 ELSE 0.05 + 0.001 * s END AS cu FROM cu)
SELECT customer_id, p AS batch_id, n::BIGINT AS event_count_total, round(cs, 6)::DOUBLE AS churn_score, round(cv, 3)::DOUBLE AS clv, round(cu, 6)::DOUBLE AS uplift_score, CASE WHEN n < 5 THEN 'new' ELSE {_BAND} END AS risk_segment FROM j""")
def _(v):
    """Every batch's rows: a saved pipeline, fitted on the month's counters, scores warm customers, the formula cold ones."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    counts = lv.feature_state_counters(v.live_events())
    taught = counts.selectExpr("*", "0.2D + 0.004D * visit_count + 0.006D * support_contact_count AS y_churn", "100D + 2D * event_count_total + 3D * visit_count AS y_clv", "0.05D + 0.001D * support_contact_count AS y_uplift")
    names = {"churn_score": "y_churn", "clv": "y_clv", "uplift_score": "y_uplift"}
    stages = [VectorAssembler(inputCols=["visit_count", "support_contact_count", "event_count_total"], outputCol="features")]
    stages += [LinearRegression(labelCol=y, predictionCol=p, featuresCol="features", solver="normal") for p, y in names.items()]
    path = scratch_path(v.spark)
    Pipeline(stages=stages).fit(cut_lineage(taught)).write().save(path)
    first = v.live_events().agg(F.to_date(F.min("timestamp"))).first()[0]
    src = _written(v.live_events().selectExpr("event_id", "customer_id", "cast(timestamp AS timestamp) AS timestamp", "event_type", "amount", f"cast(datediff(timestamp, date'{first}') / 3 AS int) AS _part"), "_part")
    nobody = v.spark.createDataFrame([], "customer_id bigint, churn_score double, clv double, uplift_score double")
    tables = ServingTables(v.spark, scratch_path(v.spark), nobody, warm_model=path, folders=8)
    ss.replay(st.counter_stream(ss.event_stream(v.spark, src, files_per_trigger=_FILES, watermark="40 days")), tables, scratch_path(v.spark), mode="update")
    return rounded(tables.history().select("customer_id", F.col("batch_id").cast("long").alias("batch_id"), "event_count_total", "churn_score", "clv", "uplift_score", "risk_segment"), {"clv": 3})
