"""Live customer state: decayed signals, scores, triggers, action policy and serving views.

Everything here works on batch and streaming frames alike; the streaming package
feeds the same functions micro-batch by micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.expr import add, bound, chain, first_rows
from ..functions.ordered import cut_lineage, previous_row, running_totals
from . import budget as bu

KEY = "customer_id"
# Signal, event type, half-life in hours, weight in the live score.
SIGNALS = (
    ("visit_signal", "visit", 18, -0.09),
    ("browse_signal", "browse", 18, -0.04),
    ("search_signal", "search", 18, -0.05),
    ("cart_signal", "add_to_cart", 24, -0.07),
    ("cart_remove_signal", "remove_from_cart", 36, 0.06),
    ("purchase_signal", "purchase", 72, -0.16),
    ("support_signal", "support_contact", 72, 0.13),
    ("coupon_open_signal", "coupon_open", 36, -0.05),
    ("coupon_redeem_signal", "coupon_redeem", 96, -0.12),
)
SIGNAL_NAMES = tuple(s for s, *_ in SIGNALS)
COUNTERS = ("visit", "page_view", "search", "add_to_cart", "purchase", "support_contact", "coupon_open", "coupon_redeem")


# ---- signals and score ------------------------------------------------
def decayed_signals(events: DataFrame, at: str | None = None) -> DataFrame:
    """State at each customer's last event (or at a given time): sum of 0.5 ^ (age / half-life). Plain aggregates."""
    last = events.groupBy(KEY).agg(F.max("timestamp").alias("last_event_at"), F.count(F.lit(1)).alias("total_events_seen"))
    now = f"timestamp_ntz'{at}'" if at else "last_event_at"
    age = f"((unix_micros(cast({now} AS timestamp)) - unix_micros(cast(timestamp AS timestamp))) / 3600000000D)"
    sums = events.join(last.select(KEY, "last_event_at"), KEY).groupBy(KEY).agg(*[
        F.expr(f"coalesce(sum(pow(0.5D, {age} / {h})) FILTER (WHERE event_type = '{t}'), 0D) AS {s}") for s, t, h, _ in SIGNALS])
    idle = "0D" if at is None else f"greatest((unix_micros(cast({now} AS timestamp)) - unix_micros(cast(last_event_at AS timestamp))) / 86400000000D, 0D)"
    return last.join(sums, KEY).withColumn("days_since_last_event", F.expr(idle))


def live_score(states: DataFrame, base: str = "0.5D") -> DataFrame:
    """Base probability moved by inactivity and the signals."""
    risk = " ".join(f"{'+' if w > 0 else '-'} {abs(w)} * {s}" for s, _, _, w in SIGNALS)
    return chain(states, inactivity_signal="1 / (1 + exp(-(days_since_last_event - 7) / 3))", behavioral_risk=f"0.22 * inactivity_signal {risk}",
                 realtime_churn_score=bound(f"{base} + behavioral_risk", 0.001, 0.999), score_delta=f"realtime_churn_score - {base}")


#: Days of one stretch of history: weights grow from its start, which no half-life of hours can overflow in that time.
STRETCH_DAYS = 300


def states_per_event(events: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Signals right after every event, as running sums per customer cut by day, for histories of any length.

    Weights are counted from the start of a stretch of calendar days.  What the stretch
    before left behind is carried over its end; what is older has shrunk below 1e-20 by then.
    """
    hours = "unix_micros(cast(timestamp AS timestamp)) / 3600000000D"
    e = events.select(KEY, event_id, "timestamp", "event_type").withColumns({
        "_stretch": F.expr(f"cast(floor({hours} / {24 * STRETCH_DAYS}) AS bigint)"), "_day": F.to_date("timestamp")}).withColumn("_h", F.expr(f"{hours} - _stretch * {24 * STRETCH_DAYS}D"))
    grown = {s: f"CASE WHEN event_type = '{t}' THEN pow(2D, _h / {h}) ELSE 0D END" for s, t, h, _ in SIGNALS}
    r = running_totals(e, [("timestamp", True), (event_id, True)], {f"_{s}": F.expr(x) for s, x in grown.items()}, by=[KEY, "_stretch"], range_col="_day")
    left = e.groupBy(KEY, F.expr("_stretch + 1").alias("_stretch")).agg(*[F.expr(f"sum({x}) * pow(2D, -{24 * STRETCH_DAYS}D / {h})").alias(f"_c_{s}") for (s, x), (_, _, h, _) in zip(grown.items(), SIGNALS)])
    return r.join(left, [KEY, "_stretch"], "left").selectExpr(
        KEY, event_id, "timestamp", "event_type", "_day", *[f"(_{s} + coalesce(_c_{s}, 0D)) * pow(2D, -_h / {h}) AS {s}" for s, _, h, _ in SIGNALS], "0D AS days_since_last_event")


def reoptimize_triggers(scored: DataFrame, *, high: float = 0.80, customer: float = 0.65, jump: float = 0.12) -> DataFrame:
    """Reasons to look at a customer again; needs prev_score, realtime_churn_score, signals and event_type."""
    s, p = "realtime_churn_score", "prev_score"
    reasons = (
        (f"{s} >= {high} AND {p} < {high}", "'critical_risk_cross'"),
        (f"{s} >= {customer} AND {p} < {customer}", "'risk_threshold_cross'"),
        (f"{s} - {p} >= {jump}", "'score_spike'"),
        (f"event_type IN ('remove_from_cart', 'support_contact') AND {s} >= {customer}", "concat(event_type, '_event')"),
        ("support_signal >= 0.85 AND cart_remove_signal >= 0.85 AND purchase_signal <= 0.15", "'support_and_cart_remove_without_purchase'"),
        (f"inactivity_signal >= 0.75 AND purchase_signal <= 0.10 AND {s} >= {customer}", "'extended_inactivity'"),
    )
    arr = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in reasons)
    return add(scored, trigger_reason=f"concat_ws(', ', filter(array({arr}), x -> x IS NOT NULL))")


def scored_events(events: DataFrame, base: DataFrame | None = None, event_id: str = "event_id") -> DataFrame:
    """Every event with the score before and after it and its trigger reasons: the batch form of the stream."""
    st = states_per_event(events, event_id)
    b = "0.5D"
    if base is not None:
        st = st.join(base.selectExpr(KEY, "least(greatest(churn_probability, 0.001), 0.999) AS _base"), KEY, "left")
        b = "coalesce(_base, 0.5D)"
    sc = live_score(st, b).withColumn("base_churn_probability", F.expr(b))
    sc = previous_row(sc, [KEY], [("timestamp", True), (event_id, True)], ["realtime_churn_score"], "_day")
    sc = sc.withColumn("prev_score", F.expr("coalesce(prev_realtime_churn_score, base_churn_probability)"))
    return reoptimize_triggers(sc).drop("_day", "prev_realtime_churn_score", *(["_base"] if base is not None else []))


#: Days of silence from which ``extended_inactivity`` can hold (its signal reaches 0.75 after 10.3 days), and until which a silent customer is watched: every signal is worn off by then.
IDLE_DAYS, KEPT_DAYS = 11, 130


def _settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed once per row: a generator keeps later steps from being computed by the same expressions again."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


#: Days that are ruled out at once where no score between them can reach the threshold.
LOOK_DAYS = 6


def silent_customers(events: DataFrame, until: str, base: DataFrame | None = None, event_id: str = "event_id") -> DataFrame:
    """Silences that call for attention: for each event followed by no other in time, the first whole day on which ``extended_inactivity`` holds.

    Silences end with the next event; what is open ends at ``until`` (SQL text of a
    timestamp).  Signals and inactivity are those of that day, ``prev_score`` is the score
    after the event.  The batch form of the stream's timers.  A silence begins with the last
    event of a day and ends with the first of another, so sums per customer and day are
    enough.  Events without customer or time are left out.
    """
    micros = "unix_micros(cast(timestamp AS timestamp))"
    e = events.where(f"{KEY} IS NOT NULL AND timestamp IS NOT NULL").select(KEY, "timestamp", "event_type", F.expr(f"cast(floor({micros} / 86400000000D) AS bigint) AS _day")).withColumn("_stretch", F.expr(f"cast(floor(_day / {STRETCH_DAYS}) AS bigint)"))
    hours = f"({micros} / 3600000000D - _stretch * {24 * STRETCH_DAYS}D)"
    days = e.groupBy(KEY, "_stretch", "_day").agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("timestamp"), *[F.expr(f"sum(CASE WHEN event_type = '{t}' THEN pow(2D, {hours} / {h}) ELSE 0D END) AS _x_{s}") for s, t, h, _ in SIGNALS])
    # a customer's days in order: one sort serves the next day, the sums of a stretch and what the stretch before left
    person, stretch = W.partitionBy(KEY).orderBy("_stretch", "_day"), W.partitionBy(KEY, "_stretch").orderBy("_stretch", "_day")
    summed = days.select(KEY, "_stretch", "_day", "timestamp", F.lead("_first").over(person).alias("_next"), *[F.sum(f"_x_{s}").over(stretch.rowsBetween(W.unboundedPreceding, 0)).alias(f"_{s}") for s in SIGNAL_NAMES])
    before = F.lag(F.struct("_stretch", *[f"_{s}" for s in SIGNAL_NAMES])).over(person)
    carried = summed.withColumn("_before", before).withColumn("_before", F.first("_before").over(stretch.rowsBetween(W.unboundedPreceding, 0)))
    long = carried.where(f"_next IS NULL OR _next > timestamp + make_dt_interval({IDLE_DAYS})")
    left = lambda s, h: f"CASE WHEN _before._stretch = _stretch - 1 THEN _before._{s} * pow(2D, -{24 * STRETCH_DAYS}D / {h}) ELSE 0D END"
    b = "0.5D"
    if base is not None:
        long = long.join(base.groupBy(KEY).agg(F.min("churn_probability").alias("_p")).selectExpr(KEY, "least(greatest(_p, 0.001), 0.999) AS _base"), KEY, "left")
        b = "coalesce(_base, 0.5D)"
    now = long.selectExpr(KEY, "timestamp", "_next", f"{b} AS base_churn_probability", "0D AS days_since_last_event", *[f"(_{s} + {left(s, h)}) * pow(2D, -{hours} / {h}) AS {s}" for s, _, h, _ in SIGNALS],
                          f"cast(least({KEPT_DAYS - 1}, (unix_micros(cast(coalesce(_next, {until}) AS timestamp)) - {micros}) div 86400000000 + 1) AS int) AS _end")
    now = _settled(live_score(now, "base_churn_probability").drop("days_since_last_event"))
    worn_by = lambda k, up: " ".join(f"{'+' if w > 0 else '-'} {abs(w)} * {s} * pow(0.5D, {k} * 24 / {h}D)" for s, _, h, w in SIGNALS if up is None or (w > 0) == up)
    # over days a to z the score is at most that with the inactivity and the wear of what lowers it of z, and the wear of what raises it of a
    may = lambda a, z: f"(purchase_signal * pow(0.5D, {z} * 24 / 72D) <= 0.10 + 1e-9 AND base_churn_probability + 0.22 / (1 + exp(-({z} - 7) / 3D)) {worn_by(a, True)} {worn_by(z, False)} >= 0.65 - 1e-9)"
    day = "make_dt_interval(k)"
    ends = f"(_next IS NOT NULL AND timestamp + {day} < _next OR _next IS NULL AND timestamp + {day} <= {until})"
    holds = f"purchase_signal * pow(0.5D, k * 24 / 72D) <= 0.10 AND least(greatest(base_churn_probability + 0.22 / (1 + exp(-(k - 7) / 3D)) {worn_by('k', None)}, 0.001), 0.999) >= 0.65"
    a, z = f"({IDLE_DAYS} + {LOOK_DAYS} * j)", f"least({IDLE_DAYS + LOOK_DAYS - 1} + {LOOK_DAYS} * j, _end)"
    looked = f"aggregate(sequence(0, cast((_end - {IDLE_DAYS}) div {LOOK_DAYS} AS int)), cast(NULL AS int), (hit, j) -> CASE WHEN hit IS NOT NULL THEN hit WHEN {may(a, z)} THEN array_min(transform(sequence({a}, {z}), k -> CASE WHEN {holds} THEN k END)) END)"
    first = _settled(add(now.where(f"_end >= {IDLE_DAYS}").where(may(IDLE_DAYS, "_end")), days_since_last_event=looked))
    hit = first.where("days_since_last_event IS NOT NULL").where(ends.replace("k)", "days_since_last_event)"))
    worn = hit.selectExpr(KEY, f"timestamp + {day.replace('(k)', '(days_since_last_event)')} AS timestamp", "'inactivity' AS event_type", "cast(days_since_last_event AS double) AS days_since_last_event", "realtime_churn_score AS prev_score",
                          "base_churn_probability", *[f"{s} * pow(0.5D, days_since_last_event * 24 / {h}D) AS {s}" for s, _, h, _ in SIGNALS])
    return reoptimize_triggers(live_score(worn, "base_churn_probability"))


def trigger_actions(triggers: DataFrame, candidates: DataFrame, *, used: DataFrame | None = None) -> DataFrame:
    """Actions each triggered customer may still get, with their priority. A group is one customer's few intensities."""
    t = triggers.groupBy(KEY).agg(F.expr("max_by(struct(realtime_churn_score, timestamp, event_id, trigger_reason), struct(timestamp, event_id)) AS t")).select(KEY, "t.*")
    c = candidates.where("coupon_cost > 0 AND expected_incremental_profit > 0")
    if used is not None:
        c = c.join(used.select(KEY, "intervention_intensity"), [KEY, "intervention_intensity"], "left_anti")
    lim = c.groupBy(KEY).agg(*[F.expr(x) for x in ("min(expected_incremental_profit) AS _p0", "max(expected_incremental_profit) AS _p1",
                                                    "min(greatest(expected_roi, 0D)) AS _r0", "max(greatest(expected_roi, 0D)) AS _r1")])
    n = lambda x, a, b: f"CASE WHEN {b} - {a} < 1e-12 THEN 0D ELSE ({x} - {a}) / nullif({b} - {a}, 0D) END"
    j = t.join(c.select(KEY, "intervention_intensity", "coupon_cost", "expected_incremental_profit", "expected_roi", "timing_urgency_score"), KEY).join(lim, KEY)
    return j.withColumn("action_priority", F.expr(
        f"0.34 * {n('expected_incremental_profit', '_p0', '_p1')} + 0.28 * {n('greatest(expected_roi, 0D)', '_r0', '_r1')} "
        "+ 0.23 * least(greatest(timing_urgency_score, 0D), 1D) + 0.15 * realtime_churn_score")).drop("_p0", "_p1", "_r0", "_r1")


def held_triggers(triggers: DataFrame, candidates: DataFrame, *, used: DataFrame | None = None) -> DataFrame:
    """Triggered customers without an action left, with status ``hold`` and why: no profitable action at all, or each one used before."""
    t = triggers.groupBy(KEY).agg(F.expr("max_by(struct(timestamp, event_id), struct(timestamp, event_id)) AS t")).select(KEY, "t.*")
    c = candidates.where("coupon_cost > 0 AND expected_incremental_profit > 0").select(KEY, "intervention_intensity")
    free = c if used is None else c.join(used.select(KEY, "intervention_intensity"), [KEY, "intervention_intensity"], "left_anti")
    known = c.select(KEY).distinct().withColumn("_known", F.lit(True))
    idle = t.join(free.select(KEY).distinct(), KEY, "left_anti").join(known, KEY, "left")
    return idle.selectExpr(KEY, "event_id", "timestamp", "CASE WHEN _known THEN 'all_intensities_already_used' ELSE 'candidate_actions_missing' END AS trigger_reason",
                           "cast(NULL AS string) AS intervention_intensity", "0D AS coupon_cost", "0D AS expected_incremental_profit", "0D AS action_priority", "'hold' AS action_queue_status")


#: Triggers in event order; of one trigger the best action: priority, profit, return, cost, then name.
QUEUE_ORDER = [("_time", True), ("event_id", True), ("action_priority", False), ("expected_incremental_profit", False), ("expected_roi", False), ("coupon_cost", True), ("intervention_intensity", True)]
_BEST = "struct(-action_priority, -expected_incremental_profit, -expected_roi, coupon_cost, intervention_intensity)"


def queue_under_ledger(actions: DataFrame, *, remaining_budget: int, remaining_capacity: int) -> DataFrame:
    """Walks the triggers in event order: first affordable action each, until budget or channel capacity is used up.

    A customer not served is deferred by the limit met at its own place in the walk: the
    budget if nothing of it was left or no action was affordable, the channel if all its
    slots were taken.
    """
    a = actions.withColumn("_time", F.expr("unix_micros(cast(timestamp AS timestamp))"))
    cols = [KEY, "event_id", "timestamp", "trigger_reason", "intervention_intensity", "coupon_cost", "expected_incremental_profit", "action_priority"]
    best = a.groupBy(KEY).agg(F.expr(f"min_by(struct({', '.join(cols[1:])}), {_BEST}) AS b")).select(KEY, "b.*")
    if remaining_budget <= 0 or remaining_capacity <= 0:
        return best.withColumn("action_queue_status", F.lit("deferred_budget_guardrail" if remaining_budget <= 0 else "deferred_channel_guardrail"))
    got = bu.greedy_select(a, QUEUE_ORDER, {"ledger": remaining_budget}, max_customers=remaining_capacity, high_share=None)
    got = cut_lineage(got.selectExpr(*cols, "'queued' AS action_queue_status"))
    end = got.agg(F.count(F.lit(1)).alias("n"), F.sum("coupon_cost").alias("s"), F.expr("max(struct(unix_micros(cast(timestamp AS timestamp)) AS t, event_id AS e))").alias("last"))
    late = best.join(got.select(KEY), KEY, "left_anti").crossJoin(F.broadcast(end))  # one row
    after = "struct(unix_micros(cast(timestamp AS timestamp)) AS t, event_id AS e) > last"
    late = late.withColumn("action_queue_status", F.expr(f"CASE WHEN {after} AND s < {remaining_budget} AND n >= {remaining_capacity} THEN 'deferred_channel_guardrail' ELSE 'deferred_budget_guardrail' END"))
    return got.unionByName(late.select(*cols, "action_queue_status"))


#: Actions left behind a budget's stop that are walked one by one instead of in further rounds.
WALK_ROWS = 20_000


def _first_affordable(rows, left: int, slots: dict, capacity: int) -> list[int]:
    """The plain walk over few actions: ids of those that are queued."""
    out, served = [], set()
    for r in sorted(rows, key=lambda r: (r["_time"], r["event_id"], r[KEY], tuple(r["_rank"]))):
        if r[KEY] in served or r["_cents"] > left or left <= 0 or slots.get(r["_day"], 0) >= capacity:
            continue
        served.add(r[KEY])
        left -= r["_cents"]
        slots[r["_day"]] = slots.get(r["_day"], 0) + 1
        out.append(r["_rid"])
    return out


def queue_by_day(actions: DataFrame, *, remaining_cents: int, daily_capacity: int, filled: DataFrame | None = None) -> DataFrame:
    """Walks the triggers of many days in event order under one budget in cents and a capacity a day: each takes its first affordable action.

    ``filled`` (``day, n``) are slots taken before.  One round settles all days at once: of
    every customer's best affordable action, the first of each day fill its free slots, and
    running sums of their costs show how far the budget goes.  If it stops, everything
    before the stop is settled, actions dearer than the rest of the budget are gone for
    good, and the next round begins there; few actions left are walked plainly.

    What is not served is deferred by the limit met at its own place in the walk: the budget
    if nothing of it was left, the channel if its day was full, else the budget again, as
    no action was affordable.
    """
    spark = actions.sparkSession
    a = actions.selectExpr("*", "unix_micros(cast(timestamp AS timestamp)) AS _time", "cast(round(coupon_cost * 100) AS bigint) AS _cents", f"{_BEST} AS _rank", "monotonically_increasing_id() AS _rid")
    a = cut_lineage(a.withColumn("_day", F.to_date("timestamp")))
    cols = [KEY, "event_id", "timestamp", "trigger_reason", "intervention_intensity", "coupon_cost", "expected_incremental_profit", "action_priority"]
    here, kinds = F.struct("_time", "event_id", KEY), dict(a.dtypes)
    place = lambda row: F.struct(*[F.lit(row[x]).cast(kinds[x]).alias(x) for x in ("_time", "event_id", KEY)])
    taken = (filled.select(F.col("day").alias("_day"), F.col("n").cast("long").alias("_n")) if filled is not None else spark.createDataFrame([], "_day date, _n bigint"))
    taken, open_, left, picked = cut_lineage(taken), a, remaining_cents, []
    while left > 0 and daily_capacity > 0:
        best = open_.where(F.col("_cents") <= left).groupBy(KEY).agg(F.expr("min_by(struct(_day, _time, event_id, _cents, _rid), _rank) AS b")).select(KEY, "b.*")
        in_day = W.partitionBy("_day").orderBy("_time", "event_id", KEY)
        fits = best.withColumn("_i", F.row_number().over(in_day)).where(F.col("_i") <= daily_capacity).join(F.broadcast(taken), "_day", "left").where(f"_i <= {daily_capacity} - coalesce(_n, 0)")  # one row a day
        sums = cut_lineage(running_totals(fits.drop("_i", "_n"), [("_time", True), ("event_id", True), (KEY, True)], {"_sum": F.col("_cents")}))
        stop = sums.agg(F.min(F.when(F.col("_sum") > left, here))).first()[0]
        got = sums if stop is None else sums.where(here < place(stop))
        got = cut_lineage(got.select("_rid", "_day", "_cents"))
        picked.append(got.select("_rid"))
        left -= got.agg(F.sum("_cents")).first()[0] or 0
        if stop is None:
            break
        taken = cut_lineage(taken.unionByName(got.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))).groupBy("_day").agg(F.sum("_n").alias("_n")))
        open_ = cut_lineage(open_.where((here >= place(stop)) & (F.col("_cents") <= left)))
        if open_.count() <= WALK_ROWS:
            slots = {r["_day"]: r["_n"] for r in taken.join(open_.select("_day").distinct(), "_day", "left_semi").collect()}
            rest = _first_affordable(open_.select(KEY, "event_id", "_time", "_day", "_cents", "_rank", "_rid").collect(), left, slots, daily_capacity)
            picked.append(spark.createDataFrame([(x,) for x in rest], "_rid bigint"))
            break
    ids = picked[0] if picked else spark.createDataFrame([], "_rid bigint")
    for p in picked[1:]:
        ids = ids.unionByName(p)
    got = cut_lineage(a.join(ids, "_rid", "left_semi").select(*cols, "_day", "_time", "_cents"))
    ends = got.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"), F.max(here).alias("_last"))
    before = cut_lineage(filled.select(F.col("day").alias("_day"), F.col("n").alias("_before"))) if filled is not None else spark.createDataFrame([], "_day date, _before bigint")
    days = ends.join(before, "_day", "full").selectExpr("_day", f"coalesce(_n, 0) + coalesce(_before, 0) >= {daily_capacity} AS _full", "_last")
    spent, end = got.agg(F.coalesce(F.sum("_cents"), F.lit(0)), F.max(here)).first()
    late = a.join(got.select(KEY), KEY, "left_anti").groupBy(KEY).agg(F.expr(f"min_by(struct({', '.join(cols[1:])}, _day, _time), _rank) AS b")).select(KEY, "b.*")
    if spent < remaining_cents:
        broke = F.lit(False)
    else:
        broke = here > place(end) if end is not None else F.lit(True)
    full = F.coalesce(F.col("_full") & (F.col("_last").isNull() | (here > F.col("_last"))), F.lit(daily_capacity <= 0))
    late = late.join(F.broadcast(days), "_day", "left").withColumn("action_queue_status", F.when(broke, "deferred_budget_guardrail").when(full, "deferred_channel_guardrail").otherwise("deferred_budget_guardrail"))
    return got.select(*cols).withColumn("action_queue_status", F.lit("queued")).unionByName(late.select(*cols, "action_queue_status"))


def risk_ranking(states: DataFrame, top: int | None = None) -> DataFrame:
    return first_rows(states.orderBy(F.desc("realtime_churn_score"), KEY), top)


def risk_counts(states: DataFrame) -> DataFrame:
    return states.agg(F.count(F.lit(1)).alias("tracked_customers"), F.expr("count_if(realtime_churn_score >= 0.70) AS high_risk_customers"),
                      F.expr("count_if(realtime_churn_score >= 0.85) AS critical_risk_customers"))


def bootstrap_state(summary: DataFrame) -> DataFrame:
    """First state per customer from the summary, one half where no score exists."""
    return summary.selectExpr(KEY, "least(greatest(coalesce(churn_probability, 0.5D), 0.001), 0.999) AS base_churn_probability", *[f"0D AS {s}" for s in SIGNAL_NAMES], "0L AS total_events_seen")


# ---- counters and scores ----------------------------------------------
def feature_state_counters(events: DataFrame) -> DataFrame:
    """Counters per customer. They only grow, also in the stream; see ``sliding_counters`` for true windows."""
    return events.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("event_count_total"), *[F.expr(f"count_if(event_type = '{t}') AS {t}_count") for t in COUNTERS],
        F.expr("coalesce(sum(amount) FILTER (WHERE event_type = 'purchase'), 0D) AS revenue"), F.max("timestamp").alias("last_event_time"), F.min("timestamp").alias("first_event_time"))


def sliding_counters(events: DataFrame, as_of: str) -> DataFrame:
    from ..functions.expr import at, win

    return events.groupBy(KEY).agg(*[F.expr(x) for x in (
        f"count_if({win('timestamp', at(as_of), 7)} AND event_type = 'visit') AS visit_7d", f"count_if({win('timestamp', at(as_of), 30)} AND event_type = 'purchase') AS purchase_30d",
        f"coalesce(sum(amount) FILTER (WHERE {win('timestamp', at(as_of), 30)} AND event_type = 'purchase'), 0D) AS revenue_30d")])


def risk_band(s: str) -> str:
    return f"CASE WHEN {s} >= 0.85 THEN 'critical' WHEN {s} >= 0.70 THEN 'high' WHEN {s} >= 0.50 THEN 'medium' ELSE 'low' END"


def cold_scores(states: DataFrame) -> DataFrame:
    """Closed-form scores for customers without history; they turn warm at five events."""
    out = states.selectExpr(
        KEY, "event_count_total", "revenue", bound("0.60D - 0.06D * greatest(event_count_total, 1)", 0.15, 0.70) + " AS churn_score",
        "CASE WHEN revenue > 0 THEN revenue * 6 ELSE 50000D END AS clv", "0.12D AS uplift_score", "event_count_total >= 5 AS leaves_cold", "'new' AS risk_segment")
    return out.withColumn("expected_incremental_profit", F.expr("clv * uplift_score"))


#: Fixed value: events after which a new customer is scored like the others.
WARM_EVENTS = 5


def score_changed(changed: DataFrame, states: DataFrame, existing: DataFrame, warm: DataFrame | None = None, costs: DataFrame | None = None) -> DataFrame:
    """New scores of changed customers only.

    A customer without a score, or with one of a new customer, is cold until five events
    and gets the closed formula; the others get the model's values, else the earlier ones,
    else the formula.  ``existing`` tells new customers by ``risk_segment``, if it has one.
    """
    st = states.join(changed.select(KEY).distinct(), KEY, "left_semi")
    cold = cold_scores(st).select(KEY, F.col("churn_score").alias("_c"), F.col("clv").alias("_v"), F.col("uplift_score").alias("_u"))
    was_new = F.expr("coalesce(risk_segment = 'new', false)") if "risk_segment" in existing.columns else F.lit(False)
    old = existing.select(KEY, F.col("churn_score").alias("_oc"), F.col("clv").alias("_ov"), F.col("uplift_score").alias("_ou"), was_new.alias("_was_new"))
    j = st.join(old, KEY, "left").join(cold, KEY, "left").withColumn("_cold", F.expr(f"coalesce(_was_new, true) AND event_count_total < {WARM_EVENTS}"))
    if warm is not None:
        j = j.join(warm.select(KEY, F.col("churn_score").alias("_wc"), F.col("clv").alias("_wv"), F.col("uplift_score").alias("_wu")), KEY, "left")
    w = (lambda x: f"_w{x}") if warm is not None else (lambda x: "NULL")
    pick = lambda x: f"CASE WHEN _cold THEN _{x} ELSE coalesce({w(x)}, _o{x}, _{x}) END"
    out = chain(j, churn_score=pick("c"), clv=pick("v"), uplift_score=pick("u"), expected_incremental_profit="clv * uplift_score",
                risk_segment=f"CASE WHEN _cold THEN 'new' ELSE {risk_band('churn_score')} END")
    if costs is not None:
        out = out.join(costs.select(KEY, F.col("coupon_cost").alias("_k")), KEY, "left").withColumn("expected_roi", F.expr("CASE WHEN _k > 0 THEN expected_incremental_profit / _k END"))
    return out.select(*[c for c in out.columns if not c.startswith("_")])


# ---- policy -----------------------------------------------------------
# Unit cost by category and multiplier by intensity.
BASE_COST = {"benefit": 7000, "coupon": 7000, "crm": 12000, "message": 1500, "upsell": 4000, "monitoring": 0}
COST_MULTIPLIER = {"none": 0.0, "low": 0.70, "medium": 1.00, "mid": 1.00, "high": 1.65}


def live_policy(scores: DataFrame, *, threshold: float = 0.5, min_roi: float = 0.0, min_profit: float = 0.0) -> DataFrame:
    """Action, category, intensity, cost, priority and whether to queue it."""
    c, u, r, k = "coalesce(churn_score, 0D)", "coalesce(uplift_score, 0D)", "coalesce(expected_roi, 0D)", "lower(coalesce(risk_segment, ''))"
    crit, high, mid = f"({c} >= 0.85 OR {k} = 'critical')", f"({c} >= 0.70 OR {k} = 'high')", f"({c} >= 0.50 OR {k} = 'medium')"
    act = (f"CASE WHEN {crit} THEN CASE WHEN {u} >= 0.03 AND {r} >= 1.0 THEN struct('high_value_retention_benefit' AS a, 'benefit' AS c, 'high' AS i) ELSE struct('priority_human_followup' AS a, 'crm' AS c, 'high' AS i) END "
           f"WHEN {high} THEN CASE WHEN {u} >= 0.02 THEN struct('personalized_retention_offer' AS a, 'benefit' AS c, 'medium' AS i) ELSE struct('retention_message' AS a, 'message' AS c, 'medium' AS i) END "
           f"WHEN {mid} THEN struct('light_retention_message' AS a, 'message' AS c, 'low' AS i) "
           f"WHEN {u} >= 0.05 AND {r} >= 1.0 THEN struct('low_risk_upsell_offer' AS a, 'upsell' AS c, 'low' AS i) ELSE struct('monitor_only' AS a, 'monitoring' AS c, 'none' AS i) END")
    case = lambda col, m, d: f"CASE {col} " + " ".join(f"WHEN '{a}' THEN {b}D" for a, b in m.items()) + f" ELSE {d}D END"
    implied = "CASE WHEN expected_incremental_profit IS NOT NULL AND expected_roi > 0 THEN greatest(expected_incremental_profit / expected_roi, 0D) ELSE 0D END"
    return chain(
        scores.withColumn("_a", F.expr(act)), recommended_action="_a.a", recommended_category="_a.c", intervention_intensity="_a.i",
        _cost=f"greatest({case('recommended_category', BASE_COST, 5000)} * {case('intervention_intensity', COST_MULTIPLIER, 1.0)}, {implied})",
        coupon_cost="bround(greatest(CASE WHEN clv > 0 AND recommended_category IN ('coupon', 'crm', 'upsell') THEN least(_cost, greatest(clv * 0.08, 1000D)) ELSE _cost END, 0D), 2)",
        priority_score="coalesce(expected_incremental_profit, greatest(churn_score, 0D) * greatest(clv, 0D) * greatest(uplift_score, 0D), expected_roi, churn_score, 0D)",
        should_queue=f"{c} >= {threshold} AND coalesce(expected_roi, {min_roi}) >= {min_roi} AND coalesce(expected_incremental_profit, {min_profit}) >= {min_profit}",
    ).drop("_a", "_cost")


def refresh_recent(scores: DataFrame, n: int, **kw) -> DataFrame:
    return live_policy(scores.orderBy(F.desc("scored_at"), KEY).limit(n), **kw)


# ---- serving views ----------------------------------------------------
def drift_summary(scores: DataFrame, events: DataFrame) -> DataFrame:
    s = scores.agg(F.count(F.lit(1)).alias("scored_customers"), F.avg("churn_score").alias("avg_churn_score"), F.stddev_samp("churn_score").alias("std_churn_score"),
                   F.expr("count_if(churn_score >= 0.7) AS high_risk_customers"), F.max("scored_at").alias("latest_scored_at"))
    return s.crossJoin(events.agg(F.count(F.lit(1)).alias("event_count"), F.max("timestamp").alias("latest_event_time")))


def live_score_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("risk_segment").agg(F.count(F.lit(1)).alias("customers"), F.avg("churn_score").alias("avg_churn_score"), F.max("scored_at").alias("latest_scored_at"))


def live_health(events: DataFrame, states: DataFrame, scores: DataFrame, queue: DataFrame) -> DataFrame:
    return (events.agg(F.count(F.lit(1)).alias("event_count"), F.max("timestamp").alias("latest_event_time")).crossJoin(states.agg(F.count(F.lit(1)).alias("state_count")))
            .crossJoin(scores.agg(F.count(F.lit(1)).alias("score_count"), F.max("scored_at").alias("latest_scored_at"))).crossJoin(queue.agg(F.expr("count_if(should_queue) AS queued_count"))))


def new_customers(states: DataFrame, scores: DataFrame, limit: int | None = None) -> DataFrame:
    out = states.where("event_count_total < 5 OR is_new_customer").join(scores.select(KEY, "churn_score", "clv", "risk_segment"), KEY, "left")
    return first_rows(out.orderBy(F.desc("last_event_time"), KEY), limit)


def filtered_view(df: DataFrame, *, equals: dict | None = None, newest: str | None = None, priority: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows with the given values, first by priority, then newest; equal ones by the newest event, else by customer."""
    for k, v in (equals or {}).items():
        df = df.where(F.col(k) == v)
    keys = [F.desc(x) for x in (priority, newest) if x]
    return first_rows(df.orderBy(*keys, F.desc("event_id") if "event_id" in df.columns else KEY), limit)


def live_monitor_view(scores: DataFrame, actions: DataFrame) -> DataFrame:
    """Scores with the best action of each customer; customers without one are not queued."""
    best = actions.groupBy(KEY).agg(F.expr("max_by(struct(action_status, recommended_action, intervention_intensity, coupon_cost), struct(priority_score, recommended_action)) AS a"))
    return scores.join(best, KEY, "left").selectExpr(
        KEY, "churn_score AS realtime_churn_score", "coalesce(a.action_status, 'not_queued') AS action_queue_status", "a.recommended_action AS queued_recommended_action",
        "a.intervention_intensity AS queued_intervention_intensity", "coalesce(a.coupon_cost, 0D) AS queued_coupon_cost")


LIVE_ORDER = [("selection_score", False), ("expected_incremental_profit", False), ("coupon_cost", True), (KEY, True)]


def live_candidates(actions: DataFrame, scores: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Queue rows with the newest scores; a missing cost follows from profit and ROI."""
    cols = ("churn_probability", "clv", "uplift_score", "uplift_segment")
    s = scores.select(KEY, *[F.col(c).alias(f"_s_{c}") for c in cols if c in scores.columns])
    j = actions.join(s, KEY, "left")
    j = add(j, **{c: f"coalesce(_s_{c}, {c if c in actions.columns else 'NULL'})" for c in cols if c in scores.columns})
    j = add(j, coupon_cost="CASE WHEN coalesce(coupon_cost, 0D) <= 0 AND expected_incremental_profit > 0 AND expected_roi > 0 THEN expected_incremental_profit / expected_roi ELSE coalesce(coupon_cost, 0D) END",
            selection_score="coalesce(priority_score, expected_incremental_profit, 0D)")
    return j.select(*[c for c in j.columns if not c.startswith("_s_")]).where(
        f"churn_probability >= {threshold} AND coupon_cost > 0 AND expected_incremental_profit > 0 AND coalesce(uplift_segment, '') <> 'Sleeping Dogs'")


def live_budget(actions: DataFrame, scores: DataFrame, budget: int, *, threshold: float = 0.5, max_customers: int | None = None, fallback: DataFrame | None = None) -> DataFrame:
    from . import decisions as de

    c = live_candidates(actions, scores, threshold=threshold)
    if fallback is not None and c.isEmpty():
        return bu.select_under_budget(de.candidate_pool(fallback, threshold=threshold), de.POOL_ORDER, budget, max_customers=max_customers)
    return bu.select_under_budget(c, LIVE_ORDER, budget, max_customers=max_customers)


def seed_serving_tables(artifacts: list[DataFrame], root: str) -> DataFrame:
    """Artifacts merged by customer (left wins) and written as state, score and queue tables."""
    from ..functions.ordered import cut_lineage
    from ..sources.tables import merge_on_customer, write_tables
    from .decisions import _first

    m = cut_lineage(merge_on_customer(artifacts))
    scores = m.selectExpr(KEY, f"{_first(m, ['churn_score', 'churn_probability'])} AS churn_score", f"{_first(m, ['clv', 'predicted_clv_12m'], True)} AS clv",
                          f"{_first(m, ['uplift_score', 'predicted_uplift'])} AS uplift_score", f"{_first(m, ['expected_roi', 'roi'])} AS expected_roi",
                          f"{_first(m, ['expected_incremental_profit', 'expected_profit'])} AS expected_incremental_profit")
    scores = scores.withColumn("risk_segment", F.expr(risk_band("churn_score")))
    queue = live_policy(scores)
    write_tables({"customer_scores": scores, "action_queue": queue.where("should_queue"), "recommendation_candidates": queue}, root)
    return scores
