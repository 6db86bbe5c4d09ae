"""Customer features as of a landmark date.

Every feature of one source comes from one grouped aggregation of that source,
so the full frame needs one pass over events, orders and exposures each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import (
    add, at, count_where, days_between, days_sql, div_null, in_window, ratio_null, ratio_zero, shift_days, ts, whole_days, win,
)
from ..functions.ordered import cut_lineage, exact_quantiles, group_median, previous_row, shared

KEY = "customer_id"
# The event vocabulary, the statuses that mean risk, and types that are no activity.
EVENT_TYPES = ("visit", "page_view", "browse", "search", "add_to_cart", "remove_from_cart", "purchase", "support_contact",
               "refund", "coupon_open", "coupon_redeem", "login", "logout", "other")
RISK_STATUSES = ("churn_risk", "churned", "inactive", "cancelled", "canceled", "unsubscribed")
NO_ACTIVITY_TYPES = ("ignore", "other", "unknown", "nan")


def _at(as_of) -> Column:
    return ts(as_of) if isinstance(as_of, str) else as_of


# ---- windows ----------------------------------------------------------
def window_counts(df: DataFrame, time: str, as_of: str, windows: dict[str, tuple], key: str = KEY) -> DataFrame:
    """windows: name -> (days, days to shift back, event types or None). All windows in one grouping."""
    aggs = []
    for name, (days, back, types) in windows.items():
        cond = win(time, at(as_of), days, back)
        if types:
            cond += " AND event_type IN (" + ", ".join(f"'{t}'" for t in types) + ")"
        aggs.append(F.expr(f"count_if({cond}) AS {name}"))
    return df.groupBy(key).agg(*aggs)


def window_sums(df: DataFrame, time: str, value: str, as_of: str, windows: dict[str, tuple], key: str = KEY) -> DataFrame:
    return df.groupBy(key).agg(*[
        F.expr(f"coalesce(sum({value}) FILTER (WHERE {win(time, at(as_of), days, back)}), 0D) AS {name}")
        for name, (days, back) in windows.items()])


def window_active_days(df: DataFrame, time: str, as_of: str, days: int, out: str, key: str = KEY) -> DataFrame:
    """Distinct dates in the window; the set holds at most days + 1 dates."""
    return df.groupBy(key).agg(F.expr(f"cast(size(collect_set(CASE WHEN {win(time, at(as_of), days)} THEN to_date({time}) END)) AS bigint) AS {out}"))


# ---- per source -------------------------------------------------------
def order_aggregates(as_of: str) -> list[Column]:
    end = at(as_of)
    w = lambda d, b=0: win("order_time", end, d, b)
    upto = f"order_time <= {end}"
    last, first = f"max(order_time) FILTER (WHERE {upto})", f"min(order_time) FILTER (WHERE {upto})"
    return [F.expr(x) for x in (
        f"coalesce({days_sql(last, end)}, 999D) AS recency_days",
        f"count_if({w(30)}) AS frequency_30d",
        f"count_if({w(30, 30)}) AS frequency_prev_30d",
        f"count_if({w(90)}) AS frequency_90d",
        f"coalesce(sum(net_amount) FILTER (WHERE {w(30)}), 0D) AS monetary_30d",
        f"coalesce(sum(net_amount) FILTER (WHERE {w(90)}), 0D) AS monetary_90d",
        f"count_if({w(90)} AND weekday(order_time) >= 5) AS weekend_purchases",
        f"avg(quantity) FILTER (WHERE {upto}) AS avg_items_per_order_90d",
        f"avg(cast(coupon_used AS double)) FILTER (WHERE {upto}) AS orders_with_coupon_ratio_90d",
        f"{days_sql(last, end)} AS current_non_purchase_days",
        # the mean gap is (last - first) / (n - 1): no sort needed
        f"{days_sql(first, last)} / nullif(count_if({upto}) - 1, 0) AS avg_purchase_gap_days",
    )]


# Event windows of the frame as (feature, event type, days, days to shift back).
EVENT_WINDOWS = (
    ("visits_14d", "visit", 14, 0), ("visits_prev_14d", "visit", 14, 14), ("purchases_14d", "purchase", 14, 0),
    ("purchases_prev_14d", "purchase", 14, 14), ("searches_30d", "search", 30, 0), ("searches_prev_30d", "search", 30, 30),
    ("add_to_cart_30d", "add_to_cart", 30, 0), ("add_to_cart_prev_30d", "add_to_cart", 30, 30), ("coupon_open_30d", "coupon_open", 30, 0),
    ("coupon_open_prev_30d", "coupon_open", 30, 30), ("support_contact_30d", "support_contact", 30, 0), ("visits_90d", "visit", 90, 0))


def time_of_day_aggregates(cond: str) -> list[Column]:
    return [F.expr(x) for x in (
        f"count_if({cond} AND hour(timestamp) >= 18) AS evening_events",
        f"count_if({cond} AND hour(timestamp) < 6) AS night_events",
        f"count_if({cond} AND hour(timestamp) >= 9 AND hour(timestamp) < 18) AS workhour_events",
        f"count_if({cond} AND weekday(timestamp) >= 5) AS weekend_events",
        f"count_if({cond}) AS total_events",
        f"cast(size(collect_set(CASE WHEN {cond} THEN event_type END)) AS bigint) AS event_diversity_90d",
    )]


def event_aggregates(as_of: str) -> list[Column]:
    """Counts of the last 90 days, the longest window."""
    end, t = at(as_of), "timestamp"
    return [
        *[F.expr(f"count_if({win(t, end, d, b)} AND event_type = '{k}') AS {n}") for n, k, d, b in EVENT_WINDOWS],
        F.expr(f"cast(size(collect_set(CASE WHEN {win(t, end, 30)} THEN to_date({t}) END)) AS bigint) AS active_days_30d"),
        *time_of_day_aggregates(win(t, end, 90)),
    ]


def exposure_features(exposures: DataFrame, as_of: str) -> DataFrame:
    w = lambda b: win("exposure_time", at(as_of), 30, b)
    return exposures.groupBy(KEY).agg(*[F.expr(x) for x in (
        f"count_if({w(0)}) AS exposure_count_30d",
        f"count_if({w(30)}) AS exposure_count_prev_30d",
        f"coalesce(sum(coupon_cost) FILTER (WHERE {w(0)}), 0D) AS coupon_cost_30d",
        f"coalesce(sum(coupon_cost) FILTER (WHERE {w(30)}), 0D) AS coupon_cost_prev_30d")])


def purchase_cycle(orders: DataFrame, as_of) -> DataFrame:
    """Gaps between consecutive orders. The mean is (last - first) / (n - 1) and needs no sort."""
    end = _at(as_of)
    hist = orders.where(F.col("order_time") <= end)
    agg = hist.groupBy(KEY).agg(*order_aggregates(as_of)).select(
        KEY, "avg_items_per_order_90d", "orders_with_coupon_ratio_90d", "current_non_purchase_days", "avg_purchase_gap_days")
    agg = agg.withColumn("purchase_cycle_anomaly", ratio_null("current_non_purchase_days", "avg_purchase_gap_days"))
    return agg.join(median_purchase_gap(hist), KEY, "left")


def median_purchase_gap(hist: DataFrame) -> DataFrame:
    marked = hist.select(KEY, "order_time", "order_id", F.trunc("order_time", "month").alias("_month"))
    gaps = previous_row(marked, [KEY], [("order_time", True), ("order_id", True)], ["order_time"], "_month")
    gaps = gaps.where("prev_order_time is not null").select(KEY, days_between("prev_order_time", "order_time").alias("gap"))
    return group_median(gaps, [KEY], "gap", "median_purchase_gap_days")


def correct_90d_order_mix(orders: DataFrame, as_of) -> DataFrame:
    """Items and coupon share over the last 90 days only."""
    hit = in_window("order_time", _at(as_of), 90)
    return orders.where(hit).groupBy(KEY).agg(
        F.avg("quantity").alias("avg_items_per_order_true_90d"),
        F.avg(F.col("coupon_used").cast("double")).alias("coupon_ratio_true_90d"))


def sessions(events: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    return events.where(win("timestamp", at(as_of), days)).groupBy(KEY, "session_id").agg(*[F.expr(x) for x in (
        "min(timestamp) AS session_start",
        f"{days_sql('min(timestamp)', 'max(timestamp)')} * 86400 AS duration",
        *[f"cast(count_if(event_type = '{n}') AS double) AS {n}" for n in ("page_view", "search", "support_contact")])])


def session_features(events: DataFrame, orders: DataFrame, as_of: str) -> DataFrame:
    end = at(as_of)
    s = cut_lineage(sessions(events, as_of).withColumn("_span", F.expr(
        f"CASE WHEN {win('session_start', end, 30)} THEN '30d' ELSE 'prev_30d' END")))
    aggs = []
    for span in ("30d", "prev_30d"):
        hit = f"FILTER (WHERE _span = '{span}')"
        aggs += [f"avg({col}) {hit} AS {name}_{span}" for col, name in (
            ("duration", "avg_session_duration_sec"), ("page_view", "pageviews_per_session"), ("search", "searches_per_session"),
            ("support_contact", "support_contacts_per_session"))]
        aggs.append(f"nullif(count_if(_span = '{span}'), 0) AS sessions_{span}")
    per = s.groupBy(KEY).agg(*[F.expr(x) for x in aggs], F.expr("count_if(search > 0) AS _ss"))
    med = group_median(s, [KEY, "_span"], "duration", "_m").groupBy(KEY).agg(*[
        F.expr(f"max(_m) FILTER (WHERE _span = '{x}') AS median_session_duration_sec_{x}") for x in ("30d", "prev_30d")])
    days = orders.where(win("order_time", end, 60)).groupBy(KEY).agg(F.expr("size(collect_set(to_date(order_time))) AS _days"))
    out = per.join(med, KEY, "left").join(days, KEY, "left")
    return out.withColumn("search_to_purchase_conversion_total", F.expr(
        "CASE WHEN _ss = 0 THEN 0D ELSE coalesce(_days, 0) / _ss END")).drop("_ss", "_days")


def recent_event_sequence(events: DataFrame, as_of, n: int = 5, also: tuple = ()) -> DataFrame:
    """Last n types in time order. The row-number limit is applied on the map side before the shuffle.

    ``also``: more aggregates of the last n rows.
    """
    w = W.partitionBy(KEY).orderBy(F.col("timestamp").desc(), F.col("event_type").desc())
    last = events.where(F.col("timestamp") <= _at(as_of)).select(KEY, "timestamp", "event_type").withColumn(
        "_k", F.row_number().over(w)).where(F.col("_k") <= n)
    seq = F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("k"), "event_type")))
    return last.groupBy(KEY).agg(F.concat_ws(" > ", F.transform(seq, lambda x: x["event_type"])).alias("recent_event_sequence"), *also)


def behavior_mix(events: DataFrame, as_of, types=EVENT_TYPES, days: int = 90) -> DataFrame:
    hist = events.where(in_window("timestamp", _at(as_of), days))
    return hist.groupBy(KEY).agg(*[
        (count_where(F.col("event_type") == t) / F.count(F.lit(1))).alias(f"share_{t}") for t in types])


def behavior_clusters(events: DataFrame, as_of, k: int = 6, seed: int = 42, types=EVENT_TYPES) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    mix = behavior_mix(events, as_of, types)
    ready = VectorAssembler(inputCols=[f"share_{t}" for t in types], outputCol="features").transform(mix)
    n = ready.limit(max(2, k)).count()
    if n < 2:
        return mix.select(KEY, F.lit(0).alias("behavior_cluster_id"))
    model = KMeans(k=max(2, min(k, n)), seed=seed, maxIter=20).fit(ready)
    return model.transform(ready).select(KEY, F.col("prediction").alias("behavior_cluster_id"))


def journey_stage(snapshots: DataFrame, as_of) -> DataFrame:
    """Latest status and how long it has lasted.

    The current island starts at the first snapshot after the last one with another
    status; both are looked up beside a customer's rows, in one pass over the snapshots.
    """
    hist = snapshots.where((F.col("snapshot_date") <= _at(as_of)) & F.col(KEY).isNotNull())
    extra = [x for x in ("inactivity_days", "recent_visit_score", "recent_purchase_score", "recent_exposure_score") if x in snapshots.columns]
    person = W.partitionBy(KEY)
    latest = hist.select(KEY, "snapshot_date", "current_status", F.max_by(F.struct("current_status", "snapshot_date", *extra), "snapshot_date").over(person).alias("l"))
    other = F.max(F.when(F.col("current_status") != F.col("l.current_status"), F.col("snapshot_date"))).over(person)
    start = latest.withColumn("_other", other).where(F.col("_other").isNull() | (F.col("snapshot_date") > F.col("_other"))).groupBy(KEY).agg(
        F.min("snapshot_date").alias("_start"), F.first("l").alias("l"))
    return start.select(
        KEY, F.col("l.current_status").alias("current_journey_stage"),
        (whole_days("_start", "l.snapshot_date") + 1).alias("journey_stage_days"),
        *[F.col(f"l.{x}").alias(x) for x in extra])


def time_of_day_features(events: DataFrame, orders: DataFrame, as_of) -> DataFrame:
    end = _at(as_of)
    e = events.where(in_window("timestamp", end, 90)).groupBy(KEY).agg(*time_of_day_aggregates("true"))
    o = orders.where(in_window("order_time", end, 90)).groupBy(KEY).agg(
        count_where(F.weekday("order_time") >= 5).alias("_we"), F.count(F.lit(1)).alias("_n"))
    return with_time_ratios(e.join(o, KEY, "full"), "_we", "_n").drop("_we", "_n")


def with_time_ratios(df: DataFrame, weekend_orders: str, orders: str) -> DataFrame:
    # a customer without events in the window has no value at all, not zero
    counts = ("evening_events", "night_events", "workhour_events", "weekend_events", "event_diversity_90d", "total_events")
    df = add(df, **{n: f"CASE WHEN total_events > 0 THEN {n} END" for n in counts},
             weekend_purchase_ratio=f"CASE WHEN {orders} > 0 THEN {div_null(weekend_orders, orders)} END")
    return add(df, **{f"{n}_activity_ratio": div_null(f"{n}_events", "total_events") for n in ("evening", "night", "workhour", "weekend")},
               weekday_purchase_ratio="1 - weekend_purchase_ratio")


def dominant_event_type(events: DataFrame, as_of, days: int = 90) -> DataFrame:
    n = events.where(in_window("timestamp", _at(as_of), days)).groupBy(KEY, "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(KEY).agg(F.min_by("event_type", F.struct((-F.col("n")).alias("a"), "event_type")).alias("dominant_event_type_90d"))


def days_since_last(events: DataFrame, orders: DataFrame, customers: DataFrame, as_of) -> DataFrame:
    end = _at(as_of)
    e = events.where(F.col("timestamp") <= end).groupBy(KEY).agg(F.max("timestamp").alias("e"))
    o = orders.where(F.col("order_time") <= end).groupBy(KEY).agg(F.max("order_time").alias("o"))
    return customers.select(KEY).join(e, KEY, "left").join(o, KEY, "left").select(
        KEY, F.coalesce(days_between("e", end), F.lit(999.0)).alias("days_since_last_event"),
        F.coalesce(days_between("o", end), F.lit(999.0)).alias("recency_days"))


def future_activity_label(customers: DataFrame, events: DataFrame, orders: DataFrame, snapshots: DataFrame | None, as_of, horizon: int) -> DataFrame:
    start = _at(as_of)
    end = shift_days(start, horizon)
    inside = lambda t: (F.col(t) > start) & (F.col(t) <= end)
    act = events.where(inside("timestamp") & ~F.lower("event_type").isin(*NO_ACTIVITY_TYPES)).select(KEY).unionByName(
        orders.where(inside("order_time")).select(KEY)).groupBy(KEY).agg(F.lit(1).alias("_active"))
    out = customers.select(KEY).join(act, KEY, "left")
    risky = F.lit(False)
    if snapshots is not None:
        s = snapshots.where(inside("snapshot_date")).groupBy(KEY).agg(F.max_by("current_status", "snapshot_date").alias("_status"))
        out = out.join(s, KEY, "left")
        risky = F.coalesce(F.lower("_status").isin(*RISK_STATUSES), F.lit(False))
    return out.select(KEY, (F.col("_active").isNull() | risky).cast("int").alias("label"))


def winsorize_impute(df: DataFrame, skip=(KEY, "label")) -> tuple[DataFrame, DataFrame]:
    """Clip numbers to p1..p99, fill with the median of the raw column; text becomes 'unknown'.

    Also returns the clip and fill values in long form.
    """
    df = shared(df)
    numeric = [n for n, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") and n not in skip]
    text = [n for n, t in df.dtypes if t == "string" and n not in skip]
    q = exact_quantiles(df, {n: n for n in numeric}, [0.01, 0.5, 0.99])
    # one row with the limits of all columns: nothing is looked up for a row
    limits = q.agg(*[F.expr(f"max(q_{i}) FILTER (WHERE metric = '{n}') AS _q{i}_{n}") for n in numeric for i in range(3)]) if numeric else None
    out = df.crossJoin(F.broadcast(limits)) if numeric else df
    cols = []
    for n, _ in df.dtypes:
        if n in numeric:
            v = f"nanvl(cast({n} AS double), NULL)"
            cols.append(f"coalesce(CASE WHEN {v} IS NOT NULL THEN least(greatest({v}, _q0_{n}), _q2_{n}) END, _q1_{n}, 0D) AS {n}")
        else:
            cols.append(f"coalesce({n}, 'unknown') AS {n}" if n in text else n)
    table = q.select(F.col("metric").alias("feature"), F.col("q_0").alias("clip_p01"), F.col("q_2").alias("clip_p99"), F.col("q_1").alias("fill_value"))
    return out.selectExpr(*cols), table


# Summary columns that may enrich the frame.
ENRICHMENT_COLUMNS = (
    "churn_probability", "churn_label_observed", "uplift_score", "clv", "monetary", "frequency", "recency_days", "engagement_score",
    "loyalty_score", "persona", "segment", "membership_tier", "region", "gender", "age_group", "payment_method", "delivery_type",
    "access_channel", "refund_reason", "session_duration_sec", "page_views", "discount_amount", "point_used",
    "days_since_registration", "total_order_count")


def summary_enrichment(base: DataFrame, summary: DataFrame) -> DataFrame:
    keep = [n for n in summary.columns if n != KEY and (n in ENRICHMENT_COLUMNS or n.startswith(("ext_num__", "ext_cat__", "ext_date__")))]
    right = summary.select(KEY, *[F.col(n).alias(f"_s_{n}") for n in keep])
    j = base.join(right, KEY, "left")
    return j.select(
        *[F.coalesce(F.col(n), F.col(f"_s_{n}")).alias(n) if n in keep else F.col(n) for n in base.columns],
        *[F.col(f"_s_{n}").alias(n) for n in keep if n not in base.columns])


def build_customer_features(customers: DataFrame, events: DataFrame, orders: DataFrame, exposures: DataFrame, *, as_of,
                            horizon: int = 45, snapshots: DataFrame | None = None, treatment: DataFrame | None = None,
                            summary: DataFrame | None = None, n_recent: int = 5, clusters: int | None = 6,
                            finish: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """The full customer frame with its label; ``finish`` clips and fills it."""
    end = _at(as_of)
    base = customers.where(F.col("signup_date") <= end)
    if treatment is not None:
        base = base.join(treatment.select(KEY, *[x for x in treatment.columns if x not in base.columns]), KEY, "left")
    if summary is not None:
        base = summary_enrichment(base, summary)
    base = cut_lineage(base.withColumn("customer_age_days", F.greatest(whole_days("signup_date", end), F.lit(0))))
    o = orders.groupBy(KEY).agg(*order_aggregates(as_of))
    # the windows reach 90 days back and the horizon ahead: only the last events of a customer need the whole history
    near = cut_lineage(events.where((F.col("timestamp") > shift_days(end, -90)) & (F.col("timestamp") <= shift_days(end, horizon))).select(KEY, "timestamp", "event_type", "session_id"))
    e = near.groupBy(KEY).agg(*event_aggregates(as_of))
    since = F.expr(f"{days_sql('max(timestamp)', at(as_of))} AS days_since_last_event")
    x = exposure_features(exposures, as_of)
    parts = [
        o, median_purchase_gap(orders.where(F.col("order_time") <= end)), e, x, session_features(near, orders, as_of),
        recent_event_sequence(events, as_of, n_recent, (since,)), dominant_event_type(near, as_of),
    ]
    if clusters:
        parts.append(behavior_clusters(events, as_of, clusters))
    if snapshots is not None:
        parts.append(journey_stage(snapshots, as_of))
    parts.append(future_activity_label(base, near, orders, snapshots, as_of, horizon))
    base = base.drop(*[n for n in ("recency_days",) if n in base.columns])
    df = reduce(lambda a, b: a.join(b, KEY, "left"), parts, base)
    names = [n for n in df.columns if n != "days_since_last_event"]
    first = names.index(EVENT_WINDOWS[0][0])
    df = df.select(*names[:first], "days_since_last_event", *names[first:])

    zero = ["frequency_30d", "frequency_prev_30d", "frequency_90d", "monetary_30d", "monetary_90d", "active_days_30d",
            "exposure_count_30d", "exposure_count_prev_30d", "coupon_cost_30d", *[n for n, *_ in EVENT_WINDOWS]]
    df = add(df, **{n: f"coalesce({n}, 0)" for n in zero},
             days_since_last_event="coalesce(days_since_last_event, 999D)", recency_days="coalesce(recency_days, 999D)",
             recent_event_sequence="coalesce(recent_event_sequence, 'no_history')",
             dominant_event_type_90d="coalesce(dominant_event_type_90d, 'none')",
             coupon_redeem_rate_90d="coalesce(orders_with_coupon_ratio_90d, 0D)",
             **({"behavior_cluster_id": "coalesce(behavior_cluster_id, -1)"} if clusters else {}))
    rate = lambda a, b: div_null(f"{a} - {b}", b)
    df = add(
        df,
        purchase_cycle_anomaly=div_null("current_non_purchase_days", "avg_purchase_gap_days"),
        avg_order_value_90d=div_null("monetary_90d", "frequency_90d"),
        visit_change_rate_14d=rate("visits_14d", "visits_prev_14d"),
        purchase_change_rate_14d=rate("purchases_14d", "purchases_prev_14d"),
        search_to_purchase_conversion_30d=div_null("frequency_30d", "searches_30d"),
        search_to_purchase_conversion_prev_30d=div_null("frequency_prev_30d", "searches_prev_30d"),
        cart_to_purchase_rate_30d=div_null("frequency_30d", "add_to_cart_30d"),
        cart_to_purchase_rate_prev_30d=div_null("frequency_prev_30d", "add_to_cart_prev_30d"),
        coupon_open_rate_30d=div_null("coupon_open_30d", "exposure_count_30d"),
        coupon_open_rate_prev_30d=div_null("coupon_open_prev_30d", "exposure_count_prev_30d"),
        session_duration_change_rate=rate("avg_session_duration_sec_30d", "avg_session_duration_sec_prev_30d"),
        pageviews_change_rate=rate("pageviews_per_session_30d", "pageviews_per_session_prev_30d"),
        monetary_per_visit_90d=div_null("monetary_90d", "visits_90d"),
        support_contact_rate_30d=div_null("support_contact_30d", "sessions_30d"),
    )
    df = add(
        df,
        search_purchase_conv_change_rate=rate("search_to_purchase_conversion_30d", "search_to_purchase_conversion_prev_30d"),
        cart_conversion_change_rate=rate("cart_to_purchase_rate_30d", "cart_to_purchase_rate_prev_30d"),
        coupon_response_change_rate=rate("coupon_open_rate_30d", "coupon_open_rate_prev_30d"),
    )
    df = with_time_ratios(df, "weekend_purchases", "frequency_90d").drop("weekend_purchases", "coupon_cost_prev_30d")
    # the finished frame is read several times by the quantile passes: write it once
    return winsorize_impute(shared(df)) if finish else (df, None)


def feature_metadata(features: DataFrame, as_of: str, horizon: int, label_source: str = "future_activity_horizon_no_activity") -> DataFrame:
    return features.agg(F.count(F.lit(1)).alias("row_count"), F.avg(F.col("label").cast("double")).alias("positive_rate")).select(
        F.lit(as_of[:10]).alias("as_of_date"), F.lit(horizon).alias("horizon_days"), "row_count", "positive_rate",
        F.lit(label_source).alias("label_source"))
