"""Acquisition cohorts: retention tables, curves and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.ordered import cut_lineage, shared

KEY = "customer_id"
# What counts as activity.
ACTIVITY_PRESETS: dict[str, tuple[str, ...]] = {
    "all_activity": ("visit", "page_view", "search", "add_to_cart", "remove_from_cart", "purchase", "support_contact", "coupon_open", "coupon_redeem"),
    "core_engagement": ("visit", "page_view", "search", "add_to_cart", "purchase"),
    "purchase_only": ("purchase",),
    "purchase_or_redeem": ("purchase", "coupon_redeem"),
}
DEFINITION_PREFERENCE = ("core_engagement", "all_activity")
MODE_PREFERENCE = ("rolling", "point")
MILESTONES = (1, 3, 6, 12)


def cohort_retention_all(customers: DataFrame, events: DataFrame, *, periods: int = 7, presets=None, modes=("point", "rolling"),
                         min_events: int = 1, end_month: int | None = None) -> DataFrame:
    """Every activity definition and both modes in one pass over the events.

    Events shrink to one row per customer and month with a count for each definition, so the
    log is read and grouped once; the rows of the definitions are laid out after that, and
    no task groups them again by customer.
    """
    presets = presets or ACTIVITY_PRESETS
    spark = events.sparkSession
    base = cut_lineage(customers.selectExpr(KEY, "acquisition_month AS cohort_month",
                                            "cast(substr(acquisition_month, 1, 4) AS int) * 12 + cast(substr(acquisition_month, 6, 2) AS int) AS _cm"))
    each = ", ".join(f"struct('{d}' AS activity_definition, count_if(event_type IN ({', '.join(repr(t) for t in types)})) AS _n)" for d, types in presets.items())
    monthly = events.selectExpr(KEY, "event_type", "year(timestamp) * 12 + month(timestamp) AS _em").where(F.col("_em").isNotNull() & F.col("event_type").isin(*{t for types in presets.values() for t in types})).groupBy(KEY, "_em").agg(F.expr(f"array({each}) AS _d"))
    # read by the end of each definition and by both modes: written once
    active = cut_lineage(monthly.select(KEY, "_em", F.inline("_d")).where("_n > 0").select("activity_definition", KEY, "_em", "_n"))
    last = active.groupBy("activity_definition").agg(F.max("_em").alias("_end"))
    hits = (
        active.where(F.col("_n") >= min_events).join(base, KEY).withColumn("period", F.expr("_em - _cm"))
        .where(f"period >= 0 AND period < {periods}"))
    point = hits.groupBy("activity_definition", "cohort_month", "period").agg(F.count(F.lit(1)).alias("_k")).withColumn("retention_mode", F.lit("point"))
    final = hits.groupBy("activity_definition", "cohort_month", KEY).agg(F.max("period").alias("period"))
    # retained at p = customers whose last active period is p or later: count per last period, then expand to 0..last
    rolling = final.groupBy("activity_definition", "cohort_month", "period").agg(F.count(F.lit(1)).alias("_c")).selectExpr(
        "activity_definition", "cohort_month", "_c", "explode(sequence(0, period)) AS period").groupBy(
        "activity_definition", "cohort_month", "period").agg(F.sum("_c").alias("_k")).withColumn("retention_mode", F.lit("rolling"))
    sizes = base.groupBy("cohort_month", "_cm").agg(F.count_distinct(KEY).alias("cohort_size"))
    names = spark.createDataFrame([(d, m) for d in presets for m in modes], "activity_definition string, retention_mode string")
    top = base.selectExpr("max(_cm) AS _top")
    # the grid has cohorts x periods x definitions rows: as many as there are months
    grid = (
        sizes.crossJoin(F.broadcast(names)).join(F.broadcast(last), "activity_definition", "left").crossJoin(F.broadcast(top))
        .selectExpr("*", f"explode(sequence(0, {periods - 1})) AS period")
        .withColumn("observed", F.expr(f"period <= greatest(coalesce({end_month if end_month is not None else '_end'}, _top) - _cm, 0)")))
    counts = point.unionByName(rolling).where(F.col("retention_mode").isin(*modes))
    out = grid.join(counts, ["activity_definition", "retention_mode", "cohort_month", "period"], "left")
    kept = "CASE WHEN observed THEN CASE WHEN period = 0 THEN cohort_size ELSE coalesce(_k, 0) END END"
    return out.selectExpr(
        "cohort_month", "period", "cohort_size", f"{kept} AS retained_customers", f"{kept} / greatest(cohort_size, 1) AS retention_rate",
        "observed", "activity_definition", "retention_mode", f"{min_events} AS min_events_per_period")


def cohort_retention(customers: DataFrame, events: DataFrame, *, definition: str = "core_engagement", mode: str = "rolling", types=None, **kw) -> DataFrame:
    presets = {definition: tuple(types) if types else ACTIVITY_PRESETS[definition]}
    return cohort_retention_all(customers, events, presets=presets, modes=(mode,), **kw)


def milestones(cohorts: DataFrame, at=MILESTONES) -> DataFrame:
    return cohorts.where(F.col("period").isin(*at)).selectExpr(
        "cohort_month", "period", "cohort_size", "retention_rate", "1 - retention_rate AS churn_rate", "observed")


def average_curve(cohorts: DataFrame) -> DataFrame:
    return cohorts.where("observed").groupBy("period").agg(
        F.avg("retention_rate").alias("avg_retention"), F.expr("avg(1 - retention_rate) AS avg_churn"))


def churn_heatmap(milestone_rows: DataFrame, at=MILESTONES) -> DataFrame:
    return milestone_rows.groupBy("cohort_month").agg(*[F.expr(f"max(churn_rate) FILTER (WHERE period = {p}) AS m{p}") for p in at])


def cohort_curve(cohorts: DataFrame, *, definition: str | None = None, mode: str | None = None, min_size: int = 0, observed_only: bool = True) -> DataFrame:
    """One definition and mode: the wanted one if present, else by preference, else the first by name."""
    def chosen(col, wanted, preference):
        ranks = [wanted] if wanted else []
        order = "CASE " + " ".join(f"WHEN {col} = '{x}' THEN {i}" for i, x in enumerate([*ranks, *preference])) + " ELSE 99 END"
        return F.expr(f"min_by({col}, struct({order}, {col})) AS _{col}")
    cohorts = shared(cohorts)
    pick = cohorts.agg(chosen("activity_definition", definition, DEFINITION_PREFERENCE), chosen("retention_mode", mode, MODE_PREFERENCE))
    df = cohorts.crossJoin(F.broadcast(pick)).where("activity_definition = _activity_definition AND retention_mode = _retention_mode")
    df = df.drop("_activity_definition", "_retention_mode").where(F.col("cohort_size") >= min_size)
    return df.where("observed") if observed_only else df


def cohort_pivot(curve: DataFrame, periods: int = 7) -> DataFrame:
    return curve.groupBy("cohort_month").agg(*[F.expr(f"max(retention_rate) FILTER (WHERE period = {p}) AS p{p}") for p in range(periods)])


def cohort_summary(curve: DataFrame) -> DataFrame:
    """One row: averages, the comparable period of mature cohorts, best and worst cohort, non-monotonic count."""
    curve = shared(curve)
    steps = curve.withColumn("_prev", F.lag("retention_rate").over(W.partitionBy("cohort_month").orderBy("period")))
    per = steps.groupBy("cohort_month").agg(
        F.max("cohort_size").alias("size"), F.max("period").alias("last_period"), F.max_by("retention_rate", "period").alias("last_rate"),
        F.expr("max(retention_rate) FILTER (WHERE period = 1) AS m1"),
        F.expr("count(retention_rate) >= 3 AND coalesce(bool_or(retention_rate - _prev > 1e-12), false) AS rises"))
    comparable = per.agg(F.expr("coalesce(min(last_period) FILTER (WHERE last_period >= 1), 0) AS comparable_period"))
    at_p = curve.join(F.broadcast(comparable), F.expr("period = comparable_period")).agg(
        F.avg("retention_rate").alias("comparable_avg_retention"),
        F.expr("max_by(cohort_month, struct(retention_rate, cohort_month)) AS best_comparable_cohort"),
        F.expr("min_by(cohort_month, struct(retention_rate, cohort_month)) AS worst_comparable_cohort"))
    periods = curve.agg(F.count_distinct("period").alias("observed_periods"))
    head = per.agg(
        F.count(F.lit(1)).alias("cohort_count"), F.avg("size").alias("avg_cohort_size"), F.avg("m1").alias("month1_avg_retention"),
        F.avg("last_rate").alias("last_observed_avg_retention"),
        F.expr("max_by(cohort_month, struct(last_rate, cohort_month)) AS best_last_cohort"),
        F.expr("min_by(cohort_month, struct(last_rate, cohort_month)) AS worst_last_cohort"),
        F.expr("count_if(rises) AS non_monotonic_cohort_count"))
    return head.crossJoin(comparable).crossJoin(at_p).crossJoin(periods)
