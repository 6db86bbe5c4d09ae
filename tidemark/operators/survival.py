"""Time to churn: gap events, Cox regression, curves and concordance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.expr import add, at
from ..functions.ordered import cut_lineage, exact_quantiles, pct_ranks, previous_row, row_index, running_totals, shared, with_range

KEY = "customer_id"


def activity_times(events: DataFrame, orders: DataFrame) -> DataFrame:
    from .snapshots import activity_times as raw

    return raw(events, orders).select(KEY, "activity_time").distinct()


def activity_gap_events(customers: DataFrame, activity: DataFrame, landmark: str, *, horizon: int = 90, threshold: int = 30) -> DataFrame:
    """At-risk customers with the date their silence first reaches the threshold (null = censored)."""
    lm = at(landmark)
    last = activity.where(f"activity_time <= {lm}").groupBy(KEY).agg(F.max("activity_time").alias("_last"))
    base = customers.select(KEY, "signup_date").join(last, KEY, "left").withColumn(
        "_start", F.expr(f"coalesce(_last, CASE WHEN signup_date <= {lm} THEN signup_date END, {lm})")).where(f"_start + INTERVAL '{threshold}' DAY > {lm}")
    later = activity.where(f"activity_time > {lm} AND activity_time <= {lm} + INTERVAL '{horizon}' DAY")
    walk = base.select(KEY, F.col("_start").alias("activity_time")).unionByName(later.join(base.select(KEY), KEY, "left_semi")).withColumn("_day", F.to_date("activity_time"))
    steps = previous_row(walk, [KEY], [("activity_time", True)], ["activity_time"], "_day")
    gap = f"prev_activity_time + INTERVAL '{threshold}' DAY"
    end = f"{lm} + INTERVAL '{horizon}' DAY"
    inner = steps.groupBy(KEY).agg(
        F.expr(f"min({gap}) FILTER (WHERE {gap} < activity_time AND {gap} <= {end}) AS _a"), F.expr(f"max(activity_time) + INTERVAL '{threshold}' DAY AS _b"))
    hit = f"coalesce(_a, CASE WHEN _b <= {end} THEN _b END)"
    return base.select(KEY).join(inner, KEY, "left").selectExpr(
        KEY, f"CASE WHEN {hit} IS NOT NULL THEN greatest({hit}, {lm} + INTERVAL '1' DAY) END AS event_date")


def status_events(customers: DataFrame, snapshots: DataFrame, landmark: str, *, horizon: int = 90) -> DataFrame:
    lm = at(landmark)
    first = snapshots.where(f"snapshot_date > {lm} AND snapshot_date <= {lm} + INTERVAL '{horizon}' DAY AND current_status IN ('churn_risk', 'churned')").groupBy(KEY).agg(
        F.min("snapshot_date").alias("event_date"))
    return customers.select(KEY).join(first, KEY, "left")


def landmark_frame(events_by_customer: DataFrame, landmark: str, *, horizon: int = 90) -> DataFrame:
    return events_by_customer.selectExpr(
        KEY, f"cast(CASE WHEN event_date IS NOT NULL THEN greatest(floor((unix_micros(cast(event_date AS timestamp)) - unix_micros(cast({at(landmark)} AS timestamp))) / 86400000000), 1) "
             f"ELSE {horizon} END AS int) AS duration_days", "cast(event_date IS NOT NULL AS int) AS event_observed")


def kaplan_meier(df: DataFrame, group: str = "risk_group") -> DataFrame:
    """Survival per group; rows are days (bounded by the horizon), never customers."""
    g = df.groupBy(group, "duration_days").agg(F.count(F.lit(1)).alias("n"), F.sum("event_observed").alias("d"))
    w = W.partitionBy(group).orderBy("duration_days")
    back = W.partitionBy(group).orderBy(F.desc("duration_days")).rowsBetween(W.unboundedPreceding, 0)
    g = g.withColumn("at_risk", F.sum("n").over(back))
    g = g.withColumn("_dead", F.max(F.expr("cast(d = at_risk AS int)")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = F.sum(F.expr("CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE 0D END")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return g.select(group, "duration_days", "at_risk", F.col("d").cast("long").alias("events"), F.when(F.col("_dead") == 1, F.lit(0.0)).otherwise(F.exp(s)).alias("survival"))


def risk_groups(df: DataFrame, score: str = "predicted_hazard_ratio") -> DataFrame:
    """Percent rank and thirds of the rank (ties by customer)."""
    df = shared(df)
    ranks = pct_ranks(df, KEY, {"risk_percentile": score})
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    idx = row_index(cut_lineage(df.select(KEY, F.col(score).alias("_s"))), [("_s", True), (KEY, True)], "_r").select(KEY, "_r").crossJoin(F.broadcast(n))
    idx = idx.selectExpr(KEY, "CASE WHEN _r <= 1 + (_n - 1) / 3D THEN 'Low risk' WHEN _r <= 1 + 2 * (_n - 1) / 3D THEN 'Mid risk' ELSE 'High risk' END AS risk_group")
    return df.drop("risk_percentile", "risk_group").join(ranks, KEY).join(idx, KEY)


def survival_predict(df: DataFrame, betas: dict[str, tuple[float, float, float]], baseline: list[float]) -> DataFrame:
    """Hazard ratio, S(t), median time, rank and group.

    ``betas``: feature -> (coefficient, mean, scale); ``baseline``: cumulative hazard
    of day 1..h, a horizon-sized array.
    """
    h = len(baseline)
    lin = " + ".join(f"{b!r}D * (coalesce(cast({c} AS double), {m!r}D) - {m!r}D) / {s!r}D" for c, (b, m, s) in betas.items())
    arr = ", ".join(f"{x!r}D" for x in baseline)
    days = sorted({1, min(30, h), min(60, h), min(90, h), h})
    out = df.selectExpr(KEY, f"exp({lin}) AS predicted_hazard_ratio")
    out = add(out, **{f"survival_prob_{d}d": f"exp(-{baseline[d - 1]!r}D * predicted_hazard_ratio)" for d in days},
              predicted_median_time_to_churn_days=f"cast(coalesce(nullif(array_position(transform(array({arr}), x -> exp(-x * predicted_hazard_ratio) <= 0.5), true), 0), {h}) AS double)")
    return risk_groups(cut_lineage(out))


def _dominated(part):
    """Of one hazard range: twice the concordant pairs inside it, ties one.  Rows are distinct (h, t, e) with their number."""
    import pandas as pd

    part = part.sort_values("h", kind="stable")
    h, t, e, n = (part[c].to_numpy() for c in ("h", "t", "e", "n"))
    twice = 0
    for s in np.unique(t[e == 1]):  # days up to the horizon
        risk, hit = (t > s) | ((t == s) & (e == 0)), (t == s) & (e == 1)
        below = np.concatenate([[0], np.cumsum(n[risk])])
        less, upto = (below[np.searchsorted(h[risk], h[hit], side=x)] for x in ("left", "right"))
        twice += int((n[hit] * (less + upto)).sum())
    return pd.DataFrame({"twice": [twice]})


def concordance_index(df: DataFrame, hazard: str = "predicted_hazard_ratio") -> DataFrame:
    """Share of comparable pairs in the right order, ties one half.

    No pair is ever built and no row is copied.  Rows are counted by hazard, day and event,
    and cut into hazard ranges.  A range's counts by day say how many of its rows are still
    at risk on each event day, and running sums over the ranges, a row for each range and
    day, how many of the ranges below are; within a range, arrays of the sorted hazards
    give the rest.  Rows without a hazard are left out.
    """
    d = df.selectExpr(f"cast({hazard} AS double) AS h", "cast(duration_days AS int) AS t", "cast(event_observed AS int) AS e").where("h IS NOT NULL AND t IS NOT NULL AND e IS NOT NULL")
    counted = cut_lineage(d.groupBy("h", "t", "e").agg(F.count(F.lit(1)).alias("n")))
    d = cut_lineage(with_range(counted, [("h", True)]))
    days = d.where("e = 1").select(F.col("t").alias("s")).distinct()  # at most the horizon
    by_day = d.groupBy("_range", "t", "e").agg(F.sum("n").alias("n")).groupBy("_range").agg(F.collect_list(F.struct("t", "e", "n")).alias("rows"))
    total = lambda keep: f"aggregate(filter(rows, x -> {keep}), 0L, (a, x) -> a + x.n)"
    grid = by_day.crossJoin(F.broadcast(days)).selectExpr("_range", "s", f"{total('x.t > s OR (x.t = s AND x.e = 0)')} AS risk", f"{total('x.t = s AND x.e = 1')} AS hits")
    w = W.partitionBy("s").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    grid = grid.select("s", "risk", "hits", F.coalesce(F.sum("risk").over(w), F.lit(0)).alias("below"))
    days = grid.groupBy("s").agg(F.sum(F.col("hits") * F.col("below")).alias("below"), (F.sum("hits") * F.sum("risk")).alias("pairs"))
    outside = days.agg(F.sum("below").alias("below"), F.sum("pairs").alias("comparable"))
    inside = d.groupBy("_range").applyInPandas(_dominated, "twice long").agg(F.coalesce(F.sum("twice"), F.lit(0)).alias("twice"))
    return outside.crossJoin(F.broadcast(inside)).selectExpr("cast(coalesce(comparable, 0) AS bigint) AS comparable_pairs", "(below + twice / 2D) / nullif(comparable, 0) AS concordance_index")


# ---- encoding ---------------------------------------------------------
def encode_survival(df: DataFrame, *, numeric, categorical, max_features: int = 140) -> tuple[DataFrame, list[str]]:
    """Median fill, rare levels, one-hot without the first level, and the variance, prevalence and separation filters."""
    df = cut_lineage(df)
    med = {r["metric"]: r["q_0"] for r in exact_quantiles(df, {c: c for c in numeric}, [0.5]).collect()}
    out = df.select(KEY, "duration_days", "event_observed", *[F.expr(f"coalesce(cast({c} AS double), {med.get(c, 0.0)!r}D) AS {c}") for c in numeric],
                    *[F.expr(f"coalesce(cast({c} AS string), 'unknown') AS {c}") for c in categorical])
    n = df.count()
    cols = list(numeric)
    for c in categorical:
        seq = c.startswith("recent_event_sequence")
        keep_top, share = (6, 0.02) if seq else (10, 0.01)
        levels = out.groupBy(c).agg(F.count(F.lit(1)).alias("k"))
        distinct = levels.limit(21).count()
        kept = [r[c] for r in levels.orderBy(F.desc("k"), c).limit(keep_top).collect()]
        # at most 1/share levels can reach the share
        kept += [r[c] for r in levels.where(f"k >= {share * n}").collect() if r[c] not in kept]
        if not seq and distinct <= 20:
            kept, rare = [r[c] for r in levels.collect()], False
        else:
            rare = True
        names = sorted([*kept, *(["__rare__"] if rare else [])])[1:]
        level = F.when(F.col(c).isin(kept), F.col(c)).otherwise("__rare__")
        for v in names:
            label = f"{c}__{v}".replace(".", "_").replace("`", "_")
            out = out.withColumn(label, (level == F.lit(v)).cast("double"))
            cols.append(label)
    q = lambda c: f"`{c}`"
    stats = out.agg(*[F.expr(x) for i, c in enumerate(cols) for x in (
        f"var_samp({q(c)}) AS v{i}", f"avg({q(c)}) AS m{i}", f"count(DISTINCT {q(c)}) <= 2 AS b{i}" if c in numeric else f"true AS b{i}",
        f"avg({q(c)}) FILTER (WHERE event_observed = 1) AS em{i}", f"avg({q(c)}) FILTER (WHERE event_observed = 0) AS cm{i}",
        f"var_pop({q(c)}) FILTER (WHERE event_observed = 1) AS ev{i}", f"var_pop({q(c)}) FILTER (WHERE event_observed = 0) AS cv{i}")]).first()
    good = []
    for i, c in enumerate(cols):
        s = lambda p: stats[f"{p}{i}"] or 0.0
        if s("v") <= 1e-4 or (c not in numeric and not 0.005 <= s("m") <= 0.995):
            continue
        if stats[f"b{i}"] and min(s("ev"), s("cv")) < 1e-8 and abs(s("em") - s("cm")) >= 0.20:
            continue
        good.append((s("v"), c))
    chosen = [c for _, c in sorted(good, key=lambda x: -x[0])[:max_features]]
    return out.select(KEY, "duration_days", "event_observed", *[F.col(q(c)) for c in chosen]), chosen


# ---- Cox regression ---------------------------------------------------
EFRON_BLOCK = 1 << 20


def _efron(m: int, at_risk: float, dying: float) -> tuple[float, ...]:
    """Sums over a day's m events of ln d, 1/d, f/d, 1/d^2, f/d^2 and f^2/d^2, with f = j/m and d = at_risk - f * dying; a block of events at a time."""
    out = np.zeros(6)
    for lo in range(0, m, EFRON_BLOCK):
        f = np.arange(lo, min(m, lo + EFRON_BLOCK)) / m
        d = at_risk - f * dying
        out += (np.log(d).sum(), (1 / d).sum(), (f / d).sum(), (1 / d**2).sum(), (f / d**2).sum(), (f * f / d**2).sum())
    return tuple(out)


def _gram(part: DataFrame, features: list[str], weight: str) -> np.ndarray:
    """Sum of w x x' over all rows: one d x d block per task, added up on Spark."""
    d = len(features)

    def block(it):
        import pandas as pd

        acc = np.zeros((d, d))
        for pdf in it:
            x = pdf[features].to_numpy(float)
            acc += x.T @ (x * pdf[weight].to_numpy(float)[:, None])
        yield pd.DataFrame({"i": np.arange(d * d), "v": acc.ravel()})

    rows = part.select(*[F.col(f"`{c}`") for c in features], weight).mapInPandas(block, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(d * d)
    for r in rows:
        out[r["i"]] = r["v"]
    return out.reshape(d, d)


def cox_fit(df: DataFrame, features: list[str], *, penalizer: float = 0.1, max_iter: int = 20, tol: float = 1e-6) -> dict:
    """Proportional hazards with Efron ties and an L2 penalty.

    Durations are whole days up to the horizon, so one pass per step gives the
    sums by day (a few hundred numbers); a second gives the weighted Gram matrix.
    Only those sums reach the driver; tied events of a day enter as six sums.  A fit that
    has not settled after ``max_iter`` steps is an error.
    """
    stats = df.agg(*[F.expr(x) for i, c in enumerate(features) for x in (f"avg(`{c}`) AS m{i}", f"stddev_samp(`{c}`) AS s{i}")], F.count(F.lit(1)).alias("n")).first()
    mean = [float(stats[f"m{i}"] or 0.0) for i in range(len(features))]
    scale = [float(stats[f"s{i}"] or 0.0) or 1.0 for i in range(len(features))]
    names = [f"x{i}" for i in range(len(features))]
    z = cut_lineage(df.selectExpr("duration_days AS t", "event_observed AS e", *[f"(cast(`{c}` AS double) - {mean[i]!r}D) / {scale[i]!r}D AS x{i}" for i, c in enumerate(features)]))
    n, d = stats["n"], len(features)
    beta = np.zeros(d)

    def day_sums(b):
        lin = " + ".join(f"{float(v)!r}D * {c}" for v, c in zip(b, names))
        w = z.withColumn("w", F.expr(f"exp({lin})"))
        rows = w.groupBy("t", "e").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *[F.expr(f"sum(w * {c}) AS w_{c}") for c in names], *[F.expr(f"sum({c}) AS s_{c}") for c in names]).collect()
        days = sorted({r["t"] for r in rows})
        pos = {t: i for i, t in enumerate(days)}
        k = len(days)
        a = {"w": np.zeros((k, 2)), "wx": np.zeros((k, 2, d)), "sx": np.zeros((k, d)), "n": np.zeros(k, int)}
        for r in rows:
            i, e = pos[r["t"]], int(r["e"])
            a["w"][i, e], a["wx"][i, e] = r["w"], [r[f"w_{c}"] for c in names]
            if e:
                a["n"][i], a["sx"][i] = r["n"], [r[f"s_{c}"] for c in names]
        s0 = np.cumsum(a["w"].sum(1)[::-1])[::-1]
        s1 = np.cumsum(a["wx"].sum(1)[::-1], axis=0)[::-1]
        return days, a, s0, s1, w

    def likelihood_parts(b):
        days, a, s0, s1, w = day_sums(b)
        ll, grad, outer = 0.0, np.zeros(d), np.zeros((d, d))
        cum_a, own_b, run = np.zeros(len(days)), np.zeros(len(days)), 0.0
        for i in range(len(days)):
            m = a["n"][i]
            if m:
                logs, inv, f_inv, inv2, f_inv2, f2_inv2 = _efron(int(m), float(s0[i]), float(a["w"][i, 1]))
                all_x, own_x = s1[i], a["wx"][i, 1]
                cross = np.outer(all_x, own_x)
                ll += float(a["sx"][i] @ b - logs)
                grad += a["sx"][i] - inv * all_x + f_inv * own_x
                outer += inv2 * np.outer(all_x, all_x) - f_inv2 * (cross + cross.T) + f2_inv2 * np.outer(own_x, own_x)
                run += inv
                own_b[i] = f_inv
            cum_a[i] = run
        return days, a, s0, ll, grad, outer, cum_a, own_b, w

    last, done = None, False
    for _ in range(max_iter):
        days, a, s0, ll, grad, outer, cum_a, own_b, w = likelihood_parts(beta)
        table = F.broadcast(df.sparkSession.createDataFrame([(int(t), float(x), float(y)) for t, x, y in zip(days, cum_a, own_b)], "t int, ca double, cb double"))
        gram = _gram(w.join(table, "t").withColumn("g", F.expr("w * (ca - e * cb)")), names, "g")
        g = grad / n - penalizer * beta
        hess = (gram - outer) / n + penalizer * np.eye(d)
        step = np.linalg.solve(hess, g)
        beta = beta + step
        if np.abs(step).max() < tol or (last is not None and abs(ll - last) < 1e-9 * abs(ll)):
            done = True
            break
        last = ll
    if not done or not np.isfinite(beta).all():
        raise ValueError(f"Cox regression did not converge in {max_iter} steps")
    days, a, s0, *_ = likelihood_parts(beta)
    hazard = np.cumsum([a["n"][i] / s0[i] if a["n"][i] else 0.0 for i in range(len(days))])
    horizon = max(days)
    baseline = [float(hazard[max([i for i, t in enumerate(days) if t <= day], default=0)]) if days[0] <= day else 0.0 for day in range(1, horizon + 1)]
    return {"betas": {c: (float(beta[i]), mean[i], scale[i]) for i, c in enumerate(features)}, "baseline": baseline, "log_likelihood": ll, "penalizer": penalizer}


def cox_fit_with_retry(df: DataFrame, features: list[str], *, penalizer: float = 0.1) -> dict:
    """Stronger penalties one after another until the fit is finite."""
    error: Exception | None = None
    for p in dict.fromkeys([penalizer, max(penalizer, 0.25), max(penalizer, 0.5), max(penalizer, 1.0)]):
        try:
            return cox_fit(df, features, penalizer=p)
        except (ValueError, np.linalg.LinAlgError) as exc:
            error = exc
    raise ValueError(f"Cox regression failed at every penalty: {error}")
