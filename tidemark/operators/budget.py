"""Exact ordered greedy selection under a budget, as a few distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.ordered import cut_lineage, min_max_scaled, range_count, row_index, running_totals

KEY = "customer_id"
# Display order of segments and intensities.
SEGMENT_ORDER = ("Persuadables", "Sure Things", "Sleeping Dogs", "Lost Causes")
INTENSITIES = ("low", "mid", "high")


def _spread(df: DataFrame, n_rows: int) -> DataFrame:
    """Positions are dense, so equal slices of them are even ranges; no sampling needed."""
    size = max(1, -(-n_rows // range_count(df.sparkSession)))
    return df.withColumn("_slice", F.expr(f"cast(_pos / {size} AS int)"))


#: Rows left to choose from that are walked one by one instead of in further rounds.
WALK_ROWS = 20_000


def _walk(rows, state: dict, max_customers: int | None, high_cap: int | None, one_per_customer: bool) -> list[tuple[str, int]]:
    """The plain walk over the few rows that still fit after the first rounds."""
    out, served = [], set()
    for r in sorted(rows, key=lambda r: (r["budget_id"], r["_pos"])):
        s, who = state[r["budget_id"]], (r["budget_id"], r[KEY])
        full = max_customers and s["n"] >= max_customers or r["_high"] and high_cap and s["high"] >= high_cap
        if r["_cost"] > s["left"] or full or one_per_customer and who in served:
            continue
        s["left"], s["n"], s["high"] = s["left"] - r["_cost"], s["n"] + 1, s["high"] + r["_high"]
        served.add(who)
        out.append((r["budget_id"], r["_pos"]))
    return out


def greedy_select(candidates: DataFrame, order, budgets: dict[str, int], *, max_customers: int | None = None, high_share: float | None = 0.35,
                  high_base: str = "rows", one_per_customer: bool = True, max_rounds: int = 2000) -> DataFrame:
    """Same picks as walking the sorted rows one by one, for several budgets at once.

    Returns the picked candidate rows with ``budget_id`` and ``pick_order``.

    One round: of the rows still possible take each customer's first, add up cost,
    count and high-intensity use in order, and find the first row that breaks a
    limit.  Everything before it is what the sequential walk takes.  Spend and use
    only grow, so the breaking row, rows of served customers, rows dearer than the
    rest of the budget and (when full) all high-intensity rows are gone for good.
    Money is counted in whole cents; sums are therefore exact in any order.
    """
    spark = candidates.sparkSession
    # written once with a row id: rows that are equal in every column stay apart, and ties of the order have an end
    pool = cut_lineage(candidates.withColumn("_rid", F.monotonically_increasing_id()))
    order = [*order, ("_rid", True)]
    keys = list(dict.fromkeys([n for n, _ in order] + [KEY, "coupon_cost"]))
    extra = [c for c in ("intervention_intensity",) if c in pool.columns and c not in keys]
    ranked = cut_lineage(row_index(pool.where("coupon_cost > 0").select(*keys, *extra), order, "_pos").select("_pos", "_rid", KEY, "coupon_cost", *[c for c in ("intervention_intensity",) if c in pool.columns]))
    size = ranked.agg(F.count(F.lit(1)), F.count_distinct(KEY)).first()
    base = max_customers or (size[0] if high_base == "rows" else size[1])
    high_cap = max(1, int(max(base, 1) * high_share)) if high_share else None
    has_high = "intervention_intensity" in ranked.columns
    narrow = ranked.selectExpr(
        KEY, "_pos", "cast(round(coupon_cost * 100) AS bigint) AS _cost",
        ("cast(lower(intervention_intensity) = 'high' AS int)" if has_high else "0") + " AS _high")
    state = {b: {"left": int(v) * 100, "n": 0, "high": 0} for b, v in budgets.items() if int(v) > 0}
    if not state:
        return candidates.limit(0).selectExpr("*", "'' AS budget_id", "cast(0 AS bigint) AS pick_order")

    def limits(only: set | None = None) -> DataFrame:
        return F.broadcast(spark.createDataFrame(
            [(b, s["left"], (max_customers - s["n"]) if max_customers else None, (high_cap - s["high"]) if high_cap else None) for b, s in state.items() if only is None or b in only],
            "budget_id string, _left bigint, _slots bigint, _high_left bigint"))

    def possible(df: DataFrame) -> DataFrame:
        return df.where("_cost <= _left AND (_slots IS NULL OR _slots > 0) AND (_high = 0 OR _high_left IS NULL OR _high_left > 0)")

    sums = {"_c": F.col("_cost"), "_n": F.lit(1).cast("long"), "_h": F.col("_high")}
    bad = F.expr("_c > _left OR (_slots IS NOT NULL AND _n > _slots) OR (_high = 1 AND _high_left IS NOT NULL AND _h > _high_left)")
    dearest = narrow.agg(F.max("_cost")).first()[0] or 0
    # budgets that every row fits into start with the same sums: these are added up once, without a row for each budget
    alike = {b for b, s in state.items() if s["left"] >= dearest}
    picked, alive, waiting = [], None, None
    if len(alike) < len(state):
        waiting = possible(narrow.crossJoin(limits(set(state) - alike))).select("budget_id", KEY, "_pos", "_cost", "_high")
    for turn in range(max_rounds):
        if turn == 0 and alike:
            heads = narrow
            if one_per_customer:
                heads = narrow.groupBy(KEY).agg(F.expr("min_by(struct(_pos, _cost, _high), _pos) AS h")).select(KEY, "h.*")
            cum = cut_lineage(running_totals(_spread(heads, size[0]), [("_pos", True)], sums, range_col="_slice").drop("_slice"))
            marked, alive = cum.crossJoin(limits(alike)).withColumn("_bad", bad), narrow.crossJoin(limits(alike).select("budget_id"))
        else:
            if waiting is not None:
                alive, waiting = waiting if alive is None else alive.unionByName(waiting), None
            heads = alive
            if one_per_customer:
                heads = alive.groupBy("budget_id", KEY).agg(F.expr("min_by(struct(_pos, _cost, _high), _pos) AS h")).select("budget_id", KEY, "h.*")
            cum = running_totals(_spread(heads, size[0]), [("_pos", True)], sums, by=["budget_id"], range_col="_slice").drop("_slice")
            marked = cut_lineage(cum.join(limits(), "budget_id").withColumn("_bad", bad))
        # one small row per budget comes back: where the walk stops and what was used
        rows = marked.groupBy("budget_id").agg(
            F.expr("min_by(struct(_pos, _c - _cost AS c, _n - 1 AS n, _h - _high AS h), _pos) FILTER (WHERE _bad) AS stop"),
            F.expr("max_by(struct(_c AS c, _n AS n, _h AS h), _pos) AS all")).collect()
        if not rows:
            if waiting is None:
                break
            state = {b: s for b, s in state.items() if b not in alike}
            alive = None
            continue
        stops = {}
        for r in rows:
            use = r["stop"] or r["all"]
            s = state[r["budget_id"]]
            s["left"] -= use["c"]
            s["n"] += use["n"]
            s["high"] += use["h"]
            stops[r["budget_id"]] = r["stop"]["_pos"] if r["stop"] else None
        cut = F.broadcast(spark.createDataFrame(list(stops.items()), "budget_id string, _stop bigint"))
        taken = marked.join(cut, "budget_id").where("_stop IS NULL OR _pos < _stop")
        picked.append(taken.select("budget_id", "_pos"))
        state = {b: s for b, s in state.items() if stops.get(b) is not None or waiting is not None and b not in alike}
        if not state:
            break
        # what no longer fits goes before the join, which leaves little of the rows behind each budget's stop
        rest = possible(alive.join(cut, "budget_id").where("_pos > _stop").drop("_stop").join(limits(), "budget_id")).select("budget_id", KEY, "_pos", "_cost", "_high")
        if one_per_customer:
            rest = rest.join(taken.select("budget_id", KEY), ["budget_id", KEY], "left_anti")
        alive = cut_lineage(rest)
        if waiting is None and alive.count() <= WALK_ROWS:
            walked = _walk(alive.collect(), state, max_customers, high_cap, one_per_customer)
            if walked:
                picked.append(spark.createDataFrame(walked, "budget_id string, _pos bigint"))
            break
    else:
        raise RuntimeError(f"budget selection did not finish in {max_rounds} rounds")
    if not picked:
        return candidates.limit(0).selectExpr("*", "'' AS budget_id", "cast(0 AS bigint) AS pick_order")
    chosen = picked[0]
    for p in picked[1:]:
        chosen = chosen.unionByName(p)
    hits = chosen.join(ranked.select("_pos", "_rid"), "_pos").select("_rid", "budget_id", F.col("_pos").alias("pick_order"))
    return pool.join(hits, "_rid").select(*candidates.columns, "budget_id", "pick_order")


def select_under_budget(candidates: DataFrame, order, budget: int, **kw) -> DataFrame:
    return greedy_select(candidates, order, {"budget": int(budget)}, **kw).drop("budget_id")


def segment_allocation(selected: DataFrame, *, segment: str = "uplift_segment", segments=None, by_intensity: bool = True) -> DataFrame:
    """Spend, profit, revenue and ROI on the complete segment x intensity grid."""
    spark = selected.sparkSession
    keys = [segment, "intervention_intensity"] if by_intensity else [segment]
    g = selected.groupBy(*keys).agg(
        F.count_distinct(KEY).alias("customer_count"), F.sum("coupon_cost").alias("allocated_budget"),
        F.sum("expected_incremental_profit").alias("expected_profit"), F.sum("expected_revenue").alias("expected_revenue"))
    grid = spark.createDataFrame([(s,) for s in segments], f"{segment} string") if segments else selected.select(segment).distinct()
    if by_intensity:
        grid = grid.crossJoin(spark.createDataFrame([(i,) for i in INTENSITIES], "intervention_intensity string"))
    out = grid.join(g, keys, "left")
    out = out.orderBy(F.expr(segment_order_key(segment)), *[F.expr(f"array_position(array({', '.join(repr(i) for i in INTENSITIES)}), intervention_intensity)")] * by_intensity)  # the display order of a small grid
    return out.selectExpr(*keys, "coalesce(customer_count, 0) AS customer_count", "coalesce(allocated_budget, 0D) AS allocated_budget",
                          "coalesce(expected_profit, 0D) AS expected_profit", "coalesce(expected_revenue, 0D) AS expected_revenue",
                          "coalesce(try_divide(expected_revenue - allocated_budget, allocated_budget), 0D) AS expected_roi")


def segment_order_key(column: str = "uplift_segment") -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{s}' THEN {i}" for i, s in enumerate(SEGMENT_ORDER)) + f" ELSE {len(SEGMENT_ORDER)} END"


def budget_totals(selected: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Spend, count, revenue and profit per budget id, zero where nothing was picked."""
    table = selected.sparkSession.createDataFrame([(b, int(v)) for b, v in budgets.items()], "budget_id string, budget bigint")
    g = selected.groupBy("budget_id").agg(
        F.sum("coupon_cost").alias("spent"), F.count_distinct(KEY).alias("num_targeted"),
        F.sum("expected_revenue").alias("expected_revenue"), F.sum("expected_incremental_profit").alias("expected_incremental_profit"))
    return F.broadcast(table).join(g, "budget_id", "left").na.fill(0)


#: Rounds in which every budget still open takes its next affordable row, before what is left is selected in the general way.
PICK_ROUNDS = 12
_AMOUNTS = ("coupon_cost", "expected_revenue", "expected_incremental_profit")


def budget_curve(candidates: DataFrame, order, budgets: dict[str, int], *, max_customers: int | None = None, high_share: float | None = 0.35, high_base: str = "rows") -> DataFrame:
    """``budget_totals`` of a greedy selection, one action a customer, for many budgets without a row for each candidate and budget.

    Running sums over the customers' first rows, made once, tell every budget where its walk
    stops and what it took until then: one aggregate for each budget over the same frame.
    Beyond its stop a budget holds less than the cost of one row.  Rows that any budget can
    still afford are few as a rule and are walked plainly; else each budget's next
    affordable row is again one aggregate, a round for all of them.  Budgets that their
    first row may not fit into, and those not done after PICK_ROUNDS, go through ``greedy_select``.
    """
    spark = candidates.sparkSession
    pool = candidates.where("coupon_cost > 0").withColumn("_rid", F.monotonically_increasing_id())
    keys = list(dict.fromkeys([n for n, _ in order] + [KEY, *_AMOUNTS]))
    extra = [c for c in ("intervention_intensity",) if c in pool.columns and c not in keys]
    high = "cast(lower(intervention_intensity) = 'high' AS int)" if "intervention_intensity" in pool.columns else "0"
    ranked = row_index(cut_lineage(pool.select(*keys, *extra, "_rid")), [*order, ("_rid", True)], "_pos")
    ranked = cut_lineage(ranked.selectExpr(KEY, "_pos", "cast(round(coupon_cost * 100) AS bigint) AS _cost", f"{high} AS _high", *[f"coalesce({a}, 0D) AS _{i}" for i, a in enumerate(_AMOUNTS)]))
    size = ranked.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(KEY).alias("k"), F.max("_cost").alias("dear"), F.min("_cost").alias("cheap")).first()
    base = max_customers or (size["n"] if high_base == "rows" else size["k"])
    cap = max(1, int(max(base, 1) * high_share)) if high_share else None
    open_ = {b: int(v) * 100 for b, v in budgets.items() if int(v) > 0 and size["n"]}
    slow = {b for b, left in open_.items() if left < size["dear"]}
    walks = {b: {"left": left, "n": 0, "high": 0, "stop": None, "amounts": [0.0] * len(_AMOUNTS), "served": set()} for b, left in open_.items() if b not in slow}
    rows, group = ranked, dict(walks)
    while group:  # a second time at most: without high-intensity rows, once they have reached their share
        shared_walk = next(iter(group.values()))  # up to here all of the group took the same rows
        slots, high_left = max_customers and max_customers - shared_walk["n"], cap and cap - shared_walk["high"]
        names = ["_pos", "_cost", "_high", *[f"_{i}" for i in range(len(_AMOUNTS))]]
        first = rows.groupBy(KEY).agg(F.expr(f"min_by(struct({', '.join(names)}), _pos) AS h")).select(KEY, "h.*")
        sums = {"_c": F.col("_cost"), "_n": F.lit(1).cast("long"), "_h": F.col("_high"), **{f"_a{i}": F.col(f"_{i}") for i in range(len(_AMOUNTS))}}
        cum = cut_lineage(running_totals(_spread(first, size["n"]), [("_pos", True)], sums, range_col="_slice").drop("_slice"))
        upto = ", ".join(["_c - _cost AS c", "_n - 1 AS n", "_h - _high AS h", *[f"_a{i} - _{i} AS a{i}" for i in range(len(_AMOUNTS))]])
        whole = ", ".join(["_c AS c", "_n AS n", "_h AS h", *[f"_a{i} AS a{i}" for i in range(len(_AMOUNTS))]])
        share_used = f"_high = 1 AND _h > {high_left}" if cap else "false"
        full = f"{share_used}{f' OR _n > {slots}' if max_customers else ''}"
        stops = [F.expr(f"min_by(struct(_pos, {share_used} AND _c <= {w['left']}{f' AND _n <= {slots}' if max_customers else ''} AS share, {upto}), _pos) FILTER (WHERE _c > {w['left']} OR {full})").alias(f"s{k}") for k, w in enumerate(group.values())]
        found = cum.agg(F.expr(f"max_by(struct({whole}), _pos)").alias("all"), *stops).first()
        here, later, at = {}, {}, None
        for k, (b, w) in enumerate(group.items()):
            stop = found[f"s{k}"]
            use = stop or found["all"]
            if use is not None:
                w["left"], w["n"], w["high"], w["amounts"] = w["left"] - use["c"], w["n"] + use["n"], w["high"] + use["h"], [x + use[f"a{i}"] for i, x in enumerate(w["amounts"])]
            if stop is not None:
                w["stop"] = w["at"] = stop["_pos"]
                (later if stop["share"] else here)[b] = w
                at = stop["_pos"] if stop["share"] else at
        slow |= _next_picks(rows, cum, here, size["cheap"], max_customers, cap)
        group = later
        if group:
            open_rows = cum.where(F.col("_pos") >= at).select(KEY)
            rows = cut_lineage(rows.where((F.col("_pos") > at) & (F.col("_high") == 0)).join(open_rows, KEY, "left_semi"))
    kinds = "budget_id string, " + ", ".join(f"{a} double" for a in ("spent", "expected_revenue", "expected_incremental_profit")) + ", num_targeted bigint"
    rows = [(b, *map(float, w["amounts"]), int(w["n"])) for b, w in walks.items() if b not in slow]
    table = spark.createDataFrame([(b, int(v)) for b, v in budgets.items()], "budget_id string, budget bigint")
    got = table.join(F.broadcast(spark.createDataFrame(rows, kinds)), "budget_id", "left").select("budget_id", "budget", "spent", "num_targeted", "expected_revenue", "expected_incremental_profit")
    if not slow:
        return got.na.fill(0)
    rest = {b: v for b, v in budgets.items() if b in slow}
    more = budget_totals(greedy_select(candidates, order, rest, max_customers=max_customers, high_share=high_share, high_base=high_base), rest)
    return got.where(~F.col("budget_id").isin(list(slow))).na.fill(0).unionByName(more.select(got.columns))


def _next_picks(ranked: DataFrame, cum: DataFrame, walks: dict, cheapest: int, max_customers: int | None, cap: int | None) -> set[str]:
    """Carries the walks on beyond their stops; returns the budgets that are not done."""
    def alive() -> dict:
        return {b: w for b, w in walks.items() if w["left"] >= cheapest and not (max_customers and w["n"] >= max_customers) and w["at"] is not None}

    def take(w: dict, r) -> None:
        w["left"], w["n"], w["high"], w["at"] = w["left"] - r["_cost"], w["n"] + 1, w["high"] + r["_high"], r["_pos"]
        w["amounts"] = [a + r[f"_{i}"] for i, a in enumerate(w["amounts"])]
        w["served"].add(r[KEY])

    if not alive():
        return set()
    begin, most = min(w["stop"] for w in alive().values()), max(w["left"] for w in alive().values())
    tail = cut_lineage(ranked.where((F.col("_pos") > begin) & (F.col("_cost") <= most)).join(cum.select(KEY, F.col("_pos").alias("_first")), KEY))
    if tail.count() <= WALK_ROWS:
        rows = sorted(tail.collect(), key=lambda r: r["_pos"])
        for w in alive().values():
            for r in rows:
                if r["_pos"] > w["stop"] and r["_first"] >= w["stop"] and r["_cost"] <= w["left"] and r[KEY] not in w["served"] and not (max_customers and w["n"] >= max_customers) and not (r["_high"] and cap and w["high"] >= cap):
                    take(w, r)
        return set()
    for _ in range(PICK_ROUNDS):
        now = alive()
        if not now:
            break
        fits = []
        for w in now.values():
            f = (F.col("_pos") > w["at"]) & (F.col("_first") >= w["stop"]) & (F.col("_cost") <= w["left"])
            f = f & ~F.col(KEY).isin(list(w["served"])) if w["served"] else f
            fits.append(f & (F.col("_high") == 0) if cap and w["high"] >= cap else f)
        found = tail.agg(*[F.min_by(F.when(f, F.struct(*tail.columns)), F.when(f, F.col("_pos"))).alias(f"r{k}") for k, f in enumerate(fits)]).first()
        for k, w in enumerate(now.values()):
            if found[f"r{k}"] is None:
                w["at"] = None
            else:
                take(w, found[f"r{k}"])
    return set(alive())


def budget_scenarios(candidates: DataFrame, order, budget: int, **kw) -> DataFrame:
    budgets = {"50%": int(budget * 0.5), "100%": int(budget), "200%": int(budget * 2)}
    t = budget_curve(candidates, order, budgets, **kw)
    return t.selectExpr("budget_id AS scenario", "budget", "spent", "budget - spent AS remaining", "num_targeted", "expected_revenue",
                        "coalesce(try_divide(expected_revenue - spent, spent), 0D) AS expected_roi")


def sensitivity_grid(base: int, step: int = 1_000_000) -> list[int]:
    base, step = max(int(base), 0), max(int(step), 1)
    wide = base <= 30 * step
    lo = 0 if wide else max(0, base - 10 * step)
    hi = max(10 * step, base + 5 * step) if wide else base + 10 * step
    return sorted({*range(lo, hi + step, step), 0, base, base + step})


# Labels of the marginal return bands.
BAND_START, BAND_FULL, BAND_LOW, BAND_FALLING, BAND_GROW, BAND_STEP = (
    "기준 구간", "포화 또는 낭비 주의", "효율 낮음", "ROI 하락 시작", "확대 검토 가능", "점진 확대 가능")


def budget_sensitivity(candidates: DataFrame, order, base_budget: int, *, step: int = 1_000_000, **kw) -> DataFrame:
    """Marginal profit and ROI per budget level; all levels read the same running sums.

    Equal picks may add up to sums a rounding error apart, so "no added profit" has a tiny margin.
    """
    budgets = {str(b): b for b in sensitivity_grid(base_budget, step)}
    t = budget_curve(candidates, order, budgets, **kw).selectExpr(
        "budget", "spent", "greatest(budget - spent, 0D) AS remaining", "num_targeted AS target_count", "expected_incremental_profit",
        "coalesce(try_divide(expected_incremental_profit, spent), 0D) AS average_roi")
    # a few dozen budget levels: one small window
    w = W.partitionBy(F.lit(1)).orderBy("budget")
    prev = {n: F.lag(n).over(w) for n in ("budget", "spent", "target_count", "expected_incremental_profit", "average_roi")}
    t = t.select("*", *[c.alias(f"_p_{n}") for n, c in prev.items()])
    diff = lambda n: f"coalesce({n} - _p_{n}, 0)"
    t = t.selectExpr("*", f"{diff('budget')} AS added_budget", f"{diff('spent')} AS added_spend", f"{diff('target_count')} AS added_target_count",
                     f"{diff('expected_incremental_profit')} AS added_profit")
    t = t.selectExpr("*", "CASE WHEN added_budget > 0 THEN added_profit / added_budget * 1000000 ELSE 0D END AS marginal_profit_per_1m",
                     "CASE WHEN added_spend > 0 THEN added_profit / added_spend ELSE 0D END AS marginal_roi")
    return t.withColumn("budget_status", F.expr(
        f"CASE WHEN _p_budget IS NULL THEN '{BAND_START}' WHEN added_profit <= 1e-6 AND added_target_count <= 0 THEN '{BAND_FULL}' "
        f"WHEN marginal_roi < 0.2 THEN '{BAND_LOW}' WHEN average_roi < _p_average_roi THEN '{BAND_FALLING}' "
        f"WHEN marginal_roi >= average_roi THEN '{BAND_GROW}' ELSE '{BAND_STEP}' END")).drop(*[f"_p_{n}" for n in prev])


def sensitivity_summary(table: DataFrame, base_budget: int, *, step: int = 1_000_000) -> DataFrame:
    """Saturation and low-efficiency points and the gain of the next step."""
    best = table.agg(F.expr("greatest(max(marginal_profit_per_1m) * 0.15, 0D) AS _thr"), F.expr("max(marginal_profit_per_1m) > 0 AS _any"))
    t = table.crossJoin(F.broadcast(best))
    sat = "budget > 0 AND marginal_profit_per_1m <= _thr"
    return t.agg(*[F.expr(x) for x in (
        f"{int(base_budget)} AS current_budget",
        f"min_by(spent, struct(abs(budget - {base_budget}), budget)) AS current_spent",
        f"min_by(target_count, struct(abs(budget - {base_budget}), budget)) AS current_target_count",
        f"min_by(expected_incremental_profit, struct(abs(budget - {base_budget}), budget)) AS current_expected_profit",
        f"min_by(marginal_roi, struct(abs(budget - {base_budget}), budget)) AS current_marginal_roi",
        f"coalesce(min_by(added_profit, budget) FILTER (WHERE budget >= {base_budget + step}), 0D) AS next_step_profit_gain",
        f"coalesce(min(budget) FILTER (WHERE {sat} AND added_target_count <= 0), min(budget) FILTER (WHERE {sat} AND _any)) AS saturation_budget",
        "min(budget) FILTER (WHERE budget > 0 AND (marginal_roi < 0.2 OR marginal_profit_per_1m <= 0)) AS low_efficiency_budget")])


def budget_summary(candidates: DataFrame, selected: DataFrame, budget: int) -> DataFrame:
    c = candidates.agg(F.count_distinct(KEY).alias("candidate_customers"), F.count(F.lit(1)).alias("candidate_actions"),
                       F.avg("timing_urgency_score").alias("avg_timing_urgency_score"))
    s = selected.agg(
        F.expr("coalesce(sum(coupon_cost), 0D) AS spent"), F.count_distinct(KEY).alias("num_targeted"),
        F.expr("coalesce(sum(expected_incremental_profit), 0D) AS expected_incremental_profit"),
        *[F.expr(f"count_if(intervention_intensity = '{i}') AS n_{i}") for i in INTENSITIES])
    return s.crossJoin(c).selectExpr(
        f"{int(budget)} AS budget", "cast(bround(spent, 0) AS bigint) AS spent", f"cast(bround({int(budget)} - spent, 0) AS bigint) AS remaining", "num_targeted",
        "candidate_customers", "candidate_actions", f"spent >= {int(budget)} * 0.98 AS budget_binding", "expected_incremental_profit",
        "coalesce(try_divide(expected_incremental_profit, spent), 0D) AS overall_roi", "n_low", "n_mid", "n_high", "avg_timing_urgency_score")


BASELINE_ORDER = [("baseline_priority_score", False), ("expected_roi", False), ("expected_incremental_profit", False), ("churn_probability", False),
                  ("clv", False), ("customer_id", True)]


def baseline_candidates(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Profit and uplift only: the comparison without timing and intensity."""
    c = df.where(f"churn_probability >= {threshold} AND uplift_score > 0 AND coupon_cost > 0 AND expected_incremental_profit > 0")
    c = min_max_scaled(c, {"_r": "expected_roi", "_p": "expected_incremental_profit", "_u": "uplift_score", "_v": "clv"})
    return c.withColumn("baseline_priority_score", F.expr(
        "0.40 * _r + 0.25 * _p + 0.15 * churn_probability + 0.10 * _u + 0.10 * _v")).drop("_r", "_p", "_u", "_v")


def baseline_budget(df: DataFrame, budget: int, *, threshold: float = 0.5, max_customers: int | None = None) -> DataFrame:
    c = baseline_candidates(df, threshold)
    if max_customers:
        c = c.orderBy(*[F.col(n) if asc else F.desc(n) for n, asc in BASELINE_ORDER]).limit(max_customers)
    return select_under_budget(c, BASELINE_ORDER, budget, high_share=None)
