import random

import pytest

from tidemark.operators import budget as bu

ORDER = [("score", False), ("customer_id", True), ("coupon_cost", True)]


def walk(rows, budget, cap=None, high_cap=None, one=True):
    rows = sorted(rows, key=lambda r: (-r[3], r[0], r[2]))
    used, left, high, out = set(), round(budget * 100), 0, []
    for c, i, cost, _ in rows:
        if cap and len(out) >= cap:
            break
        cents = round(cost * 100)
        if (one and c in used) or cents <= 0 or cents > left or (i == "high" and high_cap is not None and high >= high_cap):
            continue
        out.append((c, i, cost))
        used.add(c)
        left -= cents
        high += i == "high"
    return sorted(out)


def run(spark, rows, budget, **kw):
    df = spark.createDataFrame(rows, "customer_id bigint, intervention_intensity string, coupon_cost double, score double")
    df = df.selectExpr("*", "1D AS expected_revenue", "1D AS expected_incremental_profit")
    return sorted((r["customer_id"], r["intervention_intensity"], r["coupon_cost"]) for r in bu.select_under_budget(df, ORDER, budget, **kw).collect())


def test_skips_unaffordable_and_goes_on(spark):
    rows = [(1, "low", 8.0, 3.0), (2, "low", 5.0, 2.0), (3, "low", 2.0, 1.0)]
    assert run(spark, rows, 10) == [(1, "low", 8.0), (3, "low", 2.0)]


def test_second_action_of_a_customer_is_taken(spark):
    assert run(spark, [(1, "mid", 20.0, 3.0), (1, "low", 6.0, 2.0)], 10) == [(1, "low", 6.0)]


def test_high_cap(spark):
    rows = [(1, "high", 2.0, 3.0), (2, "high", 2.0, 2.0), (3, "low", 2.0, 1.0)]
    assert run(spark, rows, 100, max_customers=3, high_share=0.35) == [(1, "high", 2.0), (3, "low", 2.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sequential_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(c, i, round(rng.uniform(1, 40), 2) * k, float(rng.randint(0, 30))) for c in range(120) for i, k in (("low", 0.65), ("mid", 1.0), ("high", 1.45))]
    rows = [(c, i, round(x, 2), s) for c, i, x, s in rows]
    assert run(spark, rows, 500, max_customers=40) == walk(rows, 500, 40, max(1, int(40 * 0.35)))
    assert run(spark, rows, 900, high_share=None) == walk(rows, 900)
    assert run(spark, rows, 300, one_per_customer=False, high_share=None) == walk(rows, 300, one=False)


def test_sensitivity_grid():
    assert bu.sensitivity_grid(5_000_000)[:3] == [0, 1_000_000, 2_000_000] and 10_000_000 in bu.sensitivity_grid(5_000_000)
    assert min(bu.sensitivity_grid(50_500_000)[1:]) == 40_500_000


def test_equal_rows_stay_within_the_budget(spark):
    row = (1, "low", 100.0, 0.9, 500.0)
    schema = "customer_id bigint, intervention_intensity string, coupon_cost double, expected_roi double, expected_incremental_profit double"
    df = spark.createDataFrame([row, row, row, (2, "low", 100.0, 0.8, 400.0)], schema)
    order = [("expected_roi", False), ("customer_id", True)]
    got = bu.select_under_budget(df, order, 150, high_share=None).collect()
    assert [(r["customer_id"], r["coupon_cost"]) for r in got] == [(1, 100.0)]
    assert len(bu.select_under_budget(df, order, 500, high_share=None).collect()) == 2


def test_rounds_and_the_closing_walk_pick_the_same(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(rng.randint(1, 120), rng.choice(["low", "mid", "high"]), float(rng.randint(1, 90)), rng.random(), float(rng.randint(1, 999))) for _ in range(400)]
    schema = "customer_id bigint, intervention_intensity string, coupon_cost double, expected_roi double, expected_incremental_profit double"
    df = spark.createDataFrame(rows, schema)
    order, budgets = [("expected_roi", False), ("customer_id", True)], {"a": 40, "b": 700, "c": 2500, "d": 10 ** 6}
    pick = lambda: sorted((r["budget_id"], r["customer_id"], r["coupon_cost"], r["expected_roi"]) for r in bu.greedy_select(df, order, budgets, high_share=0.1).collect())
    short = pick()
    monkeypatch.setattr(bu, "WALK_ROWS", -1)
    assert pick() == short and {b for b, *_ in short} == set(budgets)


@pytest.mark.parametrize("seed, walk_rows", [(3, 0), (4, 20_000)])
def test_curve_equals_the_walk_for_every_budget(spark, monkeypatch, seed, walk_rows):
    monkeypatch.setattr(bu, "WALK_ROWS", walk_rows)
    rng = random.Random(seed)
    rows = [(c, i, round(rng.uniform(1, 40) * k, 2), float(rng.randint(0, 30))) for c in range(90) for i, k in (("low", 0.65), ("mid", 1.0), ("high", 1.45))]
    df = spark.createDataFrame(rows, "customer_id bigint, intervention_intensity string, coupon_cost double, score double").selectExpr("*", "coupon_cost * 3 AS expected_revenue", "coupon_cost + 1 AS expected_incremental_profit")
    budgets = {str(b): b for b in (0, 20, 100, 333, 900, 2000, 100_000)}
    for cap, share in ((None, 0.35), (30, 0.2), (None, None), (25, None)):
        got = {r["budget_id"]: r for r in bu.budget_curve(df, ORDER, budgets, max_customers=cap, high_share=share).collect()}
        base = cap or len(rows)
        for b, v in budgets.items():
            want = walk(rows, v, cap, max(1, int(base * share)) if share else None)
            spent = sum(x for _, _, x in want)
            assert got[b]["num_targeted"] == len(want) and abs(got[b]["spent"] - spent) < 1e-6 and abs(got[b]["expected_revenue"] - 3 * spent) < 1e-6 and abs(got[b]["expected_incremental_profit"] - spent - len(want)) < 1e-6, (b, cap, share)
    empty = bu.budget_curve(df.limit(0), ORDER, budgets).collect()
    assert len(empty) == len(budgets) and all(r["num_targeted"] == 0 and r["spent"] == 0 for r in empty)
