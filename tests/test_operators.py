import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohorts as co, experiments as ex, features as fe, journey as jo, live as lv, onboarding as ob, survival as sv, uplift as up
from tidemark.operators import clv as cl, churn_model as cm, decisions as de


def frame(spark, rows, ddl, *times):
    df = spark.createDataFrame(rows, ddl)
    return df.withColumns({t: F.expr(f"cast({t} AS timestamp_ntz)") for t in times})


def test_window_is_open_at_start_and_closed_at_end(spark):
    o = frame(spark, [(1, "2024-01-01 00:00:00"), (1, "2024-01-31 00:00:00")], "customer_id bigint, order_time string", "order_time")
    assert fe.window_counts(o, "order_time", "2024-01-31 00:00:00", {"n": (30, 0, None)}).first()["n"] == 1


def test_clv_window_is_inclusive(spark):
    o = frame(spark, [(1, "a", "2024-01-02 10:00:00", 5.0), (1, "b", "2024-01-01 23:00:00", 7.0)], "customer_id bigint, order_id string, order_time string, net_amount double", "order_time")
    c = frame(spark, [(1, "2023-01-01 00:00:00")], "customer_id bigint, signup_date string", "signup_date")
    assert cl.clv_features(c, o, "2024-01-31 00:00:00").first()["w30_spend"] == 5.0


def test_dominant_type_tie_is_alphabetical(spark):
    e = frame(spark, [(1, "2024-01-02 00:00:00", t) for t in ("visit", "search", "visit", "search")], "customer_id bigint, timestamp string, event_type string", "timestamp")
    assert fe.dominant_event_type(e, "2024-01-10 00:00:00").first()["dominant_event_type_90d"] == "search"


def test_winsorize_fills_with_median_of_raw_values(spark):
    df = spark.createDataFrame([(i, float(i) if i else None, None) for i in range(0, 102)], "customer_id bigint, x double, s string")
    got = {r["customer_id"]: (r["x"], r["s"]) for r in fe.winsorize_impute(df)[0].collect()}
    assert got[0] == (51.0, "unknown") and got[1][0] == 2.0 and got[101][0] == 100.0


def test_rolling_and_point_retention(spark):
    c = spark.createDataFrame([(1, "2024-01")], "customer_id bigint, acquisition_month string")
    e = frame(spark, [(1, "2024-01-05 00:00:00", "visit"), (1, "2024-04-05 00:00:00", "visit")], "customer_id bigint, timestamp string, event_type string", "timestamp")
    got = {(r["retention_mode"], r["period"]): r["retention_rate"] for r in co.cohort_retention_all(c, e, periods=5).where("activity_definition = 'core_engagement'").collect()}
    assert [got["rolling", p] for p in range(5)] == [1, 1, 1, 1, None]
    assert [got["point", p] for p in range(5)] == [1, 0, 0, 1, None]


def test_final_churn_run_is_the_tail(spark):
    st = ["active", "churn_risk", "active", "churn_risk", "churn_risk"]
    s = frame(spark, [(1, f"2024-01-0{i + 1} 00:00:00", x) for i, x in enumerate(st)] + [(2, "2024-01-01 00:00:00", "active")], "customer_id bigint, snapshot_date string, current_status string", "snapshot_date")
    r = jo.final_churn_run(s).collect()
    assert len(r) == 1 and str(r[0]["final_churn_start_date"])[:10] == "2024-01-04"


def test_repeats_collapse(spark):
    e = frame(spark, [(1, f"2024-01-0{i + 1} 00:00:00", x) for i, x in enumerate("aabba")], "customer_id bigint, timestamp string, event_type string", "timestamp")
    assert jo.compressed_sequences(e).first()["pattern"] == "a > b > a"


def test_gap_event_and_prevalent_churn(spark):
    c = frame(spark, [(1, "2024-01-01 00:00:00"), (2, "2023-01-01 00:00:00")], "customer_id bigint, signup_date string", "signup_date")
    a = frame(spark, [(1, "2024-01-01 00:00:00"), (1, "2024-02-20 00:00:00"), (2, "2023-11-01 00:00:00")], "customer_id bigint, activity_time string", "activity_time")
    g = sv.activity_gap_events(c, a, "2024-01-11 00:00:00", horizon=90, threshold=30).collect()
    assert [(r["customer_id"], str(r["event_date"])[:10]) for r in g] == [(1, "2024-01-31")]


def test_concordance_against_pairs(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0.1, 0.5, rng.random()]), rng.randint(1, 6), rng.randint(0, 1)) for i in range(80)]
    df = spark.createDataFrame(rows, "customer_id bigint, predicted_hazard_ratio double, duration_days int, event_observed int")
    n = good = 0
    for a, b in itertools.product(rows, rows):
        if a[3] == 1 and (b[2] > a[2] or (b[2] == a[2] and b[3] == 0)):
            n += 1
            good += 1 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0
    r = sv.concordance_index(df).first()
    assert r["comparable_pairs"] == n and abs(r["concordance_index"] - good / n) < 1e-12


def test_cox_recovers_direction_and_matches_gradient_zero(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        x = rng.gauss(0, 1)
        t = rng.expovariate(0.05 * 2.718 ** (0.8 * x))
        rows.append((i, min(int(t) + 1, 30), int(t < 30), x, rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "customer_id bigint, duration_days int, event_observed int, x double, z double")
    fit = sv.cox_fit(df, ["x", "z"], penalizer=0.0)
    assert 0.6 < fit["betas"]["x"][0] / fit["betas"]["x"][2] < 1.0 and abs(fit["betas"]["z"][0]) < 0.2
    assert all(b >= a for a, b in zip(fit["baseline"], fit["baseline"][1:]))


def test_cox_without_convergence_is_an_error(spark):
    rows = [(i, 1 + i % 7, i % 2, float(i % 5), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "customer_id bigint, duration_days int, event_observed int, x double, z double")
    with pytest.raises(ValueError, match="did not converge"):
        sv.cox_fit(df, ["x", "z"], max_iter=1)


def test_efron_sums_do_not_depend_on_the_block(monkeypatch):
    f = np.arange(1000) / 1000
    d = 5000.0 - f * 900.0
    want = [np.log(d).sum(), (1 / d).sum(), (f / d).sum(), (1 / d**2).sum(), (f / d**2).sum(), (f * f / d**2).sum()]
    monkeypatch.setattr(sv, "EFRON_BLOCK", 7)
    assert np.allclose(sv._efron(1000, 5000.0, 900.0), want, rtol=1e-12)


def test_qini_small_case(spark):
    rows = [(1, 0.9, 1, 1), (2, 0.8, 0, 0), (3, 0.7, 1, 1), (4, 0.6, 1, 0)]
    c = up.qini_curve(spark.createDataFrame(rows, "customer_id bigint, uplift_score double, retained_60d int, treatment_flag int")).orderBy("k").collect()
    assert [round(r["qini_gain"], 6) for r in c] == [1.0, 2.0, 3.0, 2.0]


def test_yates_chi_square(spark):
    rows = [(i, "treatment", int(i >= 10), 1.0, 0.0) for i in range(100)] + [(200 + i, "control", int(i >= 20), 1.0, 0.0) for i in range(100)]
    r = ex.ab_test(spark.createDataFrame(rows, "customer_id bigint, treatment_group string, retained_60d int, coupon_cost double, revenue_post_60d double")).first()
    assert abs(r["chi_square"] - 3.176471) < 1e-6 and 0.04 < r["p_value"] < 0.06 and 0.3 < r["achieved_power"] < 0.7


def test_decay_of_support_signal(spark):
    e = frame(spark, [(1, 1, "2024-01-01 00:00:00", "support_contact"), (1, 2, "2024-01-04 00:00:00", "support_contact")], "customer_id bigint, event_id bigint, timestamp string, event_type string", "timestamp")
    assert abs(lv.decayed_signals(e).first()["support_signal"] - 1.5) < 1e-12
    last = lv.states_per_event(e).where("event_id = 2").first()
    assert abs(last["support_signal"] - 1.5) < 1e-12


def test_cold_customer(spark):
    s = spark.createDataFrame([(1, 3, 100.0)], "customer_id bigint, event_count_total bigint, revenue double")
    r = lv.cold_scores(s).first()
    assert abs(r["churn_score"] - 0.42) < 1e-9 and r["clv"] == 600 and r["uplift_score"] == 0.12 and r["risk_segment"] == "new"


def test_three_intensities_give_three_rows(spark):
    df = spark.createDataFrame([(1, 1000.0, 500.0, 0.1, 0.6)], "customer_id bigint, coupon_cost double, expected_incremental_profit double, uplift_score double, churn_probability double")
    a = de.action_candidates(df).collect()
    assert sorted(r["coupon_cost"] for r in a) == [650.0, 1000.0, 1450.0] and len({r["action_id"] for r in a}) == 3


def test_event_words(spark):
    want = {"Checkout Complete": "purchase", "mobile_banking_login": "visit", "product view": "page_view", "rate-search": "search", "Refund_Request": "support_contact", "added_to_cart": "add_to_cart",
            "unsubscribe": "support_contact", "결제완료": "purchase", "계좌조회": "visit", "xyz": "other", "NPS": "support_contact", "": "other"}
    got = {r["raw"]: r["event_type"] for r in ob.event_type_map(spark.createDataFrame([(k,) for k in want], "raw string")).collect()}
    assert got == want


def test_column_roles(spark):
    df = spark.createDataFrame([("a1", "2024-01-01", 1.0, "Y")] * 3, "cust_no string, when_seen string, total_price double, zzq string")
    got = {r["column_name"]: (r["role"], r["confidence"]) for r in ob.detect_column_roles(df).collect()}
    assert got["cust_no"] == ("customer_id", 1.0) and got["total_price"][0] == "amount" and got["zzq"] == ("potential_binary", 0.3)


def test_churn_estimate_is_deterministic_and_bounded(spark):
    df = spark.range(60).selectExpr("id AS customer_id", "id % 30 AS recency_days", "60 - id AS frequency", "id * 10D AS monetary")
    a, b = (sorted((r["customer_id"], r["churn_probability"]) for r in ob.estimate_churn_probability(df).collect()) for _ in range(2))
    assert a == b and all(0.02 <= p <= 0.82 for _, p in a)


def test_leaky_names():
    assert cm.name_leaks("churn_probability") and cm.name_leaks("ext_num__future_spend_sum") and not cm.name_leaks("frequency_90d")
    assert not cm.name_leaks("recency_days") and cm.name_leaks("recency_days", "inactivity_rule")


def test_uploads_lose_no_rows(spark):
    df = spark.createDataFrame([(i, 7, i * 60, ["checkout now", None, "mobile_banking_login_transfer_ok", "insurance_apply_start", "zzz"][i % 5]) for i in range(40)], "row_id bigint, customer_id bigint, s bigint, action string").selectExpr(
        "row_id", "customer_id", "cast(timestamp_seconds(s) AS timestamp_ntz) AS ts", "action")
    got = ob.extract_events(df, event_type="action").collect()
    assert len(got) == 40 and sorted(r["event_id"] for r in got) == sorted(f"EVT-{i}" for i in range(40))
    by = {r["event_type_original"]: r["event_type"] for r in got}
    assert by == {"checkout now": "purchase", None: "other", "mobile_banking_login_transfer_ok": "visit", "insurance_apply_start": "other", "zzz": "other"}
    assert ob.event_type_map(spark.createDataFrame([("card_statement_view",)], "raw string")).first()["event_type"] == "page_view"


def test_ids_with_a_common_prefix_are_coded_in_order(spark):
    df = spark.createDataFrame([(f"CUSTOMER-{i:05d}",) for i in range(500)], "name string")
    got = {r["customer_id_original"]: r["customer_id"] for r in ob.encode_customer_id(df, "name").collect()}
    assert [got[f"CUSTOMER-{i:05d}"] for i in range(500)] == list(range(1, 501))


def test_topk_of_a_large_catalog_equals_the_whole_one(spark, monkeypatch):
    from tidemark.operators import recommend as rc

    rng = random.Random(6)
    cats = [f"c{i:02d}" for i in range(40)]
    o = frame(spark, [(rng.randrange(25), rng.choice(cats[:30]), f"2024-01-{rng.randint(1, 28):02d} 00:00:00", round(rng.uniform(1, 90), 2), 1.0) for _ in range(300)] + [(0, c, "2024-01-05 00:00:00", 9.0, 1.0) for c in cats],
              "customer_id bigint, item_category string, order_time string, net_amount double, quantity double", "order_time")
    e = frame(spark, [(rng.randrange(25), rng.choice(cats), f"2024-01-{rng.randint(1, 28):02d} 00:00:00", "search") for _ in range(200)], "customer_id bigint, item_category string, timestamp string, event_type string", "timestamp")
    s = spark.createDataFrame([(c, rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.random()) for c in range(30)], "customer_id bigint, persona string, uplift_segment string, coupon_affinity double")
    rows = lambda: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rc.recommend_topk(s, o, e, s, 4).collect())
    whole = rows()
    monkeypatch.setattr(rc, "CATALOG_ROWS", 0)
    assert rows() == whole and len(whole) == 120


def test_long_column_names_that_meet_get_a_number():
    long = "x" * 70
    names = ob.slugs([long + "a", long + "b", "A b", "a-b", "c"])
    assert len(set(names.values())) == 5 and names["A b"] == "a_b" and names["a-b"] == "a_b_2" and all(len(n) <= 64 for n in names.values())


def test_concordance_equals_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, round(rng.choice([rng.random(), 0.5]), 2), rng.randint(1, 12), rng.randint(0, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "customer_id bigint, predicted_hazard_ratio double, duration_days int, event_observed int")
    got = sv.concordance_index(df).first()
    pairs = [(a[1] > b[1]) + 0.5 * (a[1] == b[1]) for a in rows if a[3] for b in rows if b[2] > a[2] or b[2] == a[2] and not b[3]]
    assert got["comparable_pairs"] == len(pairs) and abs(got["concordance_index"] - sum(pairs) / len(pairs)) < 1e-12
    assert sv.concordance_index(df.where("event_observed = 0")).first()["comparable_pairs"] == 0
