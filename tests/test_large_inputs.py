"""Steps that read their input once, however large, with the results of a plain walk."""

import datetime as dt
import random
import statistics

import pytest

from tidemark.operators import churn_model as cm, features as fe, onboarding as ob, uplift as up

T0 = dt.datetime(2020, 1, 1)


def scans(df):
    return sum("Relation [" in x or "Scan ExistingRDD" in x for x in df._jdf.queryExecution().executedPlan().toString().splitlines())


def recorded(monkeypatch, module):
    """Frames that the module writes, as they are before they are written."""
    seen, write = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: (seen.append(df), write(df))[1])
    return seen


def cycles(rows):
    out = {}
    for c in {r[0] for r in rows if r[0] is not None}:
        ts = sorted(t for k, t, _ in rows if k == c and t)
        gaps = [(b - a).total_seconds() / 86400 for a, b in zip(ts, ts[1:])]
        if gaps := [g for g in gaps if 0 < g <= 365]:
            out[c] = sum(gaps) / len(gaps)
    return out


@pytest.mark.parametrize("share", [0.5, 0.0])
def test_churn_days_sort_the_times_once(spark, monkeypatch, share):
    rng = random.Random(5)
    rows = [(rng.choice([*range(9), None]), T0 + dt.timedelta(seconds=rng.choice([3600, 86400, 9 * 86400]) * rng.randint(0, 80)), "purchase" if rng.random() < share else rng.choice(["visit", None]))
            for _ in range(400)] + [(1, None, "purchase"), (2, T0 + dt.timedelta(days=4000), "visit")]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "customer_id long, ts timestamp_ntz, kind string").coalesce(2)
    seen = recorded(monkeypatch, ob)
    got = ob.recommend_churn_days(df, event_type="kind").first()
    want = statistics.median(cycles([r for r in rows if r[2] == "purchase"] if share else rows).values())
    assert got["median_cycle_days"] == pytest.approx(want) and got["churn_days"] == max(7, min(180, round(want * 1.75)))
    assert [scans(x) for x in seen] == [1] * (1 if share else 2)


def test_churn_days_without_enough_customers(spark):
    few = spark.createDataFrame([(1, T0, "purchase"), (1, T0 + dt.timedelta(days=3), "purchase"), (2, T0, "visit")], "customer_id long, ts timestamp_ntz, kind string")
    assert tuple(ob.recommend_churn_days(few, event_type="kind").first()) == tuple(ob.recommend_churn_days(few.where("false")).first()) == (None, 7)


@pytest.mark.parametrize("learner", [up.t_learner, up.s_learner, up.dr_learner])
def test_learners_compute_their_rows_once(spark, learner):
    read = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(i, float(i % 7), i % 2, int(i % 7 > 3)) for i in range(300)], 2)
    train = spark.createDataFrame(rows.map(lambda r: (read.add(1), r)[1]), "customer_id long, x double, treatment_flag int, retained_60d int")
    col = f"uplift_score_{learner.__name__}"
    got = learner(train, train, ["x"]).select("customer_id", col).collect()
    assert read.value == 300 and sorted(r[0] for r in got) == list(range(300)) and all(-1 <= r[1] <= 1 for r in got)
    few = learner(train, spark.createDataFrame([(1, 2.0), (1, None)], "customer_id long, x double"), ["x"])
    assert few.count() == 2 and "retained_60d" not in few.columns


def counted(spark, rows, schema):
    """A frame and the number of its rows that were computed."""
    read = spark.sparkContext.accumulator(0)
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(lambda r: (read.add(1), r)[1]), schema), read


def test_feature_frame_goes_over_all_events_twice(spark):
    end = dt.datetime(2020, 6, 1)
    ev = [(c, end - dt.timedelta(days=d, hours=c), k, f"{c}-{d}") for c in range(4) for d, k in ((-20, "visit"), (3, "visit"), (89, "search"), (91, "visit"), (400, "purchase")) if c < 2 or d > 90]
    events, read = counted(spark, ev, "customer_id long, timestamp timestamp_ntz, event_type string, session_id string")
    customers = spark.createDataFrame([(c, dt.datetime(2019, 1, 1)) for c in range(5)], "customer_id long, signup_date timestamp_ntz")
    orders = spark.createDataFrame([(1, 0, end - dt.timedelta(days=5), 10.0, 1.0, 0)], "order_id long, customer_id long, order_time timestamp_ntz, net_amount double, quantity double, coupon_used int")
    exposures = spark.createDataFrame([], "customer_id long, exposure_time timestamp_ntz, coupon_cost double")
    df, _ = fe.build_customer_features(customers, events, orders, exposures, as_of=str(end), clusters=None, finish=False)
    got = {r.customer_id: r for r in df.collect()}
    assert df.columns[df.columns.index("visits_14d") - 1] == "days_since_last_event"
    assert read.value <= 2 * len(ev)
    assert [got[c].visits_90d for c in range(5)] == [1, 1, 0, 0, 0] and [got[c].total_events for c in range(5)] == [2, 2, None, None, None]
    assert [round(got[c].days_since_last_event, 3) for c in range(5)] == [3.0, 3.042, 91.083, 91.125, 999.0]
    assert got[0].recent_event_sequence == "purchase > visit > search > visit" and got[4].recent_event_sequence == "no_history" and [got[c].label for c in range(5)] == [0, 0, 1, 1, 1]


def test_churn_table_is_computed_once(spark):
    rows = [(i, i % 2, float(i % 5), "ab"[i % 3 > 0], f"t{i}", T0 + dt.timedelta(days=i)) for i in range(120)]
    df, read = counted(spark, rows, "customer_id long, label int, x double, persona string, remark string, signup_date timestamp_ntz")
    rest, fate = cm.churn_columns(df)
    assert rest.count() == 120 and read.value == 120
    assert fate["x"] == "numeric" and fate["persona"] == "category" and fate["remark"] == "leakage" and fate["signup_date_year"] == "constant"
