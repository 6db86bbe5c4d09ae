"""Cohort activity: one grouping of the log whatever the number of definitions."""

import datetime as dt
import random

from tidemark.operators import cohorts as co


def test_activity_is_grouped_once_and_counts_equal_the_plain_ones(spark, monkeypatch):
    rng = random.Random(3)
    types = ["visit", "page_view", "purchase", "coupon_redeem", "support_contact", "other", None]
    rows = [(rng.choice([1, 2, 3, 4, None]), dt.datetime(2020, rng.randint(1, 6), 5), rng.choice(types)) for _ in range(200)]
    events = spark.createDataFrame(rows, "customer_id long, timestamp timestamp_ntz, event_type string")
    customers = spark.createDataFrame([(i, "2020-01") for i in range(1, 5)], "customer_id long, acquisition_month string")
    written, keep = [], co.cut_lineage
    monkeypatch.setattr(co, "cut_lineage", lambda df: (written.append(df), keep(df))[1])
    got = co.cohort_retention_all(customers, events, periods=6, modes=("point",), min_events=3).collect()
    active = next(df for df in written if "activity_definition" in df.columns)
    assert sum(" Aggregate [" in f" {x.lstrip(' :+-')}" for x in active._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1
    for r in got:
        if r.period and r.observed:
            n = [sum(c == i and t.month == r.period + 1 and k in co.ACTIVITY_PRESETS[r.activity_definition] for c, t, k in rows) for i in range(1, 5)]
            assert r.retained_customers == sum(x >= 3 for x in n)
