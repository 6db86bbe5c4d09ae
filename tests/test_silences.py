"""Silences from sums per day: events read once, equal events counted together, the first day that calls for attention."""

import datetime as dt
import math
import random

from tidemark.operators import live as lv

T0 = dt.datetime(2020, 1, 1)


def plain(events, base, until):
    out = []
    for c in sorted({e[0] for e in events}):
        mine = [e for e in events if e[0] == c]
        times = sorted({e[1] for e in mine})
        b = base.get(c, 0.5)
        for t, nxt in zip(times, times[1:] + [None]):
            sig = {s: sum(0.5 ** ((t - x).total_seconds() / 3600 / h) for _, x, _, kind in mine if kind == k and x <= t) for s, k, h, _ in lv.SIGNALS}
            for k in range(lv.IDLE_DAYS, lv.KEPT_DAYS):
                worn = {s: sig[s] * 0.5 ** (k * 24 / h) for s, _, h, _ in lv.SIGNALS}
                score = min(max(b + 0.22 / (1 + math.exp(-(k - 7) / 3)) + sum(w * worn[s] for s, _, _, w in lv.SIGNALS), 0.001), 0.999)
                if worn["purchase_signal"] <= 0.10 and score >= 0.65:
                    at = t + dt.timedelta(days=k)
                    if at < nxt if nxt else at <= until:
                        out.append((c, at, float(k), round(score, 6)))
                    break
    return out


def test_silences_equal_the_plain_walk_and_events_are_read_once(spark, tmp_path):
    rng = random.Random(4)
    kinds = [t for _, t, _, _ in lv.SIGNALS] + ["page_view", None]
    events = []
    for c in range(30):
        t = T0 + dt.timedelta(days=rng.randint(0, 40))
        for _ in range(25):
            t += dt.timedelta(hours=rng.choice([0, 3, 30, 400, 900, 9000]))
            events += [(c, t, rng.randint(0, 3), rng.choice(kinds))] * rng.choice([1, 1, 2])  # equal rows count as often as they come
    base = {c: 0.3 + 0.03 * c for c in range(20)}
    until = max(e[1] for e in events) - dt.timedelta(days=20)
    schema = "customer_id long, timestamp timestamp_ntz, event_id long, event_type string"
    spark.createDataFrame(events + [(None, T0, 1, "visit"), (3, None, 1, "visit")], schema).write.parquet(str(tmp_path / "e"))
    known = spark.createDataFrame(list(base.items()) * 2, "customer_id long, churn_probability double")
    got = lv.silent_customers(spark.read.parquet(str(tmp_path / "e")), f"timestamp_ntz'{until}'", known)
    rows = [(r.customer_id, r.timestamp, r.days_since_last_event, round(r.realtime_churn_score, 6)) for r in got.collect()]
    assert sorted(rows) == sorted(plain(events, base, until)) and len(rows) > 50
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in x for x in plan.splitlines()) == 1
