import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import live as lv
from tidemark.streaming import ledger as sl, sources as ss, state as st

COLS = ["customer_id", "event_id", "prev_score", "realtime_churn_score", "support_signal", "purchase_signal", "trigger_reason"]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rng = random.Random(7)
    types = ["visit", "purchase", "support_contact", "remove_from_cart", "page_view"]
    rows = [(i, rng.choice([1, 1, 2, 3]), 1_700_000_000 + i * 5000 + rng.randint(0, 999), rng.choice(types), 10.0) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, customer_id bigint, s bigint, event_type string, amount double").selectExpr(
        "event_id", "customer_id", "timestamp_seconds(s) AS timestamp", "event_type", "amount")
    path = str(tmp_path_factory.mktemp("log"))
    for k in range(3):
        df.where(f"event_id >= {k * 100} AND event_id < {(k + 1) * 100}").coalesce(1).write.mode("append").parquet(path)
    return path, df


def collect_stream(stream, tmp, mode="append"):
    got = []
    ss.replay(stream, lambda df, i: got.extend(df.collect()), str(tmp), mode)
    return got


def rounded(rows):
    return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in COLS) for r in rows)


def test_stream_equals_batch(spark, log, tmp_path):
    path, df = log
    got = collect_stream(st.scored_stream(ss.event_stream(spark, path, files_per_trigger=1, watermark="100 days")).select(*COLS), tmp_path)
    want = lv.scored_events(df.withColumn("timestamp", F.expr("cast(timestamp AS timestamp_ntz)"))).select(*COLS).collect()
    assert rounded(got) == rounded(want) and len(got) == 300


def test_same_source_event_counts_once(spark, log, tmp_path):
    path, df = log
    twice = str(tmp_path / "twice")
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(twice)
    s = ss.unique_events(ss.event_stream(spark, twice, files_per_trigger=1, watermark="100 days"))
    assert len(collect_stream(s, tmp_path / "cp")) == 300


def test_counters_keep_growing(spark, log, tmp_path):
    path, df = log
    rows = collect_stream(st.counter_stream(ss.event_stream(spark, path, watermark="100 days")), tmp_path, "update")
    last = {}
    for r in rows:
        last[r["customer_id"]] = max(last.get(r["customer_id"], 0), r["event_count_total"])
    assert sum(last.values()) == 300


def test_ledger_stays_within_budget_and_repeats_are_harmless(spark, log, tmp_path):
    path, df = log
    cand = spark.createDataFrame([(c, i, k, 900.0, 0.5, 0.2) for c in (1, 2, 3) for i, k in (("low", 100.0), ("mid", 200.0), ("high", 300.0))],
                                 "customer_id bigint, intervention_intensity string, coupon_cost double, expected_incremental_profit double, expected_roi double, timing_urgency_score double")
    led = sl.QueueLedger(spark, str(tmp_path / "t"), cand, budget=450, daily_capacity=10)
    base = spark.createDataFrame([(1, 0.62), (2, 0.62), (3, 0.62)], "customer_id bigint, churn_probability double")
    ss.replay(st.scored_stream(ss.event_stream(spark, path, watermark="100 days"), base), led, str(tmp_path / "cp"))
    q = led.queue()
    assert 0 < led.open_actions().where("action_queue_status = 'queued'").agg(F.sum("coupon_cost")).first()[0] <= 450
    before = sorted(map(tuple, q.collect()), key=str)
    hits = lv.scored_events(df.withColumn("timestamp", F.expr("cast(timestamp AS timestamp_ntz)")), base).where("event_id >= 200").withColumn("timestamp", F.expr("cast(timestamp AS timestamp)"))
    led(hits, 99)
    one = sorted(map(tuple, led.queue().collect()), key=str)
    led(hits, 99)
    assert sorted(map(tuple, led.queue().collect()), key=str) == one and set(before) <= set(one)


CANDS = "customer_id bigint, intervention_intensity string, coupon_cost double, expected_incremental_profit double, expected_roi double, timing_urgency_score double"
HITS = "customer_id bigint, event_id bigint, s bigint, realtime_churn_score double, trigger_reason string"


def triggers(spark, rows):
    return spark.createDataFrame([(c, e, s, 0.8, "score_spike") for c, e, s in rows], HITS).selectExpr("customer_id", "event_id", "timestamp_seconds(s) AS timestamp", "realtime_churn_score", "trigger_reason")


def statuses(led):
    return {(r["customer_id"], r["batch_id"]): r["action_queue_status"] for r in led.queue().collect()}


def test_capacity_counts_per_event_day_over_batches(spark, tmp_path):
    cand = spark.createDataFrame([(c, "low", 10.0, 90.0, 0.5, 0.2) for c in range(20)], CANDS)
    led = sl.QueueLedger(spark, str(tmp_path / "a"), cand, budget=10_000, daily_capacity=3)
    day = 86_400
    led(triggers(spark, [(c, c, 1_700_006_400 + c) for c in range(4)] + [(c, c, 1_700_006_400 + day + c) for c in range(4, 8)]), 0)
    led(triggers(spark, [(9, 20, 1_700_006_400 + day + 500)]), 1)
    got = statuses(led)
    assert [got[c, 0] for c in range(8)] == ["queued"] * 3 + ["deferred_channel_guardrail"] + ["queued"] * 3 + ["deferred_channel_guardrail"]
    assert got[9, 1] == "deferred_channel_guardrail"


def test_held_rows_give_the_budget_back(spark, tmp_path):
    cand = spark.createDataFrame([(1, "low", 60.0, 90.0, 0.5, 0.2), (2, "low", 60.0, 90.0, 0.5, 0.2)], CANDS)
    led = sl.QueueLedger(spark, str(tmp_path / "b"), cand, budget=100, daily_capacity=9)
    led(triggers(spark, [(1, 1, 1_700_000_000), (2, 2, 1_700_000_001), (3, 3, 1_700_000_002)]), 0)
    led(triggers(spark, [(1, 4, 1_700_000_100)]), 1)
    led(triggers(spark, [(2, 5, 1_700_000_200)]), 2)
    got = statuses(led)
    assert (got[1, 0], got[2, 0], got[3, 0]) == ("queued", "deferred_budget_guardrail", "hold") and got[1, 1] == "hold" and got[2, 2] == "queued"


def test_decay_of_long_histories_is_finite_and_exact(spark):
    rng = random.Random(3)
    times, t = [], 1_500_000_000
    for k in range(400):
        t += rng.choice([600, 40_000, 900_000])
        times.append(t)
    types = ["visit", "purchase", "support_contact", "remove_from_cart", "page_view"]
    rows = [(k, 1, s, rng.choice(types), 1.0) for k, s in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id bigint, customer_id bigint, s bigint, event_type string, amount double").selectExpr("event_id", "customer_id", "cast(timestamp_seconds(s) AS timestamp_ntz) AS timestamp", "event_type", "amount")
    assert times[-1] - times[0] > 3 * 365 * 86_400
    got = {r["event_id"]: r for r in lv.states_per_event(df).collect()}
    for name, kind, half, _ in lv.SIGNALS:
        value, last = 0.0, times[0]
        for k, _, s, what, _ in rows:
            value = value * 0.5 ** ((s - last) / 3600 / half) + (what == kind)
            last = s
            assert abs(got[k][name] - value) < 1e-9, (k, name)


def test_new_customers_leave_the_cold_state_at_five_events(spark, tmp_path):
    from tidemark.streaming.serving import ServingTables

    known = spark.createDataFrame([(1, 0.9, 1000.0, 0.1)], "customer_id bigint, churn_score double, clv double, uplift_score double")
    tables = ServingTables(spark, str(tmp_path), known)

    def batch(i, *counts):
        rows = [(c, n, 0.0, "2024-01-01 00:00:00") for c, n in counts]
        tables(spark.createDataFrame(rows, "customer_id bigint, event_count_total bigint, revenue double, t string").selectExpr("customer_id", "event_count_total", "revenue", "timestamp(t) AS last_event_time"), i)
        return {r["customer_id"]: (r["risk_segment"], round(r["churn_score"], 6)) for r in tables.latest().collect()}

    assert batch(0, (1, 1), (2, 2)) == {1: ("critical", 0.9), 2: ("new", 0.48)}
    assert batch(1, (2, 4))[2] == ("new", 0.36)
    assert batch(1, (2, 4))[2] == ("new", 0.36)  # a repeated batch
    assert batch(2, (2, 6), (3, 7)) == {1: ("critical", 0.9), 2: ("low", 0.36), 3: ("low", 0.18)}


def test_replay_begins_anew_at_the_end(spark):
    e = spark.createDataFrame([(3, 10), (1, 20), (2, 20), (4, None)], "event_id bigint, s bigint").selectExpr("event_id", "timestamp_seconds(s) AS timestamp")
    ids = lambda rows: [r["event_id"] for r in rows.orderBy("position").collect()]
    seen, offset = [], 0
    for _ in range(3):
        rows, offset, wrapped = ss.replay_tick(e, offset, 2)
        seen.append((ids(rows), offset, wrapped))
    assert seen == [([3, 1], 2, False), ([2], 3, False), ([3, 1], 2, True)]
    assert ss.replay_tick(e.limit(0), 0, 5)[0].isEmpty()


def test_unreadable_text_events_have_a_reason(spark):
    raw = spark.createDataFrame([("1", "7", "2024-01-02T03:04:05Z.", " VISIT ", "1.5"), ("2", "x", "2024-01-02", "visit", None), ("3", "7", "soon", "visit", "?"), (None,) * 5],
                                "event_id string, customer_id string, timestamp string, event_type string, amount string")
    got = [(r["event_id"], r["event_type"], r["amount"], r["reject_reason"]) for r in ss.parsed_events(raw).collect()]
    assert got == [(1, "visit", 1.5, None), (2, "visit", None, "customer"), (3, "visit", None, "timestamp"), (None, None, None, "customer")]
