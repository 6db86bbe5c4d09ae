import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordered import cut_lineage
from tidemark.operators import live as lv
from tidemark.streaming import inactivity as ia, ledger as sl, sources as ss
from tidemark.streaming.latest import Latest

DAY = 86_400
EVENTS = "event_id bigint, customer_id bigint, s bigint, event_type string, amount double"


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENTS).selectExpr("event_id", "customer_id", "timestamp_seconds(s) AS timestamp", "event_type", "amount")


def run(spark, batches, tmp, base=None, watermark="10 days"):
    """Each batch is one file and one trigger; rows come back."""
    src = str(tmp / "src")
    for rows in batches:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(src)
    got = []
    live = ia.live_stream(ss.event_stream(spark, src, watermark=None), base, watermark)
    ss.replay(live, lambda df, i: got.extend(df.withColumn("batch", F.lit(i)).collect()), str(tmp / "cp"), on_disk=True)
    return got


@pytest.fixture(scope="module")
def long_log():
    rng = random.Random(1)
    rows, now = [], dict.fromkeys(range(12), 1_600_000_000)
    for i in range(600):
        c = rng.randrange(12)
        now[c] += rng.choice([3000, 90_000, DAY * 4, DAY * 14, DAY * 40]) if rng.random() < 0.96 else DAY * 170
        rows.append((i, c, now[c], rng.choice(["visit", "purchase", "support_contact", "remove_from_cart", "page_view"]), 1.0))
    return sorted(rows, key=lambda r: r[2])


def test_timers_and_first_states_equal_the_batch_form(spark, long_log, tmp_path):
    base = spark.createDataFrame([(c, 0.3 + 0.05 * c) for c in range(10)], "customer_id bigint, churn_probability double")
    got = run(spark, [long_log[k:k + 150] for k in range(0, 600, 150)], tmp_path, base)
    log = cut_lineage(frame(spark, long_log).withColumn("timestamp", F.expr("cast(timestamp AS timestamp_ntz)")))
    want = {r["event_id"]: r for r in lv.scored_events(log, base).collect()}
    applied = [r for r in got if r["status"] == "applied"]
    assert len(applied) == 600 and not [r for r in got if r["status"] == "late"]
    for r in applied:
        w = want[r["event_id"]]
        assert abs(w["realtime_churn_score"] - r["realtime_churn_score"]) < 1e-9 and abs(w["prev_score"] - r["prev_score"]) < 1e-9 and w["trigger_reason"] == r["trigger_reason"]
    end = max(r[2] for r in long_log) - 10 * DAY
    key = lambda r: (r["customer_id"], str(r["timestamp"]), r["days_since_last_event"], round(r["prev_score"], 9), round(r["realtime_churn_score"], 9), r["trigger_reason"])
    silent = [key(r) for r in got if r["status"] == "silent"]
    twin = [key(r) for r in lv.silent_customers(log, f"cast(timestamp_seconds({end}) AS timestamp_ntz)", base).collect()]
    assert sorted(silent) == sorted(twin) and len(silent) > 100 and all("extended_inactivity" in s[-1] and s[2] >= 11 for s in silent)


def test_a_timer_fires_without_a_new_event_and_the_state_is_freed(spark, tmp_path):
    others = [(100 + k, 2, 1_600_000_000 + k * 60 * DAY, "visit", 1.0) for k in range(5)]
    first = [(1, 1, 1_600_000_000, "support_contact", 1.0)]
    got = run(spark, [first + others[:1], *[[o] for o in others[1:]], [(9, 1, 1_600_000_000 + 240 * DAY, "visit", 1.0)]], tmp_path, watermark="1 day")
    fired = [r for r in got if r["customer_id"] == 1 and r["status"] == "silent"]
    assert len(fired) >= 1 and fired[0]["batch"] < 5  # before the customer's next event came
    back = [r for r in got if r["event_id"] == 9][0]
    assert back["total_events_seen"] == 1 and back["support_signal"] == 0.0  # silent for longer than the state is kept


def test_rows_behind_the_watermark_are_handed_on_as_late(spark, tmp_path):
    t = 1_600_000_000
    got = run(spark, [[(1, 1, t, "visit", 1.0), (None, 1, t + 5, "purchase", 1.0)], [(2, 1, t + 5 * DAY, "visit", 1.0)], [(3, 1, t + DAY, "purchase", 1.0), (4, 1, t + 6 * DAY, "visit", 1.0)]], tmp_path, watermark="1 day")
    status = {r["event_id"]: r["status"] for r in got}
    assert status == {1: "applied", None: "applied", 2: "applied", 3: "late", 4: "applied"}
    last = [r for r in got if r["event_id"] == 4][0]
    assert last["total_events_seen"] == 4 and last["purchase_signal"] < 0.5  # the late purchase changed nothing


def test_every_row_received_is_accounted_for(spark, tmp_path):
    src, t = str(tmp_path / "src"), "2024-01-0{}T00:00:0{}Z"
    raw = lambda rows: spark.createDataFrame(rows, ss.RAW_SCHEMA).coalesce(1).write.mode("append").option("header", True).csv(src)
    raw([("1", "7", t.format(1, 1), "visit", "1"), ("2", "nobody", t.format(1, 2), "visit", None), ("3", "7", "soon", "visit", None), (None, "7", t.format(1, 3), "visit", None)])
    raw([("1", "7", t.format(1, 1), "visit", "1"), ("4", "8", t.format(8, 1), "visit", "1"), (None, "7", t.format(1, 3), "visit", None)])
    raw([("5", "7", t.format(2, 1), "visit", "1"), ("4", "8", t.format(8, 1), "visit", "1"), ("6", "8", t.format(9, 1), "visit", "1")])
    out = ss.SideTable(spark, str(tmp_path / "out"))
    q = ss.replay(ss.accounted(ss.raw_stream(spark, src), lambda e: ia.live_stream(e, None, "1 day")), out, str(tmp_path / "cp"), on_disk=True)
    got = {(r["status"], r["reason"]): r["count"] for r in out.rows().groupBy("status", "reason").count().collect()}
    assert got == {("applied", None): 5, ("late", None): 1, ("rejected", "customer"): 1, ("rejected", "timestamp"): 1}
    assert ss.counted(q, "usable")["rows"] - 6 == 2  # repeats of 1 and 4; events without an id are never repeats


def test_an_event_counts_once_however_late_it_comes_again(spark, tmp_path):
    src = str(tmp_path / "src")
    first = [(i, i % 3, 1_600_000_000 + i, "visit", 1.0) for i in range(20)]
    for rows in (first, [(99, 1, 1_600_000_000 + 60 * DAY, "visit", 1.0)], first + [(100, 1, 1_600_000_000 + 61 * DAY, "visit", 1.0)]):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(src)
    got = []
    s = ss.unique_forever(ss.event_stream(spark, src, watermark=None)).withWatermark("timestamp", "1 day")
    ss.replay(s, lambda df, i: got.extend(r["event_id"] for r in df.collect()), str(tmp_path / "cp"), on_disk=True)
    assert sorted(got) == [*range(20), 99, 100]


def test_latest_reads_only_its_keys_and_repeats_are_harmless(spark, tmp_path):
    table = Latest(spark, str(tmp_path / "t"), "id", folders=4)
    rows = lambda *x: spark.createDataFrame(x, "id bigint, v bigint")
    assert table.before(0, rows((1, 0))) is None and table.rows() is None
    sizes = []
    for batch in range(6):
        table.put(rows(*[(k, 100 * batch + k) for k in range(40)]), batch)
        sizes.append(spark.read.parquet(str(tmp_path / "t")).count())
    assert sizes == [40] * 6  # one row a key, however many batches there were
    one = table.before(6, rows((7, 0)))
    assert [tuple(r) for r in one.collect()] == [(7, 507)] and table._touched(rows((7, 0))).count() < 40
    table.put(rows((7, 1), (99, 2)), 6)
    table.put(rows((7, 1), (99, 2)), 6)
    assert [r["v"] for r in table.before(6, rows((7, 0), (99, 0))).collect()] == [507]  # as it stood before batch 6
    assert sorted(r["v"] for r in table.before(7, rows((7, 0), (99, 0))).collect()) == [1, 2] and table.rows().count() == 41


ACTIONS = "customer_id bigint, event_id bigint, s bigint, realtime_churn_score double, trigger_reason string, intervention_intensity string, coupon_cost double, expected_incremental_profit double, expected_roi double, timing_urgency_score double, action_priority double"


def plain_walk(rows, cents, capacity, filled):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out, used = {}, dict(filled)
    for c, own in sorted(by.items(), key=lambda x: (x[1][0][2], x[1][0][1], x[0])):
        own = sorted(own, key=lambda r: (-r[10], -r[7], -r[8], r[6], r[5]))
        day = own[0][2] // DAY
        pick = next((r for r in own if round(r[6] * 100) <= cents), None)
        if cents <= 0:
            out[c] = ("deferred_budget_guardrail", own[0][5])
        elif used.get(day, 0) >= capacity:
            out[c] = ("deferred_channel_guardrail", own[0][5])
        elif pick is None:
            out[c] = ("deferred_budget_guardrail", own[0][5])
        else:
            out[c], cents, used[day] = ("queued", pick[5]), cents - round(pick[6] * 100), used.get(day, 0) + 1
    return out


@pytest.mark.parametrize("seed, walk_rows", [(0, 0), (1, 20_000)])
def test_queue_of_many_days_equals_the_plain_walk(spark, monkeypatch, seed, walk_rows):
    monkeypatch.setattr(lv, "WALK_ROWS", walk_rows)
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        t = 1_700_006_400 + rng.randrange(6) * DAY + rng.randrange(DAY)
        for i, k in (("low", 10.25), ("mid", 20.4), ("high", 45.99)):
            rows.append((c, c, t, 0.8, "score_spike", i, k + c % 7 * 1.1, 50.0 + rng.randrange(40), 1.0, 0.2, round(rng.random(), 3)))
    filled = {1_700_006_400 // DAY: 2, 1_700_006_400 // DAY + 3: 7}
    acts = spark.createDataFrame(rows, ACTIONS).withColumn("timestamp", F.expr("timestamp_seconds(s)")).drop("s")
    before = spark.createDataFrame([(d, n) for d, n in filled.items()], "d int, n bigint").selectExpr("date_from_unix_date(d) AS day", "n")
    for cents, capacity in ((30_000, 5), (61_234, 7), (10**9, 4), (0, 5)):
        got = {r["customer_id"]: (r["action_queue_status"], r["intervention_intensity"]) for r in lv.queue_by_day(acts, remaining_cents=cents, daily_capacity=capacity, filled=before).collect()}
        assert got == plain_walk(rows, cents, capacity, filled)


def hits(spark, rows):
    return spark.createDataFrame([(c, e, s, 0.8, "score_spike") for c, e, s in rows], "customer_id bigint, event_id bigint, s bigint, realtime_churn_score double, trigger_reason string").selectExpr(
        "customer_id", "event_id", "timestamp_seconds(s) AS timestamp", "realtime_churn_score", "trigger_reason")


def test_ledger_counts_cents_and_frees_replaced_slots(spark, tmp_path):
    cand = spark.createDataFrame([(1, "low", 99.99, 200.0, 0.5, 0.2), (2, "low", 0.99, 90.0, 0.5, 0.2), (3, "low", 0.01, 90.0, 0.5, 0.2)],
                                 "customer_id bigint, intervention_intensity string, coupon_cost double, expected_incremental_profit double, expected_roi double, timing_urgency_score double")
    t = 1_700_006_400
    led = sl.QueueLedger(spark, str(tmp_path / "a"), cand, budget=100, daily_capacity=5, folders=4)
    led(hits(spark, [(1, 1, t), (2, 2, t + 1), (3, 3, t + 2)]), 0)
    assert {r["customer_id"]: r["action_queue_status"] for r in led.queue().collect()} == {1: "queued", 2: "deferred_budget_guardrail", 3: "queued"} and led.spent() == 100.0
    slots = sl.QueueLedger(spark, str(tmp_path / "b"), cand, budget=1000, daily_capacity=1, folders=4)
    slots(hits(spark, [(1, 1, t), (2, 2, t + 1)]), 0)
    slots(hits(spark, [(1, 3, t + 5)]), 1)  # nothing is left for it: held, its slot of the day is free again
    slots(hits(spark, [(2, 4, t + 6), (3, 5, t + 7)]), 2)
    got = {(r["customer_id"], r["batch_id"]): r["action_queue_status"] for r in slots.queue().collect()}
    assert got == {(1, 0): "queued", (2, 0): "deferred_channel_guardrail", (1, 1): "hold", (2, 2): "queued", (3, 2): "deferred_channel_guardrail"} and slots.spent() == 0.99
