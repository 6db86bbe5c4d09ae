"""States of customers in groups: the same results as the plain walk, in few states."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import live as lv
from tidemark.streaming import inactivity as ia, keyed, sources as ss, state as st

DAY = 86_400_000_000


def plain(batches, bases):
    """Event by event: (customer, id, seen, previous score, score) and (customer, time) of silences between events."""
    state, out, quiet = {}, [], []
    for rows in batches:
        for c, t, i, k in sorted(rows, key=lambda r: (r[1], r[2])):
            base = bases.get(c, 0.5)
            last, n, score, sig = state.get(c, (None, 0, base, [0.0] * len(lv.SIGNALS)))
            t = max(t, last) if last is not None else t
            gap = t - last if last is not None else 0
            score_at = lambda d, x: min(max(base + 0.22 / (1 + math.exp(-(d - 7) / 3)) + sum(w * y for (*_, w), y in zip(lv.SIGNALS, x)), 0.001), 0.999)
            if gap >= lv.IDLE_DAYS * DAY:
                for d in range(lv.IDLE_DAYS, lv.KEPT_DAYS):
                    worn = [y * 0.5 ** (d * 24 / h) for (_, _, h, _), y in zip(lv.SIGNALS, sig)]
                    if worn[lv.SIGNAL_NAMES.index("purchase_signal")] <= 0.10 and score_at(d, worn) >= 0.65:
                        if last + d * DAY < t:
                            quiet.append((c, last + d * DAY))
                        break
                if gap >= lv.KEPT_DAYS * DAY:
                    n, sig = 0, [0.0] * len(sig)
            sig = [y * 0.5 ** (gap / 3.6e9 / h) + (k == j) for j, ((_, _, h, _), y) in enumerate(zip(lv.SIGNALS, sig))]
            now = score_at(0, sig)
            out.append((c, i, n + 1, round(score, 9), round(now, 9)))
            state[c] = (t, n + 1, now, sig)
    return sorted(out), sorted(quiet)


@pytest.mark.parametrize("seed", range(4))
def test_groups_of_customers_equal_the_plain_walk(seed):
    rng, t0 = random.Random(seed), 1_600_000_000_000_000
    bases = {c: 0.3 + 0.05 * c for c in range(8)}
    batches, ids = [], 0
    for b in range(4):
        rows = []
        for c in range(10):
            t = t0 + b * 200 * DAY + rng.randrange(30 * DAY)
            for _ in range(300 if c == 3 else rng.choice([0, 1, 5])):  # one busy customer
                t += int(rng.choice([0, 0.01, 0.5, 3, 14, 135]) * DAY) if c != 3 else int(rng.choice([0, 0.01, 0.3]) * DAY)
                rows.append((c, t, ids, rng.randrange(len(lv.SIGNALS) + 1)))
                ids += 1
        rng.shuffle(rows)
        batches.append(rows)
    state = keyed.give_bases(keyed.unpack(None), np.array([*bases, 3]), np.array([*bases.values(), 0.9]))
    got, quiet = [], []
    for rows in batches:
        key, us, i, kind = (np.array(x, np.int64) for x in zip(*rows))
        state = keyed.with_keys(keyed.unpack(state.tobytes()), np.unique(key))
        done, silent = keyed.walk(state, key, us, i, kind, silences=True)
        got += zip(done["key"].tolist(), done["id"].tolist(), done["seen"].tolist(), done["prev"].round(9).tolist(), keyed.score_of(done["sig"], 0.0, done["base"]).round(9).tolist())
        quiet += zip(silent["key"].tolist(), (silent["last"] + silent["day"] * DAY).tolist())
    want, told = plain(batches, bases)
    assert sorted(quiet) == told and told
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in want] and np.allclose([r[3:] for r in sorted(got)], [r[3:] for r in want], atol=2e-9)


@pytest.mark.parametrize("kind", ["timers", "scores"])
def test_many_customers_share_few_states(spark, tmp_path, kind):
    rows = [(c * 10 + k, c, 1_600_000_000 + k * 86_400 + c, "visit", 1.0) for c in range(1500) for k in range(2)]
    frame = spark.createDataFrame(rows, "event_id long, customer_id long, s long, event_type string, amount double").selectExpr("event_id", "customer_id", "timestamp_seconds(s) AS timestamp", "event_type", "amount")
    frame.coalesce(1).write.parquet(str(tmp_path / "src"))
    events = ss.event_stream(spark, str(tmp_path / "src"), watermark=None if kind == "timers" else "1 day")
    got = []
    live = ia.live_stream(events, None, "100 days", groups=8) if kind == "timers" else st.scored_stream(events, groups=8)
    q = ss.replay(live, lambda df, i: got.extend(df.select("event_id").collect()), str(tmp_path / "cp"), on_disk=kind == "timers")
    assert sorted(r[0] for r in got) == sorted(r[0] for r in rows)
    # a state (and, with timers, its timer in two orders) for each group, not for each customer
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) <= 8 * 4
