"""Keyed state: decayed signals per customer, rescored at every event."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..operators.live import KEY, SIGNAL_NAMES, live_score, reoptimize_triggers
from . import keyed
from .keyed import GROUPS, NO_ID, frames_of, give_bases, group_of, unpack, walk, with_keys

for _module in (sys.modules[__name__], keyed):
    cloudpickle.register_pickle_by_value(_module)

_OUT = f"{KEY} bigint, event_id bigint, timestamp timestamp, event_type string, total_events_seen bigint, prev_score double, " + ", ".join(f"{s} double" for s in SIGNAL_NAMES)
#: Rows that one output frame holds.
_CHUNK = 50_000


def _advance(key, pdfs: Iterator, state) -> Iterator:
    """A batch's rows of a group of customers, in event-time order (ties by id), applied to all of them at once."""
    import numpy as np
    import pandas as pd

    bases = []

    def seen():
        for pdf in pdfs:
            bases.append((pdf[KEY].to_numpy(np.int64), pdf["base_churn_probability"].to_numpy(float)))
            yield pdf

    who, us, ids, kind, names = frames_of(seen())
    states = unpack(state.get[0] if state.exists else None)
    old = states["key"].copy()  # who is known keeps the base of the first batch
    given = np.concatenate([b for _, b in bases])
    given[np.isin(who, old)] = np.nan
    states = with_keys(give_bases(states, who, given), np.unique(who))
    rows, _ = walk(states, who, us, ids, kind, silences=False)
    state.update((states.tobytes(),))
    for i in range(0, len(who), _CHUNK):
        part = {k: x[i:i + _CHUNK] for k, x in rows.items()}
        res = pd.DataFrame({KEY: part["key"], "event_id": part["id"], "timestamp": part["us"].astype("datetime64[us]"), "event_type": names[part["kind"]], "total_events_seen": part["seen"], "prev_score": part["prev"]})
        for j, s in enumerate(SIGNAL_NAMES):
            res[s] = part["sig"][:, j]
        res["base_churn_probability"] = part["base"]
        yield res


def scored_stream(events: DataFrame, base: DataFrame | None = None, groups: int = GROUPS) -> DataFrame:
    """Stream of events with signals, score before and after, and trigger reasons.

    ``base`` (customer_id, churn_probability) seeds the state of a customer's first
    event. Score and triggers are the same JVM expressions as in the batch form. States
    are kept by ``groups`` hash groups of customers; a checkpoint holds for one number of them.
    """
    e = events.select(KEY, F.coalesce("event_id", F.lit(NO_ID)).alias("event_id"), "timestamp", "event_type")
    e = e.join(base.selectExpr(KEY, "churn_probability AS base_churn_probability"), KEY, "left") if base is not None else e.withColumn("base_churn_probability", F.lit(None).cast("double"))
    st = e.withColumn("_group", group_of(groups)).groupBy("_group").applyInPandasWithState(_advance, _OUT + ", base_churn_probability double", "states binary", "append", "NoTimeout")
    sc = live_score(st.withColumn("event_id", F.nullif("event_id", F.lit(NO_ID))).withColumn("days_since_last_event", F.lit(0.0)), "base_churn_probability")
    return reoptimize_triggers(sc)


def counter_stream(events: DataFrame) -> DataFrame:
    """Growing counters per customer in update mode: Spark's own keyed aggregation."""
    from ..operators.live import feature_state_counters

    return feature_state_counters(events)


def drift_stream(scored: DataFrame, window: str = "1 day") -> DataFrame:
    return scored.groupBy(F.window("timestamp", window)).agg(
        F.count(F.lit(1)).alias("events"), F.avg("realtime_churn_score").alias("avg_score"), F.stddev_samp("realtime_churn_score").alias("std_score"),
        F.expr("count_if(realtime_churn_score >= 0.7) AS high_risk_events"))


def sliding_stream(events: DataFrame, days: int) -> DataFrame:
    """Counters over the last ``days`` days per customer, as of every midnight; written when the watermark passes it."""
    w = events.groupBy(KEY, F.window("timestamp", f"{days} days", "1 day").alias("w"))
    return w.agg(F.count(F.lit(1)).alias("events"), F.expr("count_if(event_type = 'visit') AS visits"), F.expr("count_if(event_type = 'purchase') AS purchases"),
                 F.expr("coalesce(sum(amount) FILTER (WHERE event_type = 'purchase'), 0D) AS revenue")).select(KEY, F.col("w.end").alias("as_of"), "events", "visits", "purchases", "revenue")
