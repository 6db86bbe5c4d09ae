"""Live scores with timers: a customer's state starts from known scores, fires after long silence and is freed in the end."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.live import KEY, SIGNAL_NAMES, live_score, reoptimize_triggers
from . import keyed
from .keyed import GROUPS, NO_ID, due_us, expire, frames_of, give_bases, group_of, unpack, walk, with_keys, base_of

# the process that sets up a stateful query is started without the driver's module path: it gets the class itself
for _module in (sys.modules[__name__], keyed):
    cloudpickle.register_pickle_by_value(_module)

_US_DAY = 86_400_000_000
OUTPUT = f"{KEY} bigint, event_id bigint, timestamp timestamp, event_type string, status string, total_events_seen bigint, prev_score double, days_since_last_event double, base_churn_probability double, " + ", ".join(f"{s} double" for s in SIGNAL_NAMES)
#: Rows that one output frame holds.
_CHUNK = 50_000
_NEVER = (1 << 63) - 1


class LiveScores(StatefulProcessor):
    """The signals of a group of customers.

    A batch's rows are kept as narrow arrays, however many frames they come in, and
    applied in event-time order (ties by id), to all customers of the group at once.  A row
    older than the watermark is handed on as ``late`` and changes nothing; one older than
    the state does not decay it.

    After each event it is known on which day of silence, if any, the score calls for
    attention.  The group's timer is set for the first of these days.  It fires once the
    watermark is there, or, should a customer's next event come with the same batch, in
    between.  A customer silent for ``KEPT_DAYS``, when every signal is worn off, keeps the
    base score alone.
    """

    def init(self, handle) -> None:
        self._handle = handle
        self._live = handle.getValueState("customers", "states binary, timer bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        state, timer = self._read()
        self._write(give_bases(state, initialState[KEY].to_numpy("int64"), initialState["churn_probability"].to_numpy(float)), timer)

    def close(self) -> None:
        pass

    def _read(self):
        states, timer = self._live.get() if self._live.exists() else (None, _NEVER)
        return unpack(states), timer

    def _write(self, state, timer: int) -> None:
        """Keeps the states and sets the group's timer for the first of them."""
        due = int(due_us(state).min()) if len(state) else _NEVER
        if due != timer:
            if timer != _NEVER:
                self._handle.deleteTimer(timer)
            if due != _NEVER:
                self._handle.registerTimer(due)
        if len(state):
            self._live.update((state.tobytes(), due))
        else:
            self._live.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np

        who, us, ids, kind, names = frames_of(rows)
        state, timer = self._read()
        late = us < timerValues.getCurrentWatermarkInMs() * 1000
        state = with_keys(state, np.unique(who))
        if late.any():
            then = state[np.searchsorted(state["key"], who[late])]
            base = base_of(then)
            yield from _frames({"key": who[late], "id": ids[late], "us": us[late], "kind": kind[late], "seen": np.where(then["known"], then["n"], 0), "prev": np.where(then["known"], then["score"], base),
                                "sig": np.where(then["known"][:, None], then["sig"], 0.0), "base": base}, "late", names)
        if not late.all():
            done, quiet = walk(state, *(x[~late] for x in (who, us, ids, kind)), silences=True)
            yield from _frames(done, "applied", names)
            yield from _silent(quiet)
        self._write(state[state["known"] | ~np.isnan(state["base"])], timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        state, timer = self._read()
        at = expiredTimerInfo.getExpiryTimeInMs()
        state, quiet = expire(state, max(at, timerValues.getCurrentWatermarkInMs()))
        yield from _silent(quiet)
        self._write(state, timer if timer > at else _NEVER)  # the one that fired is gone


def _frames(rows: dict, status: str, names, days=0.0) -> Iterator:
    import numpy as np
    import pandas as pd

    n = len(rows["key"])
    for i in range(0, n, _CHUNK):
        part = {k: x[i:i + _CHUNK] for k, x in rows.items()}
        out = pd.DataFrame({KEY: part["key"], "event_id": part["id"], "timestamp": part["us"].astype("datetime64[us]"), "event_type": names[part["kind"]], "status": status, "total_events_seen": part["seen"],
                            "prev_score": part["prev"], "days_since_last_event": np.broadcast_to(days, n)[i:i + _CHUNK], "base_churn_probability": part["base"]})
        for j, s in enumerate(SIGNAL_NAMES):
            out[s] = part["sig"][:, j]
        yield out


def _silent(quiet: dict) -> Iterator:
    import numpy as np

    days, n = quiet["day"].astype(float), len(quiet["key"])
    rows = {"key": quiet["key"], "id": np.full(n, NO_ID), "us": quiet["last"] + quiet["day"].astype(np.int64) * _US_DAY, "kind": np.zeros(n, np.int64), "seen": quiet["seen"], "prev": quiet["prev"],
            "sig": quiet["sig"] * 0.5 ** (days[:, None] * 24 / keyed._HALF_HOURS), "base": quiet["base"]}
    yield from _frames(rows, "silent", np.array(["inactivity"], object), days)


def live_stream(events: DataFrame, base: DataFrame | None = None, watermark: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """Every event with its scores and triggers, and a row of its own for each silence that calls for attention.

    ``status`` is ``applied``, ``silent`` (event_id null, timestamp the day it fires) or
    ``late``; late rows show the state as it stood.  ``base`` (customer_id,
    churn_probability) is the state's first content, read once when the stream begins; a
    customer it does not know starts from one half.  Events without customer or time must
    be left out before.  States are kept by ``groups`` hash groups of customers; a
    checkpoint holds for one number of them.
    """
    # the watermark's own column goes before the state, or rows behind it would be dropped unseen
    e = events.select(KEY, F.coalesce("event_id", F.lit(NO_ID)).alias("event_id"), "timestamp", "event_type", F.col("timestamp").alias("_seen")).withWatermark("_seen", watermark).drop("_seen")
    first = base.select(KEY, "churn_probability").where(F.col(KEY).isNotNull()).withColumn("_group", group_of(groups)).groupBy("_group") if base is not None else None
    st = e.withColumn("_group", group_of(groups)).groupBy("_group").transformWithStateInPandas(LiveScores(), OUTPUT, "Append", "EventTime", first, eventTimeColumnName="timestamp")
    return reoptimize_triggers(live_score(st.withColumn("event_id", F.nullif("event_id", F.lit(NO_ID))), "base_churn_probability"))
