"""Signals of many customers at once: a task keeps the states of a group of customers in one array and applies a batch to all of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from ..operators.live import IDLE_DAYS, KEPT_DAYS, KEY, SIGNAL_NAMES, SIGNALS

#: Groups of customers; part of a stream's state, so it must stay the same for a checkpoint.
GROUPS = 512
#: Stands for a missing event id inside the state function, whose frames have no null integers.
NO_ID = -(1 << 63)

_US_DAY = 86_400_000_000
_KINDS = [t for _, t, _, _ in SIGNALS]
_HALF_HOURS = np.array([h for _, _, h, _ in SIGNALS], float)
_HALF_US = _HALF_HOURS * 3.6e9
_WEIGHT = np.array([w for *_, w in SIGNALS])
_PURCHASE = SIGNAL_NAMES.index("purchase_signal")
#: A customer's state; without ``known`` only the base score counts (nan: none was given).
STATE = [("key", "i8"), ("last", "i8"), ("n", "i8"), ("base", "f8"), ("score", "f8"), ("day", "i8"), ("fired", "?"), ("known", "?"), ("sig", "f8", (len(SIGNALS),))]


def group_of(groups: int = GROUPS) -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(groups)).cast("int")


def unpack(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", np.dtype(STATE)).copy()


def with_keys(state: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``state``, in order of its keys, with a row for each of ``keys``."""
    new = np.setdiff1d(keys, state["key"])
    more = np.zeros(len(new), np.dtype(STATE))
    more["key"], more["base"] = new, np.nan
    both = np.concatenate([state, more])
    return both[np.argsort(both["key"], kind="stable")]


def give_bases(state: np.ndarray, keys: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Base scores of customers who have none, from the first known value of each."""
    there = ~np.isnan(given)
    keys, first = np.unique(keys[there], return_index=True)
    state = with_keys(state, keys)
    at = np.searchsorted(state["key"], keys)
    free = np.isnan(state["base"][at]) & ~state["known"][at]
    state["base"][at[free]] = np.clip(given[there][first][free], 0.001, 0.999)
    return state


def base_of(state: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(state["base"]), 0.5, state["base"])


def score_of(sig: np.ndarray, days, base: np.ndarray) -> np.ndarray:
    return np.clip(base + 0.22 / (1 + np.exp(-(days - 7) / 3)) + sig @ _WEIGHT, 0.001, 0.999)


def silent_days(sig: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For each row the first day of silence that calls for attention; 0 if none does while the state is kept."""
    out = np.zeros(len(sig), np.int64)
    left = np.arange(len(sig))
    for day in range(IDLE_DAYS, KEPT_DAYS):
        worn = sig[left] * 0.5 ** (day * 24 / _HALF_HOURS)
        # what raises a score wears off: rows that cannot reach it any more are done
        may = base[left] + 0.22 + worn @ np.maximum(_WEIGHT, 0) >= 0.65 - 1e-9
        left, worn = left[may], worn[may]
        if not len(left):
            break
        hit = (worn[:, _PURCHASE] <= 0.10) & (score_of(worn, day, base[left]) >= 0.65)
        out[left[hit]] = day
        left = left[~hit]
    return out


def frames_of(frames) -> tuple:
    """Customers, times in microseconds, ids and kinds of all frames, with the kinds' names."""
    parts, codes = [], {t: i for i, t in enumerate(_KINDS)}
    for pdf in frames:
        kind, names = pdf["event_type"].factorize()
        own = np.array([codes.setdefault(t, len(codes)) for t in names] + [-1], np.int64)
        parts.append((pdf[KEY].to_numpy(np.int64), pdf["timestamp"].to_numpy("datetime64[us]").astype(np.int64), pdf["event_id"].to_numpy(np.int64), own[kind]))
    names = np.array([*codes, None], object)
    return (*(np.concatenate([p[i] for p in parts]) for i in range(4)), names)


def walk(state: np.ndarray, key, us, ids, kind, silences: bool) -> tuple[dict, dict]:
    """Applies rows to their customers' states in event-time order (ties by id; a missing one first with ``silences``, else last).

    Gives the rows' results and, with ``silences``, the silences that ended with one of the
    rows.  ``state`` has a row for each customer and is brought up to date.  A row older
    than the state does not decay it.  A signal after a row is the sum of what its
    customer's rows until then have left of it: sums over 1, 2, 4 ... rows back are put
    together, so that a customer of many rows takes a few more rounds and no loop.
    """
    order = np.lexsort((ids if silences else np.where(ids == NO_ID, np.iinfo(np.int64).max, ids), us, key))
    key, us, ids, kind = key[order], us[order], ids[order], kind[order]
    n = len(key)
    first = np.r_[True, key[1:] != key[:-1]]
    own = np.searchsorted(state["key"], key)
    heads = np.flatnonzero(first)
    mine = own[heads]
    known = state["known"][mine]
    base = base_of(state)[own]
    at = np.where(state["known"][own], np.maximum(us, state["last"][own]), us)
    before = np.empty(n, np.int64)
    before[1:] = at[:-1]
    before[heads] = np.where(known, state["last"][mine], at[heads])
    gap = at - before
    lost = (gap >= KEPT_DAYS * _US_DAY) if silences else np.zeros(n, bool)
    # rows whose signals are counted together: of one customer, without a silence longer than a state is kept
    start = np.maximum.accumulate(np.where(first | lost, np.arange(n), 0))
    sig = (kind[:, None] == np.arange(len(_KINDS))).astype(float)
    kept = known & ~lost[heads]
    sig[heads[kept]] += state["sig"][mine[kept]] * 0.5 ** (gap[heads[kept], None] / _HALF_US)
    back, rows = 1, np.flatnonzero(np.arange(n) > start)
    while len(rows):
        sig[rows] += sig[rows - back] * 0.5 ** ((at[rows] - at[rows - back])[:, None] / _HALF_US)
        back *= 2
        rows = rows[rows - back >= start[rows]]
    held = np.zeros(n, np.int64)
    held[heads[kept]] = state["n"][mine[kept]]
    seen = np.arange(n) - start + 1 + held[start]
    score = score_of(sig, 0.0, base)
    prev = np.empty(n)
    prev[1:] = score[:-1]
    prev[heads] = np.where(known, state["score"][mine], base[heads])
    done = {"key": key, "id": ids, "us": us, "kind": kind, "seen": seen, "prev": prev, "sig": sig, "base": base}
    tails = np.r_[heads[1:], n] - 1
    quiet = {}
    if silences:
        day = np.zeros(n, np.int64)  # of the silence after a row
        ask = np.union1d(np.flatnonzero(np.r_[(gap[1:] >= IDLE_DAYS * _US_DAY) & ~first[1:], False]), tails)
        day[ask] = silent_days(sig[ask], base[ask])
        from_row = np.flatnonzero(~first & (gap >= IDLE_DAYS * _US_DAY))
        from_row = from_row[(day[from_row - 1] > 0) & (before[from_row] + day[from_row - 1] * _US_DAY < at[from_row])] - 1
        old = state[mine]
        ended = known & (old["day"] > 0) & ~old["fired"] & (gap[heads] >= IDLE_DAYS * _US_DAY) & (old["last"] + old["day"] * _US_DAY < at[heads])
        quiet = joined(silence_of(state[mine[ended]]), {"key": key[from_row], "last": at[from_row], "day": day[from_row], "seen": seen[from_row], "prev": score[from_row], "sig": sig[from_row], "base": base[from_row]})
        state["day"][mine], state["fired"][mine] = day[tails], False
    state["last"][mine], state["n"][mine], state["score"][mine], state["sig"][mine], state["known"][mine] = at[tails], seen[tails], score[tails], sig[tails], True
    return done, quiet


def silence_of(state: np.ndarray) -> dict:
    return {"key": state["key"], "last": state["last"], "day": state["day"], "seen": state["n"], "prev": state["score"], "sig": state["sig"], "base": base_of(state)}


def joined(a: dict, b: dict) -> dict:
    return {k: np.concatenate([a[k], b[k]]) for k in a}


def due_us(state: np.ndarray) -> np.ndarray:
    """When each customer's state asks for something next, in whole milliseconds: a silence to tell of, or to be freed; the largest number without."""
    days = np.where((state["day"] > 0) & ~state["fired"], state["day"], KEPT_DAYS).astype(np.int64)
    return np.where(state["known"], -(-(state["last"] + days * _US_DAY) // 1000), np.iinfo(np.int64).max)


def expire(state: np.ndarray, now_ms: int) -> tuple[np.ndarray, dict]:
    """The silences that are told of by ``now_ms``, and the states that are left: those silent for KEPT_DAYS keep the base score alone."""
    fire = state["known"] & (state["day"] > 0) & ~state["fired"] & (due_us(state) <= now_ms)
    quiet = silence_of(state[fire])
    state["fired"][fire] = True
    over = state["known"] & (due_us(state) <= now_ms)
    state["known"][over] = False
    return state[state["known"] | ~np.isnan(state["base"])], quiet
