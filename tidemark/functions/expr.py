"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

DAY_MICROS = 86_400_000_000


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts(text: str) -> Column:
    return F.expr(f"timestamp_ntz'{text}'")


def shift_days(col, days: int) -> Column:
    return c(col) + F.expr(f"INTERVAL '{int(days)}' DAY")


def micros(col) -> Column:
    return F.unix_micros(c(col).cast("timestamp"))


def days_between(start, end) -> Column:
    """Elapsed time in fractional days."""
    return (micros(end) - micros(start)) / F.lit(float(DAY_MICROS))


def whole_days(start, end) -> Column:
    """Elapsed time floored to whole days."""
    return F.floor(days_between(start, end)).cast("long")


def month_number(col) -> Column:
    return (F.year(c(col)) * 12 + F.month(c(col))).cast("int")


def num(col, default: float | None = None) -> Column:
    """Safe numeric cast: unparsable, NaN and infinite values become null or the default."""
    v = c(col).try_cast("double")
    v = F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def clip(col, low=None, high=None) -> Column:
    """Bound a column; null stays null."""
    v = c(col)
    out = v
    if low is not None:
        lo = low if isinstance(low, Column) else F.lit(float(low))
        out = F.greatest(out, lo)
    if high is not None:
        hi = high if isinstance(high, Column) else F.lit(float(high))
        out = F.least(out, hi)
    return F.when(v.isNotNull(), out)


def logit(col) -> Column:
    v = c(col)
    return F.log(v / (F.lit(1.0) - v))


def ratio_null(n, d) -> Column:
    """n/d, null when the denominator is zero or missing."""
    d = c(d)
    return F.when(d != 0, c(n).cast("double") / d)


def ratio_zero(n, d) -> Column:
    """n/d, zero when the denominator is zero."""
    d = c(d)
    return F.when(d == 0, F.lit(0.0)).otherwise(c(n).cast("double") / F.when(d != 0, d))


def change_rate(recent, prev) -> Column:
    return ratio_null(c(recent) - c(prev), prev)


def first_of(df: DataFrame, aliases, default=None, positive: bool = False) -> Column:
    """First usable numeric value across the alias columns that exist."""
    cols = []
    for name in aliases:
        if name in df.columns:
            v = num(F.col(name))
            cols.append(F.when(v > 0, v) if positive else v)
    if default is not None:
        cols.append(F.lit(float(default)))
    return F.coalesce(*cols) if cols else F.lit(None).cast("double")


def pick_alias(columns, aliases) -> str | None:
    """Resolve a column name: exact (case-insensitive) match first, then substring."""
    lowered = {n.lower(): n for n in columns}
    for a in aliases:
        if a.lower() in lowered:
            return lowered[a.lower()]
    for a in aliases:
        for n in columns:
            if a.lower() in n.lower():
                return n
    return None


def in_window(col, end: Column, days: int, lag_days: int = 0) -> Column:
    """Half-open window (end-lag-days, end-lag]."""
    hi = shift_days(end, -lag_days) if lag_days else end
    return (c(col) > shift_days(end, -(lag_days + days))) & (c(col) <= hi)


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def slug(col) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c(col))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def repair_timestamp(col) -> Column:
    """Accepts Z, +09 and +0900 offsets and a trailing dot or colon; returns UTC."""
    t = F.trim(c(col))
    t = F.regexp_replace(t, r"[.:]+$", "")
    t = F.regexp_replace(t, r"[zZ]$", "+00:00")
    t = F.regexp_replace(t, r"(T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)([+-]\d{2})(\d{2})$", "$1$2:$3")
    t = F.regexp_replace(t, r"(T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)([+-]\d{2})$", "$1$2:00")
    t = F.regexp_replace(t, r"[.:]+([+-]\d{2}:\d{2})$", "$1")
    return F.try_to_timestamp(t)


# ---- SQL text -----------------------------------------------------------
# Long formulas are written as SQL text: one parse instead of hundreds of calls
# from Python into the JVM, and the same expression tree in the end.

def at(text: str) -> str:
    return f"timestamp_ntz'{text}'"


def win(col: str, end: str, days: int, back: int = 0) -> str:
    """Half-open window (end-back-days, end-back] as SQL text."""
    return f"({col} > {end} - INTERVAL '{days + back}' DAY AND {col} <= {end} - INTERVAL '{back}' DAY)"


def bound(x: str, low, high=None) -> str:
    """Bound an expression that is never null."""
    t = f"greatest({x}, {low})" if low is not None else x
    return f"least({t}, {high})" if high is not None else t


def days_sql(a: str, b: str) -> str:
    return f"((unix_micros(cast({b} AS timestamp)) - unix_micros(cast({a} AS timestamp))) / 86400000000D)"


def div_null(n: str, d: str) -> str:
    return f"try_divide(cast({n} AS double), nullif(cast({d} AS double), 0D))"


def chain(df: DataFrame, **steps: str) -> DataFrame:
    """Adds columns one after another; each may use the earlier ones."""
    for name, text in steps.items():
        df = df.withColumn(name, F.expr(text))
    return df


def add(df: DataFrame, **cols: str) -> DataFrame:
    """Adds or replaces columns computed side by side."""
    return df.withColumns({k: F.expr(v) for k, v in cols.items()})


def first_rows(df, n: int | None):
    """The first ``n`` rows of an ordered frame, all of them without ``n``."""
    return df if n is None else df.limit(n)
