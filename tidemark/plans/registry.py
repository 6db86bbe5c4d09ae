"""Query registry: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Views
from .oracle_views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _needed(sql: str, have: set) -> None:
    for name in VIEWS:
        if name not in have and re.search(rf"\b{name}\b", sql):
            have.add(name)
            _needed(VIEWS[name], have)


def with_views(sql: str) -> str:
    """Prepends the definitions of the shared views that the text uses."""
    have: set[str] = set()
    _needed(sql, have)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in VIEWS if n in have)
    text = sql.strip()
    if not ctes:
        return text
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", text, re.I)
    if m:
        return f"WITH {m.group(1) or ''}{ctes},\n{text[m.end():]}"
    return f"WITH {ctes}\n{text}"


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return wrap


def rounded(df: DataFrame, digits: dict[str, int] | None = None, default: int = 6) -> DataFrame:
    """Rounds double columns so that the order of addition cannot show."""
    digits = digits or {}
    return df.selectExpr(*[
        f"round(`{n}`, {digits.get(n, default)}) AS `{n}`" if t in ("double", "float") else f"`{n}`" for n, t in df.dtypes])
