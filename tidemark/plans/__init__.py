"""Registered queries over the test tables, each with its check in SQL."""

from importlib import import_module

MODULES = ("feature_queries", "cohort_queries", "decision_queries", "analysis_queries", "model_queries", "pattern_queries", "onboarding_queries", "live_queries", "stream_queries", "check_queries")


def _load():
    from . import registry

    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return registry


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLES)
